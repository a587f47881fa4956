"""Queries on documents, labels, pages and conversations, with SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.functions import text as X
from lexispan.operators import detectors as D
from lexispan.operators import in_documents, load, neighbours, protect, rewrite, sounds, style, token_table, tokens
from lexispan.sources import documents as S
from lexispan.sources import pages as P
from lexispan.sources.scratch import stored

QUOTA = 2000
CHUNK_WORDS = 200
#: Words of the invented prose are all frequent on a curated list's scale.
ZIPF_SHIFT, RARE = 1.5, 5.0


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.word_table(_t(spark, sf_dir, "documents"))


def _numbers(spark: SparkSession, sf_dir: str, *keep: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Units of all documents and their frequencies as tables, and the built-in profiles as readers, a table too: its size is known, so groups aren't made anew for parts of it."""
    rows = stored(load.units(_t(spark, sf_dir, "documents"), keep), "units")
    return rows, stored(load.zipf_hundredths(rows), "zipf"), stored(load.in_hundredths(D.profiles(spark, ZIPF_SHIFT)), "readers")


def _loads(rows: DataFrame, zipf: DataFrame, readers: DataFrame, *by: str) -> DataFrame:
    return load.loads(load.cumulated(load.histograms(rows, zipf, by, load.loosest(readers)), by), readers, by)


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").filter("role = 'user'").select(F.col("conv_id").alias("author"), "text")


def zipf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.zipf_table(_words(spark, sf_dir))


def unit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.unit_counts(_t(spark, sf_dir, "documents"))


def chapter_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.chunked_paragraphs(_t(spark, sf_dir, "documents"), CHUNK_WORDS)


def quota_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = X.cut_to_quota(F.col("text"), QUOTA)
    return _t(spark, sf_dir, "documents").select("doc_id", F.length(cut).cast("long").alias("kept_chars"), (F.length("text") > QUOTA).alias("truncated"), F.md5(cut.cast("binary")).alias("digest"))


def load_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loads(*_numbers(spark, sf_dir, "doc_id"), "doc_id").select("doc_id", "profile", "words", "triggers", "load")


def load_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source of documents costs each writer of conversations.

    A writer's longest sentence is the upper quartile of their own, within 8 and 28; their longest word has twice the letters of their
    mean word, within 8 and 14; and the more they repeat themselves, the rarer a word may be."""
    rows, zipf, _ = _numbers(spark, sf_dir, "source")
    own = style.style_report(_posts(spark, sf_dir))
    within = lambda c, low, high: F.least(F.greatest(c, F.lit(low)), F.lit(high)).cast("int")
    least = F.lit(500) - F.expr("(10000 - cast(round(10000 * type_token) as bigint)) div 100")
    weights = F.create_map(*[F.lit(x) for kv in D.PROFILES[0][4].items() for x in kv])
    readers = own.select(F.col("author").alias("profile"), least.alias("min_zipf"), within(F.ceil(2 * F.col("word_length")), 8, 14).alias("max_word_length"), within(F.bround("p75"), 8, 28).alias("max_sentence_words"), weights.alias("weights"))
    readers = stored(readers, "readers")
    index = stored(load.cumulated(load.histograms(rows, zipf, ["source"], load.loosest(readers)), ["source"]), "index")
    return load.loads(index, readers, ["source"], few_groups=True).select("source", F.col("profile").alias("author"), "words", "rare", "long", "syntax", "load")


def top_flagged_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load.flagged_words(*_numbers(spark, sf_dir))


def triggers_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of triggers by profile and kind, with totals."""
    found = _loads(*_numbers(spark, sf_dir))
    each = found.select("profile", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in load.KINDS]))).filter("n > 0")
    out = each.rollup("profile", "kind").agg(F.sum("n").alias("triggers"))
    return out.select(F.coalesce("profile", F.lit("all")).alias("profile"), F.coalesce("kind", F.lit("all")).alias("kind"), "triggers")


def load_vs_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = load_by_document(spark, sf_dir).join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return joined.groupBy("profile", "quality").agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("load"), 2).alias("mean_load"))


def lookalike_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.lookalike_pairs(tokens.zipf_table(_words(spark, sf_dir)))


def soundalike_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.soundalike_classes(tokens.zipf_table(_words(spark, sf_dir)))


def sound_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sounds.sound_classes(tokens.zipf_table(_words(spark, sf_dir)))


def near_pair_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_lookalike_rows(_t(spark, sf_dir, "documents"))


def ambiguity_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.ambiguity(_words(spark, sf_dir))


def personal_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readers are conversations; a reader's own words are those that they use at least 5 times."""
    own = stored(style.vocabularies(_posts(spark, sf_dir), 5).select(F.col("author").cast("string").alias("reader"), "lower"), "own")
    docs = D.by_document(_t(spark, sf_dir, "documents"), own.select("reader").distinct().count())
    words = tokens.word_table(docs).join(F.broadcast(own.select("lower").distinct()), "lower", "left_semi")
    return D.personal_by_class(D.word_counts(words), stored(D.reader_classes(own), "classes"))


def ranked_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.ranked_alternatives(tokens.zipf_table(_words(spark, sf_dir)), RARE)


def substituted_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    zipf = stored(tokens.zipf_table(_words(spark, sf_dir)), "zipf")
    first = stored(rewrite.ranked_alternatives(zipf, RARE).filter("place = 1").select("lower", "alternative"), "alternatives")
    return in_documents.replaced_words(docs, first, zipf)


def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table.token_table(_t(spark, sf_dir, "documents")).select("doc_id", "para_no", "sent_index", "tok_i", "start", "end", "lower")


def protected_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protect.spans_with_offsets(_t(spark, sf_dir, "documents"))


def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = S.clean_text(F.coalesce("text", F.lit("")), markdown=True)
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(text.cast("binary")).alias("digest"))


def chapter_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of three words at most are taken for headings, since the given texts have no chapters."""
    found = S.chapters(_t(spark, sf_dir, "documents"), r"^\S+( \S+){0,2}$")
    return found.select("doc_id", "chapter", "title", F.length("body").cast("long").alias("chars"))


def gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reasons of the gate against the candidates of fidelity_gate; what needs sentences counts as later."""
    candidate = F.when(F.col("doc_id") % 2 == 1, F.regexp_replace("text", "[0-9]", "")).otherwise(F.regexp_replace("text", r"^[^\n]*\n", ""))
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("original"), candidate.alias("candidate"))
    reason = F.when(F.col("reason").isin("empty", "too_short", "too_long", "missing_protected_span"), F.col("reason")).otherwise("later")
    return protect.reject_reasons(rows).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("documents"))


def author_connectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style.connectives(_posts(spark, sf_dir))


def imported_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.imported(_t(spark, sf_dir, "pages"))


def protected_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protect.protected_spans(_t(spark, sf_dir, "documents"))


def fidelity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates are the texts without their first line, or without digits where doc_id is odd."""
    candidate = F.when(F.col("doc_id") % 2 == 1, F.regexp_replace("text", "[0-9]", "")).otherwise(F.regexp_replace("text", r"^[^\n]*\n", ""))
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("original"), candidate.alias("candidate"))
    return protect.reject_reasons(rows).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("documents"))


def dedupe_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = protect.dedupe_keys(_t(spark, sf_dir, "documents"), "v1", "rules")
    return keys.groupBy("cache_key").agg(F.min("doc_id").alias("computed_for"), F.count(F.lit(1)).alias("documents"))


def rewrite_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protect.cost_estimates(_t(spark, sf_dir, "documents"), 0.15, 0.6)


def style_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style.style_report(_posts(spark, sf_dir))


def learned_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = _posts(spark, sf_dir)
    return style.learned_profiles(style.style_report(posts), style.word_frequency(posts, tokens.zipf_table(_words(spark, sf_dir))))


def sentence_starters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style.starters(_posts(spark, sf_dir))


def reader_vocabularies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style.vocabularies(_posts(spark, sf_dir))


def article_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.articles(_t(spark, sf_dir, "pages"))


def url_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return _t(spark, sf_dir, "pages").select("page_id", P.host(url).alias("host"), P.admissible(url).alias("admissible"))


_SENT = r"list_filter(list_transform(regexp_extract_all(coalesce(text,''), '[^.!?\n]+[.!?]*'), lambda s: trim(s, ' ')), lambda s: regexp_matches(s, '[\p{L}\p{N}]'))".replace("\\n", "\n")
_SENTENCES = f"sents AS (SELECT doc_id, unnest({_SENT}) AS sentence, generate_subscripts({_SENT}, 1) - 1 AS sent_index FROM documents)"
_WORDS = (
    f"WITH {_SENTENCES}, words AS (SELECT doc_id, sent_index, unnest(regexp_extract_all(sentence, '\\p{{L}}+')) AS word, "
    "generate_subscripts(regexp_extract_all(sentence, '\\p{L}+'), 1) - 1 AS tok_i FROM sents), toks AS (SELECT *, lower(word) AS lower FROM words)"
)
_ZIPF = "zipf AS (SELECT lower, count(*) AS n, round(log10(count(*) / (SELECT count(*) FROM toks) * 1e9), 2) AS zipf FROM toks GROUP BY lower)"
_PROFILES = "profiles(profile, max_s, min_z, max_w, w_rare, w_long, w_syntax) AS (VALUES " + ", ".join(
    f"('{n}', {s}, {round(z + ZIPF_SHIFT, 2)}::DOUBLE, {w}, {x['rare']}, {x['long']}, {x['syntax']})" for n, s, z, w, x in D.PROFILES
) + ")"
_TRIGGERS = f"""{_WORDS}, {_ZIPF}, {_PROFILES}, triggers AS (
 SELECT doc_id, profile, 'rare' AS kind, t.lower, least(1.0, (min_z - zipf) / 2 + 0.3) * w_rare AS weighted FROM toks t JOIN zipf z ON t.lower = z.lower, profiles WHERE zipf > 0 AND zipf < min_z
 UNION ALL SELECT doc_id, profile, 'long', lower, least(1.0, 0.3 + 0.1 * (length(word) - max_w)) * w_long FROM toks, profiles WHERE length(word) > max_w
 UNION ALL SELECT doc_id, profile, 'syntax', NULL, least(0.6, 0.25 + 0.02 * (n - max_s)) * w_syntax FROM (SELECT doc_id, sent_index, count(*) AS n FROM toks GROUP BY ALL), profiles WHERE n > max_s)"""
_LOAD = f"""{_TRIGGERS}, load AS (SELECT w.doc_id, p.profile, w.words, coalesce(s.triggers, 0) AS triggers, ((2 * coalesce(s.total, 0) + w.words) // (2 * w.words)) / 100.0::DOUBLE AS load
 FROM (SELECT doc_id, count(*) AS words FROM toks GROUP BY doc_id) w CROSS JOIN profiles p
 LEFT JOIN (SELECT doc_id, profile, count(*) AS triggers, sum(round(10000 * weighted::DOUBLE)::BIGINT)::BIGINT AS total FROM triggers GROUP BY ALL) s ON s.doc_id = w.doc_id AND s.profile = p.profile)"""
_PAIRS = """long AS (SELECT lower FROM zipf WHERE length(lower) >= 4),
 cut AS (SELECT lower, unnest(range(1, length(lower) + 1)) AS i FROM long), keys AS (SELECT lower, i, left(lower, (i - 1)::BIGINT) || substr(lower, i + 1) AS key,
  left(lower, (i - 1)::BIGINT) || substr(lower, i + 1, 1) || substr(lower, i, 1) || substr(lower, i + 2) AS swap FROM cut),
 pairs AS (SELECT a.lower AS word, b.lower AS other FROM keys a JOIN keys b ON a.key = b.key AND a.i = b.i AND a.lower < b.lower
  UNION SELECT least(k.lower, w.lower), greatest(k.lower, w.lower) FROM keys k JOIN long w ON k.key = w.lower
  UNION SELECT k.lower, w.lower FROM keys k JOIN long w ON k.swap = w.lower AND k.lower < w.lower)"""
_RANKED = """ranked AS (SELECT a.lower, b.lower AS alternative, row_number() OVER (PARTITION BY a.lower ORDER BY b.n DESC, b.lower) AS place FROM zipf a JOIN zipf b ON left(a.lower, 4) = left(b.lower, 4)
 WHERE length(a.lower) >= 4 AND length(b.lower) >= 4 AND a.zipf < 5.0::DOUBLE AND length(b.lower) <= length(a.lower) AND b.zipf > a.zipf + 0.3::DOUBLE)"""
_PARA = "list_filter(list_transform(CASE WHEN regexp_matches(coalesce(text,''), '\\n\\s*\\n') THEN regexp_split_to_array(coalesce(text,''), '\\n\\s*\\n') ELSE string_split(coalesce(text,''), chr(10)) END, lambda p: trim(p, ' ')), lambda p: p <> '')"
_WHITE = "list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')"
_POSTS = f"""WITH posts AS (SELECT conv_id AS author, text FROM conversations WHERE role = 'user'),
 sents AS (SELECT author, unnest({_SENT}) AS sentence FROM posts), s AS (SELECT *, regexp_extract_all(sentence, '\\p{{L}}+') AS words FROM sents WHERE regexp_matches(sentence, '\\p{{L}}'))"""
_HOST = r"regexp_replace(lower(regexp_extract(coalesce(url,''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?(\[[^\]/?#]*\]|[^/:?#]*)', 1)), '\.+$', '')"

_Q = {k: "'" + p.replace("'", "''") + "'" for k, p in protect.SPANS.items()}
_ABOUT = r"(?i)\b(?:rewrit[\p{L}0-9_]*|rewrote)\b"


def _of(column: str) -> str:
    """The sentences of a column that isn't null."""
    return _SENT.replace("coalesce(text,'')", column)


_GATE = f"""WITH c AS (SELECT doc_id, coalesce(text, '') AS o, trim(CASE WHEN doc_id % 2 = 1 THEN regexp_replace(coalesce(text, ''), '[0-9]', '', 'g') ELSE regexp_replace(coalesce(text, ''), '^[^\n]*\n', '') END, ' ') AS k FROM documents),
 n AS (SELECT *, list_concat(list_concat(regexp_extract_all(o, {_Q['quote']}), regexp_extract_all(o, {_Q['number']})), regexp_extract_all(o, {_Q['code/url']})) AS spans FROM c),
 r AS (SELECT doc_id, CASE WHEN trim(k, ' ') = '' THEN 'empty' WHEN length(k) / greatest(length(o), 1) < 0.6 THEN 'too_short' WHEN length(k) / greatest(length(o), 1) > 1.6 THEN 'too_long'
 WHEN len(list_filter(spans, lambda s: NOT contains(lower(k), regexp_replace(lower(trim(s, ' ')), '^["\u201C\u201D\u2018\u2019]+|["\u201C\u201D\u2018\u2019]+$', '', 'g')))) > 0 THEN 'missing_protected_span'
 WHEN regexp_matches(k, '{_ABOUT}') AND NOT regexp_matches(o, '{_ABOUT}') THEN 'meta_comment'
 WHEN greatest(len({_of('k')}), 1) < greatest(1, round_even(0.6 * greatest(len({_of('o')}), 1), 0)) THEN 'too_few_sentences' END AS reason FROM n)"""
_ONE_OF_A_RUN = "x"
for _digit in "123456":
    _ONE_OF_A_RUN = f"regexp_replace({_ONE_OF_A_RUN}, '{_digit}+', '{_digit}', 'g')"
#: Sound codes: letters as digits (fixed values), 7 for those that don't part equal digits, runs taken once, vowels left out.
_SOUNDS = f"""digits AS (SELECT lower, translate(regexp_replace(lower, '[^a-z]', '0', 'g'), 'abcdefghijklmnopqrstuvwxyz', '01230127022455012623017202') AS x
 FROM zipf WHERE length(lower) >= 4 AND regexp_matches(lower, '^[a-z]')),
 joined AS (SELECT lower, left(x, 1) || replace(substr(x, 2), '7', '') AS x FROM digits),
 sounds AS (SELECT lower, upper(left(lower, 1)) || rpad(left(replace(substr({_ONE_OF_A_RUN}, 2), '0', ''), 3), 3, '0') AS code FROM joined)"""



def metaphone_of(words: str) -> str:
    """SQL tables that end with sounds (lower, code) of the words of four letters or more of a table of distinct words (lower)."""
    at = lambda k: f"substr(p, i + {k}, 1)" if k >= 0 else f"substr(p, i - {-k}, 1)"
    c, b, a, n = at(0), at(-1), at(1), at(2)
    soft, vowels = "('e', 'i', 'y')", "('a', 'e', 'i', 'o', 'u')"
    return f"""mp AS (SELECT lower, regexp_replace(lower, '[^a-z]', '', 'g') AS o FROM {words} WHERE length(lower) >= 4),
 mq AS (SELECT lower, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(o, '^ae', 'e'), '^[gkp]n', 'n'), '^wr', 'r'), '^wh', 'w'), '^x', 's') AS o FROM mp),
 mr AS (SELECT lower, '^^' || o || '$$$$' AS p, length(o) AS n FROM mq),
 ms AS (SELECT lower, array_to_string(list_transform(range(3, n + 3), lambda i: CASE WHEN {c} = {b} AND {c} <> 'c' THEN '' WHEN {c} IN {vowels} THEN CASE WHEN i = 3 THEN upper({c}) ELSE '' END
  WHEN {c} = 'b' THEN CASE WHEN {b} = 'm' AND {a} = '$' THEN '' ELSE 'B' END
  WHEN {c} = 'c' THEN CASE WHEN {a} = 'i' AND {n} = 'a' THEN 'X' WHEN {a} = 'h' AND {b} = 's' THEN 'K' WHEN {a} = 'h' THEN 'X' WHEN {a} IN {soft} AND {b} = 's' THEN '' WHEN {a} IN {soft} THEN 'S' ELSE 'K' END
  WHEN {c} = 'd' THEN CASE WHEN {a} = 'g' AND {n} IN {soft} THEN 'J' ELSE 'T' END
  WHEN {c} = 'g' THEN CASE WHEN {a} = 'h' THEN CASE WHEN {n} IN {vowels} OR {n} = '$' THEN 'K' ELSE '' END WHEN substr(p, i + 1, 2) = 'n$' OR substr(p, i + 1, 4) = 'ned$' OR ({b} = 'd' AND {a} IN {soft}) THEN '' WHEN {a} IN {soft} THEN 'J' ELSE 'K' END
  WHEN {c} = 'h' THEN CASE WHEN {b} IN ('c', 's', 'p', 't', 'g') OR ({b} IN {vowels} AND {a} NOT IN {vowels}) THEN '' ELSE 'H' END
  WHEN {c} = 'k' THEN CASE WHEN {b} = 'c' THEN '' ELSE 'K' END WHEN {c} = 'p' THEN CASE WHEN {a} = 'h' THEN 'F' ELSE 'P' END
  WHEN {c} = 's' THEN CASE WHEN {a} = 'h' OR ({a} = 'i' AND {n} IN ('o', 'a')) THEN 'X' ELSE 'S' END
  WHEN {c} = 't' THEN CASE WHEN {a} = 'i' AND {n} IN ('a', 'o') THEN 'X' WHEN {a} = 'h' THEN '0' WHEN {a} = 'c' AND {n} = 'h' THEN '' ELSE 'T' END
  WHEN {c} IN ('w', 'y') THEN CASE WHEN {a} IN {vowels} THEN upper({c}) ELSE '' END
  WHEN {c} IN ('q') THEN 'K' WHEN {c} = 'v' THEN 'F' WHEN {c} = 'x' THEN 'KS' WHEN {c} = 'z' THEN 'S' ELSE upper({c}) END), '') AS code FROM mr),
 sounds AS (SELECT lower, code FROM ms WHERE code <> '')"""


_TOKENS = r"""WITH ch AS (SELECT doc_id, unnest(cs) AS chunk, generate_subscripts(cs, 1) AS ci FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?\n]+[.!?]*|[.!?\n]+') AS cs FROM documents)),
 cf AS (SELECT *, sum(length(chunk)) OVER d - length(chunk) AS f, sum(regexp_matches(chunk, '\n\n')::INT) OVER d AS blanks, sum(contains(chunk, chr(10))::INT) OVER d AS ends, max(regexp_matches(chunk, '\n\n')::INT) OVER (PARTITION BY doc_id) AS has FROM ch WINDOW d AS (PARTITION BY doc_id ORDER BY ci)),
 st AS (SELECT *, CASE WHEN has > 0 THEN blanks ELSE ends END AS para_no, row_number() OVER (PARTITION BY doc_id ORDER BY ci) - 1 AS sent_index FROM cf WHERE regexp_matches(chunk, '[\p{L}\p{N}]')),
 pc AS (SELECT doc_id, para_no, sent_index, f, unnest(ps) AS text, generate_subscripts(ps, 1) AS pi FROM (SELECT *, regexp_extract_all(chunk, '\p{L}+|[0-9]+|\s+|[^\p{L}0-9\s]') AS ps FROM st)),
 pl AS (SELECT *, f + sum(length(text)) OVER s AS "end", lead(text) OVER s AS after FROM pc WINDOW s AS (PARTITION BY doc_id, sent_index ORDER BY pi)),
 tk AS (SELECT doc_id, para_no::BIGINT AS para_no, sent_index, row_number() OVER (PARTITION BY doc_id ORDER BY sent_index, pi) - 1 AS tok_i, ("end" - length(text))::BIGINT AS start, "end"::BIGINT AS "end", text, lower(text) AS lower, CASE WHEN regexp_matches(coalesce(after, ''), '^\s') THEN after ELSE '' END AS ws FROM pl WHERE NOT regexp_matches(text, '^\s'))"""
_SPANS = "sp AS (" + " UNION ALL ".join(
    f"""SELECT doc_id, '{k}' AS why, ("end" - length(span))::BIGINT AS start, "end"::BIGINT AS "end", span FROM (SELECT *, sum(length(gap) + coalesce(length(span), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS "end"
 FROM (SELECT doc_id, unnest(g) AS gap, generate_subscripts(g, 1) AS i, s[generate_subscripts(g, 1)] AS span FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), {p}) AS g, regexp_extract_all(coalesce(text, ''), {p}) AS s FROM documents))) WHERE span IS NOT NULL"""
    for k, p in _Q.items()
) + ")"

ORACLE = {
    "zipf_table": f"{_WORDS}, {_ZIPF} SELECT * FROM zipf",
    "unit_counts": f"""WITH u AS (SELECT doc_id, {_PARA} AS p, {_SENT} AS s, coalesce(text, '') AS text FROM documents), c AS (SELECT doc_id, len(p) AS paragraphs,
 len(list_filter(p, lambda x: len({_WHITE.format('x')}) BETWEEN 1 AND 8 AND NOT regexp_matches(x, '[.!?,;:]$') AND NOT contains(x, chr(10)))) AS headings,
 len(s) AS sentences, coalesce(list_max(list_transform(s, lambda x: len(regexp_extract_all(x, '\\p{{L}}+')))), 0) AS longest_sentence,
 len({_WHITE.format('text')}) AS white_words, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) AS reader_words,
 len(regexp_extract_all(text, '\\p{{L}}+|[0-9]+')) AS tokens FROM u)
 SELECT *, CASE WHEN reader_words < 200 THEN '<1' ELSE round(reader_words / 200)::BIGINT::VARCHAR END AS minutes FROM c""",
    "chapter_chunks": f"""WITH p AS (SELECT doc_id, list_transform({_PARA}, lambda x: len({_WHITE.format('x')})) AS sizes FROM documents),
 r AS (SELECT doc_id, list_reduce(list_concat([{{'c': 0::BIGINT, 'w': 0::BIGINT, 'd': []::STRUCT(chunk BIGINT, words BIGINT)[]}}], list_transform(sizes, lambda z: {{'c': 0::BIGINT, 'w': z::BIGINT, 'd': []::STRUCT(chunk BIGINT, words BIGINT)[]}})),
  lambda a, x: CASE WHEN a.w > 0 AND a.w + x.w > {CHUNK_WORDS} THEN {{'c': a.c + 1, 'w': x.w, 'd': list_concat(a.d, [{{'chunk': a.c, 'words': a.w}}])}} ELSE {{'c': a.c, 'w': a.w + x.w, 'd': a.d}} END) AS s FROM p),
 u AS (SELECT doc_id, unnest(CASE WHEN s.w > 0 THEN list_concat(s.d, [{{'chunk': s.c, 'words': s.w}}]) ELSE s.d END) AS k FROM r) SELECT doc_id, k.chunk AS chunk, k.words AS words FROM u""",
    "quota_cut": f"""WITH c AS (SELECT doc_id, text, CASE WHEN length(text) > {QUOTA} THEN regexp_replace(left(text, {QUOTA}), '\\s\\S*$', '') ELSE text END AS cut FROM documents)
 SELECT doc_id, length(cut) AS kept_chars, length(text) > {QUOTA} AS truncated, md5(cut) AS digest FROM c""",
    "load_by_document": f"{_LOAD} SELECT * FROM load",
    "top_flagged_words": f"""{_TRIGGERS}, c AS (SELECT profile, lower, count(*) AS flagged FROM triggers WHERE lower IS NOT NULL GROUP BY ALL)
 SELECT profile, lower, flagged, row_number() OVER (PARTITION BY profile ORDER BY flagged DESC, lower) AS place FROM c QUALIFY place <= 15""",
    "triggers_by_kind": f"{_TRIGGERS} SELECT coalesce(profile, 'all') AS profile, coalesce(kind, 'all') AS kind, count(*) AS triggers FROM triggers GROUP BY ROLLUP (profile, kind)",
    "load_vs_quality": f"{_LOAD} SELECT profile, quality, count(*) AS documents, round(avg(load), 2) AS mean_load FROM load JOIN labels USING (doc_id) GROUP BY ALL",
    "load_by_source": f"""{_WORDS}, {_ZIPF}, psents AS (SELECT conv_id AS author, unnest({_SENT}) AS sentence FROM conversations WHERE role = 'user'),
 ps AS (SELECT author, regexp_extract_all(sentence, '\\p{{L}}+') AS words FROM psents WHERE regexp_matches(sentence, '\\p{{L}}')), pw AS (SELECT author, unnest(words) AS word FROM ps),
 r AS (SELECT author, 500 - (10000 - round(10000 * round(count(DISTINCT lower(word)) / count(*), 4))::BIGINT) // 100 AS m, least(greatest(ceil(2 * round(avg(length(word)), 4)), 8), 14)::BIGINT AS letters FROM pw GROUP BY author),
 q AS (SELECT author, least(greatest(round_even(round(quantile_cont(len(words), 0.75), 4), 0), 8), 28)::BIGINT AS most FROM ps GROUP BY author), rd AS (SELECT * FROM r JOIN q USING (author)),
 t AS (SELECT source, length(word) AS size, round(100 * zipf)::BIGINT AS z, count(*) AS n FROM toks JOIN documents USING (doc_id) JOIN zipf USING (lower) GROUP BY ALL),
 l AS (SELECT source, words, count(*) AS n FROM (SELECT source, doc_id, sent_index, count(*) AS words FROM toks JOIN documents USING (doc_id) GROUP BY ALL) GROUP BY ALL),
 a AS (SELECT source, author, sum(n)::BIGINT AS words, coalesce(sum(n) FILTER (z > 0 AND z < m), 0)::BIGINT AS rare, coalesce(sum(n * least(200, m - z + 60)) FILTER (z > 0 AND z < m), 0)::BIGINT AS rs,
  coalesce(sum(n) FILTER (size > letters), 0)::BIGINT AS long, coalesce(sum(n * least(10, 3 + size - letters)) FILTER (size > letters), 0)::BIGINT AS ls FROM t, rd GROUP BY ALL),
 b AS (SELECT source, author, coalesce(sum(n) FILTER (words > most), 0)::BIGINT AS syntax, coalesce(sum(n * least(60, 25 + 2 * (words - most))) FILTER (words > most), 0)::BIGINT AS ss FROM l, rd GROUP BY ALL)
 SELECT a.source, a.author, words, rare, long, syntax, ((2 * (round(0.7::DOUBLE * rs * 50)::BIGINT + round(0.6::DOUBLE * ls * 1000)::BIGINT + round(0.9::DOUBLE * ss * 100)::BIGINT) + words) // (2 * words)) / 100.0::DOUBLE AS load
 FROM a JOIN b ON a.author = b.author AND a.source IS NOT DISTINCT FROM b.source""",
    "lookalike_pairs": f"{_WORDS}, {_ZIPF}, {_PAIRS} SELECT * FROM pairs",
    "soundalike_classes": f"""{_WORDS}, {_ZIPF}, {_SOUNDS}
 SELECT code, count(*) AS words, min(lower) AS first_word, max(lower) AS last_word FROM sounds GROUP BY code HAVING count(*) > 1""",
    "sound_classes": f"""{_WORDS}, {_ZIPF}, {metaphone_of('zipf')}
 SELECT code, count(*) AS words, min(lower) AS first_word, max(lower) AS last_word FROM sounds GROUP BY code HAVING count(*) > 1""",
    "near_pair_triggers": f"""{_WORDS}, {_ZIPF}, {_PAIRS}, both_ways AS (SELECT word, other FROM pairs UNION ALL SELECT other, word FROM pairs)
 SELECT doc_id, sent_index, tok_i, lower, f.other AS other, f.p_sent AS p_sent FROM (SELECT t.doc_id, t.sent_index, t.tok_i, t.lower, min({{'p_sent': e.sent_index, 'p_tok': e.tok_i, 'other': e.lower}}) AS f
 FROM toks t JOIN both_ways b ON t.lower = b.word JOIN toks e ON e.doc_id = t.doc_id AND e.lower = b.other
 WHERE t.sent_index - e.sent_index BETWEEN 0 AND 1 AND (e.sent_index < t.sent_index OR e.tok_i < t.tok_i) GROUP BY ALL)""",
    "ambiguity_triggers": f"""{_WORDS}, b AS (SELECT *, lag(lower) OVER (PARTITION BY doc_id, sent_index ORDER BY tok_i) AS before FROM toks),
 m AS (SELECT *, CASE WHEN before IN {D.BEFORE_NOUN} THEN 'NOUN' WHEN before IN {D.BEFORE_VERB} THEN 'VERB' END AS role FROM b), r AS (SELECT * FROM m WHERE role IS NOT NULL AND length(lower) >= 3),
 p AS (SELECT *, CASE WHEN role = 'NOUN' THEN last_value(CASE WHEN role = 'VERB' THEN sent_index END IGNORE NULLS) OVER w ELSE last_value(CASE WHEN role = 'NOUN' THEN sent_index END IGNORE NULLS) OVER w END AS p_sent
 FROM r WINDOW w AS (PARTITION BY doc_id, lower ORDER BY sent_index, tok_i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT doc_id, sent_index, tok_i, lower, role, p_sent FROM p WHERE sent_index - p_sent <= 3""",
    "personal_triggers": f"""{_WORDS}, psents AS (SELECT conv_id, unnest({_SENT}) AS sentence FROM conversations WHERE role = 'user'), pw AS (SELECT conv_id, lower(unnest(regexp_extract_all(sentence, '\\p{{L}}+'))) AS lower FROM psents),
 own AS (SELECT conv_id::VARCHAR AS reader, lower FROM pw GROUP BY ALL HAVING count(*) >= 5) SELECT reader AS profile, doc_id, count(*) AS triggers FROM toks JOIN own USING (lower) GROUP BY ALL""",
    "ranked_alternatives": f"{_WORDS}, {_ZIPF}, {_RANKED} SELECT * FROM ranked WHERE place <= 3",
    "substituted_sentences": f"""{_TOKENS}, {_WORDS[5:]}, {_ZIPF}, {_RANKED}, {_SPANS}, p AS (SELECT t.doc_id, t.sent_index, t.tok_i, alternative, CASE WHEN alternative IS NULL THEN t.text WHEN regexp_matches(t.text, '^\\p{{Lu}}{{2,}}$') THEN upper(alternative)
  WHEN regexp_matches(t.text, '^\\p{{Lu}}') THEN upper(left(alternative, 1)) || substr(alternative, 2) ELSE alternative END || ws AS w
  FROM tk t LEFT JOIN (SELECT t.doc_id, t.tok_i, r.alternative FROM tk t JOIN ranked r ON r.lower = t.lower AND r.place = 1 WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.doc_id = t.doc_id AND sp.start < t."end" AND t.start < sp."end")) a ON a.doc_id = t.doc_id AND a.tok_i = t.tok_i)
 SELECT doc_id, sent_index, count(alternative) AS changes, trim(string_agg(w, '' ORDER BY tok_i), ' ') AS rewritten FROM p GROUP BY ALL HAVING count(alternative) > 0""",
    "protected_spans": " UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS why, generate_subscripts(x, 1) - 1 AS place, unnest(x) AS span FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{p}') AS x FROM documents)" for k, p in protect.PROTECTED.items()
    ).replace("\\n", "\n").replace('\\"', '"'),
    "dedupe_keys": "SELECT sha256('v1|rules|' || coalesce(text, '')) AS cache_key, min(doc_id) AS computed_for, count(*) AS documents FROM documents GROUP BY 1",
    "rewrite_costs": f"""WITH c AS (SELECT doc_id, len({_PARA}) AS paragraphs, length(coalesce(text, '')) // 4 AS t FROM documents)
 SELECT doc_id, paragraphs, t + 600 * paragraphs AS tokens_in, t AS tokens_out, ((t + 600 * paragraphs) * 0.15::DOUBLE + t * 0.6::DOUBLE) / 1e6 AS price FROM c""",
    "style_report": _POSTS + """, a AS (SELECT author, count(*) AS sentences, sum(len(words))::BIGINT AS words, max(len(words)) AS longest, round(avg((len(words) <= 6)::INT), 4) AS short_rate, round(avg((len(words) >= 20)::INT), 4) AS long_rate,
 round(avg(contains(sentence, '?')::INT), 4) AS question_rate, round(avg(contains(sentence, '!')::INT), 4) AS exclamation_rate, round(avg((contains(sentence, '(') AND contains(sentence, ')'))::INT), 4) AS parenthesis_rate,
 round(avg(contains(sentence, '!!')::INT), 4) AS multi_exclamation_rate, round(avg((contains(sentence, '...') OR contains(sentence, '\u2026'))::INT), 4) AS ellipsis_rate,
 round(sum(len(regexp_extract_all(sentence, '\\p{L}[''\u2019]\\p{L}'))) / count(*), 4) AS contractions, round(sum(len(regexp_extract_all(sentence, '[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{1F1E6}-\\x{1F1FF}]'))) / count(*), 4) AS emoji,
 round(sum(length(sentence) - length(replace(sentence, ',', ''))) / count(*), 4) AS commas, quantile_cont(len(words), [0.25, 0.5, 0.75, 0.9]) AS q FROM s GROUP BY author),
 w AS (SELECT author, word, lower(word) AS lower FROM (SELECT author, unnest(words) AS word FROM s)),
 b AS (SELECT author, round(avg(length(word)), 4) AS word_length, round(100 * avg((lower IN ('i','me','my','mine','we','us','our'))::INT), 4) AS first_person,
 round(100 * avg(regexp_matches(word, '^\\p{Lu}{3,}$')::INT), 4) AS capitals, round(avg((length(word) > 9)::INT), 4) AS long_word_rate, round(count(DISTINCT lower) / count(*), 4) AS type_token FROM w GROUP BY author)
 SELECT a.* EXCLUDE (q), b.* EXCLUDE (author), round(q[1], 4) AS p25, round(q[2], 4) AS median, round(q[3], 4) AS p75, round(q[4], 4) AS p90 FROM a JOIN b USING (author)""",
    "learned_profiles": f"{_WORDS}, {_ZIPF}, {_POSTS[5:]}".replace("FROM sents", "FROM psents").replace(", sents AS (SELECT author", ", psents AS (SELECT author").replace("\n sents AS (SELECT author", "\n psents AS (SELECT author").replace("toks AS (SELECT *, lower(word) AS lower FROM psents", "toks AS (SELECT *, lower(word) AS lower FROM sents").replace("AS tok_i FROM psents", "AS tok_i FROM sents") + """, a AS (SELECT author, sum(len(words)) AS words, quantile_cont(len(words), 0.75) AS p75 FROM s GROUP BY author),
 z AS (SELECT author, round(coalesce(median(zipf), 4.6), 4) AS m FROM (SELECT author, lower(unnest(words)) AS lower FROM s) LEFT JOIN zipf USING (lower) GROUP BY author)
 SELECT author, least(greatest(round_even(round(p75, 4), 0), 8), 28)::BIGINT AS max_sentence_words, greatest(2.8::DOUBLE, least(4.2::DOUBLE, round_even(m - 1.1::DOUBLE, 2))) AS min_zipf, 1.0::DOUBLE AS syntax_weight FROM a JOIN z USING (author) WHERE words >= 150""",
    "author_connectives": _POSTS + f""", w AS (SELECT author, lower(unnest(words)) AS connective FROM s), c AS (SELECT author, connective, count(*) AS n FROM w WHERE connective IN {style.CONNECTIVES} GROUP BY ALL)
 SELECT author, connective, n FROM c QUALIFY row_number() OVER (PARTITION BY author ORDER BY n DESC, connective) <= 20""",
    "token_offsets": f"{_TOKENS} SELECT doc_id, para_no, sent_index, tok_i, start, \"end\", lower FROM tk",
    "protected_offsets": f"""WITH {_SPANS} SELECT doc_id, why, start, "end", span, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, list_position(['quote', 'number', 'code/url'], why)) - 1 AS place FROM sp""",
    "clean_texts": r"""WITH u AS (SELECT doc_id, regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?m)^#{1,6}\s*', '', 'g'), '[*_`]{1,3}', '', 'g'), '\r\n?', chr(10), 'g'), '\n\s*\n') AS ps FROM documents)
 SELECT doc_id, md5(array_to_string(list_filter(list_transform(ps, lambda p: trim(regexp_replace(p, '\s*\n\s*', ' ', 'g'), ' ')), lambda p: p <> ''), chr(10) || chr(10))) AS digest FROM u""",
    "chapter_lengths": r"""WITH l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
 h AS (SELECT *, regexp_matches(line, '^\S+( \S+){0,2}$') AS head FROM l), s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS section, sum(head::INT) OVER (PARTITION BY doc_id) AS heads FROM h),
 b AS (SELECT doc_id, section, coalesce(max(trim(regexp_replace(line, '^#+\s*', ''), ' ')) FILTER (head), '') AS title, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT head), ''), '^\s+|\s+$', '', 'g') AS body FROM s WHERE section > 0 OR heads = 0 GROUP BY doc_id, section)
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section) AS chapter, title, length(body) AS chars FROM b WHERE body <> ''""",
    "gate_reasons": _GATE + """ SELECT CASE WHEN reason IN ('empty', 'too_short', 'too_long', 'missing_protected_span') THEN reason ELSE 'later' END AS reason, count(*) AS documents
 FROM r GROUP BY ALL""",
    "fidelity_gate": _GATE + " SELECT coalesce(reason, 'accepted') AS reason, count(*) AS documents FROM r GROUP BY ALL",
    "sentence_starters": _POSTS + """, f AS (SELECT author, lower(words[1]) AS starter, count(*) AS n FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY n DESC, starter) AS place FROM f)
 SELECT author, starter, n FROM r WHERE place <= 40 AND n >= 3""",
    "reader_vocabularies": _POSTS + " SELECT author, lower(w) AS lower, count(*) AS n FROM (SELECT author, unnest(words) AS w FROM s) GROUP BY ALL HAVING count(*) >= 2",
    "url_admission": f"""WITH h AS (SELECT page_id, url, {_HOST} AS host FROM pages), p AS (SELECT *, regexp_matches(host, '^(25[0-5]|2[0-4][0-9]|1?[1-9]?[0-9]|1[0-9][0-9])(\\.(25[0-5]|2[0-4][0-9]|1?[1-9]?[0-9]|1[0-9][0-9])){{3}}$') AS literal,
 coalesce(try_cast(split_part(host, '.', 1) AS INT), -1) AS a, coalesce(try_cast(split_part(host, '.', 2) AS INT), -1) AS b, coalesce(try_cast(split_part(host, '.', 3) AS INT), -1) AS c FROM h)
 SELECT page_id, host, regexp_matches(coalesce(url, ''), '(?i)^https?://') AND host <> '' AND NOT regexp_matches(host, '(^|\\.)localhost$') AND NOT regexp_matches(host, '\\.(local|internal)$') AND NOT regexp_matches(host, '[\\s%]')
 AND NOT (NOT literal AND regexp_matches(host, '^(0x[0-9a-f]*|[0-9]+)(\\.(0x[0-9a-f]*|[0-9]+))*$'))
 AND NOT (contains(host, '[') AND NOT (regexp_matches(host, '^\\[[23][0-9a-f]{{3}}:[0-9a-f:]+\\]$') AND NOT regexp_matches(host, '^\\[(2001:(0{{0,3}}[0-9a-f]?|0?[01][0-9a-f]{{0,2}}|0?db8)?:|2002:|3fff:)')))
 AND NOT (literal AND (a IN (0, 10, 127) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR a >= 224
  OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113))) AS admissible FROM p""",
}

QUERIES = {
    f.__name__: f
    for f in (
        zipf_table, unit_counts, chapter_chunks, quota_cut, load_by_document, load_by_source, top_flagged_words, triggers_by_kind, load_vs_quality, lookalike_pairs, soundalike_classes, sound_classes, near_pair_triggers,
        ambiguity_triggers, personal_triggers, ranked_alternatives, substituted_sentences, protected_spans, fidelity_gate, dedupe_keys, rewrite_costs, style_report, learned_profiles, sentence_starters, reader_vocabularies, article_texts, url_admission,
        token_offsets, protected_offsets, clean_texts, chapter_lengths, gate_reasons, author_connectives, imported_pages,
    )
}
