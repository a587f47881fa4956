"""The rules that need parts of speech and a lexicon, over the raw text of all documents.

The given texts are invented prose, so the lexicon is made from them: the LEXICON most frequent words of four letters or more that belong to no
closed class. Each is a verb and a noun, with more frequent words as what may stand for it; the most frequent pairs of such a word and its
successor are phrases; neighbours in rank are confusable. What is computed is what a real lexicon would be used for, at the size of the data.
"""

from __future__ import annotations

import json
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispan.functions import text as X
from lexispan.operators import edits, in_documents, style, tagging, triggers
from lexispan.operators import tokens as T
from lexispan.operators.detectors import KINDS, PROFILES
from lexispan.operators.token_table import TOKEN, completed, load_profiles, once, sentence_tokens
from lexispan.sources.scratch import stored

from . import reading

LEXICON, PHRASES = 300, 100
#: Readers of the queries: one of the built-in profiles with its bounds at the corpus's scale, and one with lists of its own.
READERS = (
    {"name": "default", "min_zipf": 5.0, "weights": PROFILES[0][4]},
    {"name": "reader", "min_zipf": 5.3, "max_word_length": 10, "max_sentence_words": 14, "ambiguity_window_sentences": 1, "weights": PROFILES[3][4]},
)


def lexicon_words(zipf: DataFrame) -> DataFrame:
    """word and r, its rank: a top-k of the corpus's words, ties by the word."""
    closed = [*tagging.closed_masks()]
    few = zipf.filter((F.length("lower") >= 4) & ~F.col("lower").isin(closed)).orderBy(F.desc("n"), "lower").limit(LEXICON)
    return few.select(F.col("lower").alias("word"), F.row_number().over(Window.orderBy(F.desc("n"), "lower")).alias("r"))


def senses_of(words: DataFrame) -> DataFrame:
    """word, pos, alternatives and hint: a verb stands for the next word in rank, a noun of even rank for the one after."""
    after = lambda k: words.select(F.col("word").alias(f"w{k}"), (F.col("r") - k).alias("r"))
    none = F.array().cast("array<string>")
    listed = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(none)
    rows = words.join(after(1), "r", "left").join(after(2), "r", "left")
    hint = F.concat(F.lit("word "), F.col("r").cast("string"))
    verbs = rows.select("word", F.lit("VERB").alias("pos"), listed("w1").alias("alternatives"), hint.alias("hint"))
    return verbs.unionByName(rows.select("word", F.lit("NOUN").alias("pos"), F.when(F.col("r") % 2 == 0, listed("w2")).otherwise(none).alias("alternatives"), hint.alias("hint")))


def phrases_of(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """phrase, alternatives and object: the most frequent pairs of a lexicon word (before, of a token) and the word after it; its own verb alone stands for a phrase."""
    pairs = tokens.filter("is_alpha").select("before", F.col("lower").alias("after")).join(F.broadcast(words), F.col("before") == F.col("word"))
    top = pairs.groupBy("word", "after").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word", "after").limit(PHRASES)
    return top.select(F.concat_ws(" ", "word", "after").alias("phrase"), F.array("word").alias("alternatives"), F.lit("any").alias("object"))


def word_pairs(docs: DataFrame) -> DataFrame:
    """before, lower and is_alpha of all tokens that follow one in their sentence; no shuffle."""
    own = docs.select(F.explode(X.found(F.col("text"), X.SENTENCE)).alias("s")).select(once(X.found(F.col("s"), TOKEN)).alias("t"))
    both = own.select(F.inline(F.arrays_zip(F.col("t").alias("a"), F.slice("t", F.lit(2), F.size("t")).alias("b"))))
    return both.select(F.lower("a").alias("before"), F.lower("b").alias("lower"), F.coalesce(F.col("b").rlike(r"^\p{L}"), F.lit(False)).alias("is_alpha"))


def readers_of(spark: SparkSession, words: DataFrame) -> DataFrame:
    """READERS with lists from the lexicon by rank: the second names words, keeps some, knows some and replaces some."""
    p = load_profiles(spark.createDataFrame([(json.dumps(r),) for r in READERS], "json string"))
    between = lambda a, b: F.collect_list(F.when(F.col("r").between(a, b), F.col("word")))
    put = words.filter("r between 21 and 30").select("word", (F.col("r") - 20).alias("to")).join(words.select(F.col("r").alias("to"), F.col("word").alias("put")), "to")
    lists = words.agg(between(11, 20).alias("l_trigger"), between(31, 40).alias("l_safe"), between(41, 120).alias("l_vocabulary"))
    replaced = put.agg(F.map_from_entries(F.collect_list(F.struct("word", "put"))).alias("l_put"))
    rows = p.crossJoin(lists).crossJoin(replaced)  # one row each
    own = F.col("profile") == "reader"
    given = {"trigger_words": "l_trigger", "safe_words": "l_safe", "vocabulary": "l_vocabulary", "replacements": "l_put"}
    return rows.withColumns({c: F.when(own, F.col(x)).otherwise(F.col(c)) for c, x in given.items()}).drop(*given.values())


class Raw:
    """What the queries of this module work on, each table stored once."""

    def __init__(self, spark: SparkSession, sf_dir: str, docs: DataFrame | None = None, counts: DataFrame | None = None):
        self.docs = docs if docs is not None else spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
        # stretches of letters never cross a sentence's end, and each lies in some sentence
        words = self.docs.select(F.explode(X.found(F.col("text"), X.LETTERS)).alias("w")).select(F.lower("w").alias("lower"))
        self.zipf = stored(T.zipf_table(words) if counts is None else T.zipf_of(counts), "zipf")
        self.words = stored(lexicon_words(self.zipf), "lexicon")
        self.senses = stored(senses_of(self.words), "senses")

    @cached_property
    def tokens(self) -> DataFrame:
        return stored(completed(tagging.tagged_text(self.docs, self.senses, "before"), tuple(tagging.closed_masks())), "tagged")

    def tables(self, phrases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(profiles, phrases, pairs) as tables."""
        profiles = stored(readers_of(self.zipf.sparkSession, self.words), "readers")
        beside = self.words.filter("r % 10 = 1").select("r", F.col("word")).join(self.words.select((F.col("r") - 1).alias("r"), F.col("word").alias("other")), "r")
        both = beside.select("word", "other").unionByName(beside.select(F.col("other").alias("word"), F.col("word").alias("other")))
        pairs = stored(triggers.pair_table(self.words.select(F.col("word").alias("lower")), both), "pairs")
        return profiles, stored(phrases, "phrases"), pairs

    def triggers(self, kinds: tuple[str, ...] = KINDS) -> tuple[DataFrame, DataFrame]:
        """(profiles, triggers of the kinds) by way of a token table, as for texts with a parse."""
        profiles, phrases, pairs = self.tables(phrases_of(self.tokens, self.words))
        return profiles, triggers.analyze(self.tokens, profiles, self.senses, phrases, pairs, self.zipf, kinds=kinds)

    def found(self, kinds: tuple[str, ...] = KINDS, shielded: bool = False) -> DataFrame:
        """Triggers of the kinds, found where the texts lie."""
        profiles, phrases, pairs = self.tables(phrases_of(word_pairs(self.docs), self.words))
        return in_documents.found(self.docs, profiles, self.senses, phrases, pairs, self.zipf, kinds, shielded)


def sentence_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, sent_index and tags, a letter for each token: A for the first of tagging.TAGS, and so on."""
    raw = Raw(spark, sf_dir)
    rows = tagging.sentence_tags(sentence_tokens(raw.docs), raw.senses)
    return rows.select("doc_id", "sent_index", F.array_join(F.transform("tags", lambda t: F.char(t + 65)), "").alias("tags"))


def all_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Raw(spark, sf_dir).found()
    spans = F.array_join(F.transform("related", lambda r: F.concat_ws("-", r.start.cast("string"), r.end.cast("string"))), ",")
    return found.select("doc_id", "profile", "kind", "sent_index", "start", "end", "text", "score", "weighted", F.array_join("alternatives", "|").alias("alternatives"), spans.alias("related"), "pos", "tag", "hint")


def trigger_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_documents.report(Raw(spark, sf_dir).found((*KINDS, "sentence")))


#: Kinds that rewriting reads: those that are substituted, and shapes, by which sentences are split.
REWRITTEN = (*edits.SUBSTITUTED, "syntax")


def accepted_substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = in_documents.substitutions(Raw(spark, sf_dir).found(edits.SUBSTITUTED, shielded=True))
    return accepted.select("doc_id", "profile", "sent_index", "start", "end", "text", "replacement", "kind")


def rewritten_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, profile, sent_index, original and rewritten of the sentences that some rule changed."""
    raw = Raw(spark, sf_dir)
    return in_documents.rewritten(raw.docs, in_documents.substitutions(raw.found((*edits.SUBSTITUTED, "break"), shielded=True)))


def learned_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole profiles of those who wrote 50 words or more in conversations, from their own turns; lists as one string."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.col("conv_id").alias("author"), "text")
    posts = turns.select("author", "text")
    words = stored(style.author_words(posts), "words")
    raw = Raw(spark, sf_dir, turns.select("doc_id", "text"), words.groupBy("lower").agg(F.sum("n").alias("n")))
    # only counts by author are wanted, so no token is written
    tags = tagging.tag_counts(turns.select(F.expr("doc_id div 1000").alias("doc_id"), "text"), raw.senses)
    tokens = tags.withColumn("is_stop", F.col("lower").isin(*tagging.closed_masks())).withColumnRenamed("doc_id", "author")
    report = stored(style.style_report(posts, words), "report")
    base = load_profiles(spark.createDataFrame([(json.dumps({"name": "default", "safe_words": ["rest"], "weights": PROFILES[0][4]}),)], "json string"))
    learned = style.learned_profiles(report, style.word_frequency(posts, raw.zipf, words), min_words=50)
    made = style.reader_profiles(learned, report, base, style.own_words(tokens, raw.zipf), style.heteronyms_used(posts, raw.senses, words=words))
    lists = {c: F.array_join(c, " ") for c in ("safe_words", "vocabulary")}
    return made.select("author", "profile", "max_sentence_words", "min_zipf", F.try_element_at("weights", F.lit("syntax")).alias("syntax_weight"), *[x.alias(c) for c, x in lists.items()], "median_sentence_words", "p75_sentence_words", "sample_words", "max_word_length")


QUERIES = {f.__name__: f for f in (sentence_tags, all_triggers, trigger_report, accepted_substitutions, rewritten_sentences, learned_readers)}

def _values(rows) -> str:
    """Rows as SQL values; text in quotes."""
    cell = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(cell(x) for x in r) + ")" for r in rows) + ")"


def _words(names) -> str:
    return "(" + ", ".join(f"'{w}'" for w in names) + ")"


_NOUN_OR_VERB = tagging.LISTED + 3
_CODES = sorted({*tagging.closed_masks().values(), *(tagging.ENDED + k for k in range(2 * len(tagging.ENDINGS))), tagging.NAMED, tagging.NUMBER, tagging.MARK, _NOUN_OR_VERB})
_COSTS = [(c, k, int(cost)) for c in _CODES for k, cost in enumerate(tagging.costs_of(c)) if cost < tagging.NEVER]
_STEPS = [(a, b, int(c)) for a, row in enumerate(tagging.step_costs()) for b, c in enumerate(row)]
_ENDING = "CASE " + " ".join(f"WHEN regexp_matches(lower, '{p}') THEN {2 * k}" for k, (p, _) in enumerate(tagging.ENDINGS)) + " END"
_PAST = [(v, k) for k, v in triggers.IRREGULAR_PAST.items()]
_OF_S = "WHEN regexp_matches(lower, '(ch|sh|x|ss)es$') THEN left(lower, length(lower) - 2) WHEN regexp_matches(lower, '[^s]s$') THEN left(lower, length(lower) - 1) ELSE lower END"
_LEMMA = rf"""CASE WHEN pos = 'VERB' THEN coalesce(base, CASE WHEN regexp_matches(lower, '(bb|dd|gg|mm|nn|pp|rr|tt)(ed|ing)$') THEN left(lower, length(lower) - length(regexp_extract(lower, '(ed|ing)$', 1)) - 1)
  WHEN regexp_matches(lower, '(ies|ied)$') THEN left(lower, length(lower) - 3) || 'y' WHEN regexp_matches(lower, '\p{{L}}{{3}}(ed|ing)$') THEN left(lower, length(lower) - length(regexp_extract(lower, '(ed|ing)$', 1))) {_OF_S})
  WHEN pos = 'NOUN' THEN CASE WHEN regexp_matches(lower, 'ies$') THEN left(lower, length(lower) - 3) || 'y' {_OF_S} ELSE lower END"""
_TAG = f"""CASE WHEN pos = 'VERB' THEN CASE WHEN before IN ('to', 'will', 'would', 'can', 'could', 'shall', 'should', 'may', 'might', 'must', 'do', 'does', 'did') THEN 'VB' WHEN lower LIKE '%ing' THEN 'VBG'
  WHEN lower LIKE '%ed' OR lower IN {_words(triggers.IRREGULAR_PAST.values())} THEN CASE WHEN before IN ('have', 'has', 'had', 'is', 'are', 'was', 'were', 'be', 'been') THEN 'VBN' ELSE 'VBD' END
  WHEN regexp_matches(lower, '[^s]s$') THEN 'VBZ' ELSE 'VBP' END WHEN pos = 'NOUN' THEN CASE WHEN regexp_matches(lower, '[^s]s$') THEN 'NNS' ELSE 'NN' END END"""
#: Every path of tags is carried along for each distinct sequence of numbers, which a sentence shares with all that look alike.
_TAGGED = reading._TOKENS.replace("WITH ch", "WITH RECURSIVE ch", 1) + rf""",
 wf AS (SELECT lower, count(*) AS n, round(log10(count(*) / (SELECT count(*) FROM tk WHERE regexp_matches(text, '^\p{{L}}')) * 1e9), 2) AS zipf FROM tk WHERE regexp_matches(text, '^\p{{L}}') GROUP BY lower),
 lx AS (SELECT lower AS word, row_number() OVER (ORDER BY n DESC, lower) AS r FROM wf WHERE length(lower) >= 4 AND lower NOT IN {_words(tagging.closed_masks())} QUALIFY r <= {LEXICON}),
 closed(lower, mask) AS {_values(sorted(tagging.closed_masks().items()))}, costs(code, tag, cost) AS {_values(_COSTS)}, steps(a, b, c) AS {_values(_STEPS)}, past(lower, base) AS {_values(_PAST)},
 fr AS (SELECT t.*, mask, word, row_number() OVER (PARTITION BY doc_id, sent_index ORDER BY tok_i) AS k FROM tk t LEFT JOIN closed USING (lower) LEFT JOIN lx ON lx.word = t.lower),
 cd AS (SELECT *, CASE WHEN regexp_matches(text, '^[0-9]') THEN {tagging.NUMBER} WHEN NOT regexp_matches(text, '^[\p{{L}}\p{{N}}]') THEN {tagging.MARK} WHEN mask IS NOT NULL THEN mask WHEN word IS NOT NULL THEN {_NOUN_OR_VERB}
  WHEN regexp_matches(text, '^\p{{Lu}}') AND k > 1 THEN {tagging.NAMED} ELSE {tagging.ENDED} + {_ENDING} + (regexp_matches(text, '^\p{{Lu}}') AND k = 1)::INT END AS code FROM fr),
 sq AS (SELECT doc_id, sent_index, list(code ORDER BY k) AS codes FROM cd GROUP BY ALL), sd AS (SELECT codes, row_number() OVER () AS id FROM (SELECT DISTINCT codes FROM sq)),
 vt AS (SELECT id, codes, 1 AS k, tag, cost + c AS cost, chr(65 + tag::INT) AS path FROM sd JOIN costs ON costs.code = codes[1] JOIN steps ON a = {len(tagging.TAGS)} AND b = tag
  UNION ALL
  SELECT id, codes, k, tag, cost, path FROM (SELECT vt.id, vt.codes, vt.k + 1 AS k, x.tag, vt.cost + s.c + x.cost AS cost, vt.path || chr(65 + x.tag::INT) AS path, vt.tag AS last FROM vt JOIN costs x ON x.code = vt.codes[vt.k + 1] JOIN steps s ON s.a = vt.tag AND s.b = x.tag)
  QUALIFY row_number() OVER (PARTITION BY id, tag ORDER BY cost, last) = 1),
 sp_tags AS (SELECT doc_id, sent_index, path FROM sq JOIN (SELECT codes, path FROM vt WHERE k = len(codes) QUALIFY row_number() OVER (PARTITION BY id ORDER BY cost, tag) = 1) USING (codes))"""
_WEIGHTS = [(r["name"], k, float(w)) for r in READERS for k, w in r["weights"].items()]
_POS = rf""",
 tp AS (SELECT c.* EXCLUDE (code, mask, word), {list(tagging.TAGS)}[ascii(substr(path, k, 1)) - 64] AS pos, lag(c.lower) OVER (PARTITION BY doc_id, sent_index ORDER BY tok_i) AS before FROM cd c JOIN sp_tags USING (doc_id, sent_index)),
 tg AS (SELECT tp.* EXCLUDE (k, before), {_TAG} AS tag, {_LEMMA} AS lemma, regexp_matches(text, '^\p{{L}}') AS alpha, regexp_matches(text, '^[0-9]') AS num, lower IN {_words(tagging.closed_masks())} AS stop FROM (SELECT * FROM tp LEFT JOIN past USING (lower)) tp)"""
_ALL = _TAGGED + _POS + rf""",
 sn AS (SELECT l.word, 'VERB' AS pos, CASE WHEN b.word IS NULL THEN [] ELSE [b.word] END AS alts, 'word ' || l.r AS hint FROM lx l LEFT JOIN lx b ON b.r = l.r + 1
  UNION ALL SELECT l.word, 'NOUN', CASE WHEN l.r % 2 = 1 OR b.word IS NULL THEN [] ELSE [b.word] END, 'word ' || l.r FROM lx l LEFT JOIN lx b ON b.r = l.r + 2),
 pr(profile, ms, mz, mw, aw) AS {_values([(r["name"], r.get("max_sentence_words", 20), r["min_zipf"], r.get("max_word_length", 12), r.get("ambiguity_window_sentences", 3)) for r in READERS])},
 wt(profile, kind, w) AS {_values(_WEIGHTS)},
 safe AS (SELECT word FROM lx WHERE r BETWEEN 31 AND 40), known AS (SELECT word FROM lx WHERE r BETWEEN 41 AND 120),
 mine AS (SELECT word AS key, NULL::VARCHAR AS put FROM lx WHERE r BETWEEN 11 AND 20 UNION ALL SELECT l.word, p.word FROM lx l JOIN lx p ON p.r = l.r - 20 WHERE l.r BETWEEN 21 AND 30),
 he AS (SELECT doc_id, profile, 'heteronym' AS kind, sent_index, start, "end", text, 0.4 AS score, alts, '' AS related, sn.pos, tag, hint FROM tg JOIN sn ON sn.word = tg.lower AND sn.pos = CASE tg.pos WHEN 'AUX' THEN 'VERB' ELSE tg.pos END, pr WHERE NOT (profile = 'reader' AND lower IN (FROM safe))),
 p1 AS (SELECT tg.*, put, 0 AS way FROM tg JOIN mine ON key = lower UNION ALL SELECT tg.*, put, 1 FROM tg JOIN mine ON key = lemma AND lemma <> lower),
 p2 AS (SELECT * FROM p1 QUALIFY row_number() OVER (PARTITION BY doc_id, tok_i ORDER BY put IS NULL, way) = 1),
 pe AS (SELECT doc_id, 'reader' AS profile, 'personal' AS kind, sent_index, start, "end", text, 1.0 AS score, CASE WHEN put IS NULL THEN coalesce(alts, []) ELSE list_concat([put], list_filter(coalesce(alts, []), lambda x: x <> put)) END AS alts, '' AS related, p2.pos, tag, hint
  FROM p2 LEFT JOIN sn ON sn.word = p2.lower AND sn.pos = p2.pos),
 a0 AS (SELECT * REPLACE (CASE pos WHEN 'PROPN' THEN 'NOUN' WHEN 'AUX' THEN 'VERB' ELSE pos END AS pos) FROM tg WHERE (NOT stop OR pos IN ('VERB', 'NOUN', 'ADJ')) AND alpha AND length(text) >= 3),
 a1 AS (SELECT * FROM a0 WHERE pos IN ('NOUN', 'VERB', 'ADJ', 'ADV')),
 a2 AS (SELECT *, greatest({", ".join(f"CASE WHEN pos <> '{q}' THEN last_value(CASE WHEN pos = '{q}' THEN tok_i END IGNORE NULLS) OVER w END" for q in ("NOUN", "VERB", "ADJ", "ADV"))}) AS q FROM a1 WINDOW w AS (PARTITION BY doc_id, lower ORDER BY tok_i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 a3 AS (SELECT o.doc_id, o.lower, o.sent_index - e.sent_index AS apart, o.sent_index, o.start, o."end", o.text, o.pos, o.tag, s.alts, s.hint, e.sent_index AS e_sent, e.start AS e_start, e."end" AS e_end, e.text AS e_text, e.pos AS e_pos, e.tag AS e_tag, z.alts AS e_alts, z.hint AS e_hint,
  coalesce(len(s.alts), 0) > 0 OR coalesce(len(z.alts), 0) = 0 AS later FROM a2 o JOIN a1 e ON e.doc_id = o.doc_id AND e.tok_i = o.q LEFT JOIN sn s ON s.word = o.lower AND s.pos = o.pos LEFT JOIN sn z ON z.word = o.lower AND z.pos = e.pos),
 am AS (SELECT doc_id, profile, 'ambiguity' AS kind, CASE WHEN later THEN sent_index ELSE e_sent END AS sent_index, CASE WHEN later THEN start ELSE e_start END AS start, CASE WHEN later THEN "end" ELSE e_end END AS "end", CASE WHEN later THEN text ELSE e_text END AS text, 0.8 AS score,
  coalesce(CASE WHEN later THEN alts ELSE e_alts END, []) AS alts, CASE WHEN later THEN e_start || '-' || e_end ELSE start || '-' || "end" END AS related, CASE WHEN later THEN pos ELSE e_pos END AS pos, CASE WHEN later THEN tag ELSE e_tag END AS tag, CASE WHEN later THEN hint ELSE e_hint END AS hint
  FROM a3, pr WHERE apart <= aw AND NOT (profile = 'reader' AND lower IN (FROM safe))),
 nx AS (SELECT *, lead(lower) OVER s AS n_lower, lead(text) OVER s AS n_text, lead("end") OVER s AS n_end, lead(alpha) OVER s AS n_alpha FROM tg WINDOW s AS (PARTITION BY doc_id, sent_index ORDER BY tok_i)),
 ph AS (SELECT lower AS word, n_lower AS after, count(*) AS n FROM nx JOIN lx ON lx.word = lower WHERE n_alpha GROUP BY ALL ORDER BY n DESC, word, after LIMIT {PHRASES}),
 gone(lower, base) AS {_values(list(triggers.IRREGULAR_PAST.items()))},
 pv AS (SELECT doc_id, profile, 'phrasal' AS kind, sent_index, start, n_end AS "end", text || ws || n_text AS text, 0.6 AS score, [CASE WHEN tag IN ('VBD', 'VBN') THEN CASE WHEN gone.base IS NOT NULL THEN gone.base WHEN word LIKE '%e' THEN word || 'd' WHEN regexp_matches(word, '[^aeiou]y$') AND length(word) > 2 THEN left(word, length(word) - 1) || 'ied' ELSE word || 'ed' END
   WHEN tag = 'VBZ' THEN CASE WHEN regexp_matches(word, '(s|sh|ch|x|z)$') THEN word || 'es' WHEN regexp_matches(word, '[^aeiou]y$') THEN left(word, length(word) - 1) || 'ies' ELSE word || 's' END
   WHEN tag = 'VBG' THEN CASE WHEN word LIKE '%ie' THEN left(word, length(word) - 2) || 'ying' WHEN word LIKE '%e' AND word NOT IN ('be', 'see', 'flee') THEN left(word, length(word) - 1) || 'ing' ELSE word || 'ing' END ELSE word END] AS alts,
  '' AS related, 'VERB' AS pos, NULL::VARCHAR AS tag, NULL::VARCHAR AS hint FROM nx JOIN ph ON ph.word = nx.lemma AND ph.after = nx.n_lower LEFT JOIN gone ON gone.lower = ph.word, pr WHERE pos IN ('VERB', 'AUX') AND regexp_matches(n_text, '[\p{{L}}\p{{N}}]')),
 {reading.metaphone_of("(SELECT word AS lower FROM lx)")},
 pt AS (SELECT word, other, min(r) AS r FROM (SELECT a.word, b.word AS other, 0 AS r FROM lx a JOIN lx b ON (a.r % 10 = 1 AND b.r = a.r + 1) OR (b.r % 10 = 1 AND a.r = b.r + 1)
  UNION ALL SELECT a.lower, b.lower, 1 FROM sounds a JOIN sounds b ON a.code = b.code AND a.lower <> b.lower AND abs(length(a.lower) - length(b.lower)) <= 2
  UNION ALL SELECT a.word, b.word, 2 FROM lx a JOIN lx b ON damerau_levenshtein(a.word, b.word) = 1) GROUP BY ALL),
 ow AS (SELECT * FROM tg WHERE alpha AND length(text) >= 3),
 n1 AS (SELECT t.*, pt.r, e.start AS e_start, e."end" AS e_end, e.tok_i AS e_tok, e.lower AS e_lower FROM ow t JOIN pt ON pt.word = t.lower JOIN ow e ON e.doc_id = t.doc_id AND e.lower = pt.other
  WHERE e.tok_i < t.tok_i AND t.sent_index - e.sent_index <= 1 AND t.lemma <> e.lemma AND (pt.r = 0 OR NOT (t.stop OR e.stop))),
 np AS (SELECT doc_id, profile, 'phonetic' AS kind, sent_index, start, "end", text, CASE r WHEN 0 THEN 0.75 ELSE 0.6 END AS score, []::VARCHAR[] AS alts, e_start || '-' || e_end AS related, pos, tag, NULL::VARCHAR AS hint FROM n1, pr
  WHERE NOT (profile = 'reader' AND (lower IN (FROM safe) OR e_lower IN (FROM safe))) QUALIFY row_number() OVER (PARTITION BY doc_id, profile, tok_i ORDER BY e_tok) = 1),
 co AS (SELECT * FROM tg, pr WHERE alpha AND pos IN ('NOUN', 'VERB', 'ADJ', 'ADV') AND NOT (profile = 'reader' AND lower IN (FROM safe))),
 ra AS (SELECT doc_id, profile, 'rare' AS kind, sent_index, start, "end", text, round(least(1.0, (mz::DOUBLE - zipf) / 2 + 0.3::DOUBLE), 6) AS score, []::VARCHAR[] AS alts, '' AS related, pos, tag, NULL::VARCHAR AS hint FROM co JOIN wf USING (lower)
  WHERE zipf > 0 AND zipf < mz::DOUBLE AND NOT (profile = 'reader' AND (lower IN (FROM known) OR lemma IN (FROM known)))),
 lo AS (SELECT doc_id, profile, 'long' AS kind, sent_index, start, "end", text, round(least(1.0, 0.3::DOUBLE + 0.1::DOUBLE * (length(text) - mw)), 6) AS score, []::VARCHAR[] AS alts, '' AS related, pos, tag, NULL::VARCHAR AS hint FROM co WHERE length(text) > mw),
 sy AS (SELECT doc_id, profile, 'syntax' AS kind, sent_index, start, "end", NULL::VARCHAR AS text, round(least(0.6::DOUBLE, 0.25::DOUBLE + 0.02::DOUBLE * (n - ms)), 6) AS score, []::VARCHAR[] AS alts, '' AS related, NULL::VARCHAR AS pos, NULL::VARCHAR AS tag, NULL::VARCHAR AS hint
  FROM (SELECT doc_id, sent_index, min(start) AS start, max("end") AS "end", count(*) FILTER (alpha OR num) AS n FROM tg GROUP BY ALL), pr WHERE n > ms),
 tr AS (SELECT * REPLACE (score::DOUBLE AS score), round(score::DOUBLE * w::DOUBLE, 6) AS weighted FROM (FROM pe UNION ALL FROM am UNION ALL FROM pv UNION ALL FROM he UNION ALL FROM np UNION ALL FROM ra UNION ALL FROM lo UNION ALL FROM sy) JOIN wt USING (profile, kind))"""
_ACCEPTED = _ALL + rf""", {reading._SPANS},
 cw AS MATERIALIZED (SELECT tr.*, f.tok_i AS a FROM (SELECT * FROM tr WHERE kind IN ('personal', 'phrasal', 'ambiguity') AND len(alts) > 0 AND weighted >= {edits.SUBSTITUTE_FROM}) tr JOIN tk f ON f.doc_id = tr.doc_id AND f.start = tr.start ANTI JOIN sp ON sp.doc_id = tr.doc_id AND sp.start < tr."end" AND tr.start < sp."end"),
 c0 AS (SELECT w.doc_id, profile, w.sent_index, w.start, w."end", w.text, alts[1] AS alt, kind, list_position(['personal', 'phrasal', 'ambiguity'], kind) AS rank, a, l.tok_i AS b FROM cw w JOIN tk l ON l.doc_id = w.doc_id AND l."end" = w."end"),
 ca AS (SELECT *, (a > coalesce(max(b) OVER (PARTITION BY doc_id, profile, sent_index ORDER BY a, b DESC, rank, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1))::INT AS new FROM (SELECT *, row_number() OVER () AS i FROM c0)),
 cb AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, profile, sent_index ORDER BY a, b DESC, rank, i ROWS UNBOUNDED PRECEDING) AS island FROM ca),
 c1 AS (SELECT doc_id, profile, sent_index, island, list([{{'a': a, 'b': b, 'start': start, 'end': "end", 'text': text, 'alt': alt, 'kind': kind}}] ORDER BY rank, start, "end" DESC) AS c FROM cb GROUP BY ALL),
 c2 AS (SELECT doc_id, profile, sent_index, unnest(list_reduce(c, lambda got, x: CASE WHEN len(list_filter(got, lambda y: y.a <= x[1].b AND x[1].a <= y.b)) > 0 THEN got ELSE list_concat(got, x) END)) AS x FROM c1),
 ac AS (SELECT doc_id, profile, sent_index, x.a AS a, x.b AS b, x.start AS start, x."end" AS "end", x.text AS text, CASE WHEN regexp_matches(x.text, '^\p{{Lu}}{{2,}}$') THEN upper(x.alt) WHEN regexp_matches(x.text, '^\p{{Lu}}') THEN upper(left(x.alt, 1)) || substr(x.alt, 2) ELSE x.alt END AS replacement, x.kind AS kind FROM c2)"""
_COLUMNS = "doc_id, profile, kind, sent_index, start, \"end\", text, score, weighted, array_to_string(alts, '|') AS alternatives, related, pos, tag, hint"
_TURNS = _TAGGED.replace("WITH RECURSIVE ch", "WITH RECURSIVE documents AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations WHERE role = 'user'), ch", 1) + _POS
ORACLE = {
    "learned_readers": _TURNS + rf""",
 psents AS (SELECT conv_id AS author, unnest({reading._SENT}) AS sentence FROM conversations WHERE role = 'user'), ps AS (SELECT author, regexp_extract_all(sentence, '\p{{L}}+') AS words FROM psents WHERE regexp_matches(sentence, '\p{{L}}')),
 pw AS (SELECT author, lower(unnest(words)) AS lower FROM ps), pa AS (SELECT author, sum(len(words))::BIGINT AS sample_words, round(quantile_cont(len(words), 0.5), 4) AS median_sentence_words, round(quantile_cont(len(words), 0.75), 4) AS p75_sentence_words FROM ps GROUP BY author),
 pz AS (SELECT author, round(coalesce(median(zipf), 4.6), 4) AS m FROM pw LEFT JOIN wf USING (lower) GROUP BY author),
 us AS (SELECT author, lower, count(*) AS n FROM pw JOIN lx ON lx.word = lower GROUP BY author, lower QUALIFY row_number() OVER (PARTITION BY author ORDER BY count(*) DESC, lower) <= 40),
 ow AS (SELECT doc_id // 1000 AS author, lemma, count(*) AS n FROM tg WHERE alpha AND pos IN ('NOUN', 'VERB', 'ADJ', 'ADV') AND lemma IN (SELECT lower FROM wf WHERE zipf > 0) GROUP BY ALL HAVING count(*) >= 2)
 SELECT author, 'default+writing' AS profile, least(greatest(round_even(p75_sentence_words, 0), 8), 28)::INT AS max_sentence_words, greatest(2.8::DOUBLE, least(4.2::DOUBLE, round_even(m - 1.1::DOUBLE, 2))) AS min_zipf, 1.0::DOUBLE AS syntax_weight,
 array_to_string(list_sort(list_distinct(list_concat(['rest'], coalesce((SELECT list(lower) FROM us WHERE us.author = pa.author AND n >= 5), [])))), ' ') AS safe_words, coalesce((SELECT string_agg(lemma, ' ' ORDER BY lemma) FROM ow WHERE ow.author = pa.author), '') AS vocabulary,
 median_sentence_words, p75_sentence_words, sample_words, 12 AS max_word_length FROM pa JOIN pz USING (author) WHERE sample_words >= 50""",
    "sentence_tags": f"{_TAGGED} SELECT doc_id, sent_index, path AS tags FROM sp_tags",
    "all_triggers": f"{_ALL} SELECT {_COLUMNS} FROM tr",
    "trigger_report": f"""{_ALL}, s AS (SELECT doc_id, count(DISTINCT sent_index) AS sentences, count(*) FILTER (alpha OR num) AS words FROM tg GROUP BY doc_id), m AS (SELECT doc_id, profile, count(*) AS triggers, sum(round(1000000 * weighted)::BIGINT)::BIGINT AS total FROM tr GROUP BY ALL)
 SELECT s.doc_id, pr.profile, sentences, words, coalesce(triggers, 0) AS triggers, CASE WHEN words > 0 THEN ((2 * coalesce(total, 0) + 100 * words) // (200 * words)) / 100.0::DOUBLE ELSE 0.0 END AS load FROM s CROSS JOIN pr LEFT JOIN m ON m.doc_id = s.doc_id AND m.profile = pr.profile""",
    "accepted_substitutions": f"{_ACCEPTED} SELECT doc_id, profile, sent_index, start, \"end\", text, replacement, kind FROM ac",
    "rewritten_sentences": _ACCEPTED + rf""",
 hd AS (SELECT doc_id, para_no FROM tk GROUP BY ALL HAVING count(*) FILTER (ws <> '') < 8 AND NOT regexp_matches(arg_max(text, tok_i), '^[.!?,;:]$') AND count(DISTINCT sent_index) = 1),
 ed AS (SELECT ac.doc_id, profile, tok_i, CASE WHEN tok_i = a THEN replacement ELSE '' END AS put FROM ac JOIN tk ON tk.doc_id = ac.doc_id AND tk.tok_i BETWEEN a AND b WHERE NOT EXISTS (SELECT 1 FROM hd WHERE hd.doc_id = tk.doc_id AND hd.para_no = tk.para_no)),
 ch2 AS (SELECT DISTINCT ed.doc_id, ed.profile, sent_index FROM ed JOIN tk ON tk.doc_id = ed.doc_id AND tk.tok_i = ed.tok_i),
 sw AS (SELECT c.doc_id, c.profile, c.sent_index, trim(string_agg(text || ws, '' ORDER BY t.tok_i), ' ') AS original, string_agg(coalesce(put, text) || ws, '' ORDER BY t.tok_i) AS said FROM ch2 c JOIN tk t ON t.doc_id = c.doc_id AND t.sent_index = c.sent_index LEFT JOIN ed ON ed.doc_id = t.doc_id AND ed.profile = c.profile AND ed.tok_i = t.tok_i GROUP BY ALL),
 sx AS (SELECT doc_id, profile, sent_index, original, trim(regexp_replace(regexp_replace(said, ' {{2,}}', ' ', 'g'), ' ([,.;:!?])', '\1', 'g'), ' ') AS rewritten FROM sw) SELECT * FROM sx WHERE original <> rewritten""",
}
