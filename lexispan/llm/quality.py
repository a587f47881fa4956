"""Quality rules with DataFrame functions only: length, repetition and divergence from a language's histograms.

A document's character-class histogram and its histogram of common words are compared with a reference made of
the documents that carry the same language mark, by the Jensen-Shannon distance (the square root of the
divergence in bits). Each comparison has a guard: documents with fewer characters or words than it needs
to be reliable are not judged by it.

Volume does not move a reference. It is made of all documents of the language that pass the base rule and are near
plain prose, a fixed histogram that any script can meet, and each of them counts once whatever its length. For
characters it is the median share of every class, so that junk up to half of these documents does not decide it;
for words it is the mean of the shares in those documents that are near that median. Both are integer counts of
rounded shares, aggregated on the map side, whatever the size of a language. A language without such a document is
held against plain prose itself.

Words beside the common ones outweigh them so far that word_limit rejects next to nothing. keep_good therefore also compares
the common words alone (shape): a document of another language is far from its mark's shape, and one without any
common word is at distance 1. The shape is a mean over documents, taken again over those near it, so that a third
in another language does not move it; languages whose documents hardly use the common words are not judged by it.
The registered query leaves the shape out, since its SQL does.

Defined results: null and empty texts have no words and fail the base rule (fewer than 20 words); texts are
judged whole; repeated rows get equal verdicts; a null language is a language of its own; a null doc_id is
carried through. Columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, text_or_empty, written

#: Common words of the languages (fixed values); a word belongs to no language in particular.
COMMON_WORDS = (
    "the of and to in is that it for on with as be at by this are from or an not",
    "le la les de des du et un une en que qui dans est pour pas au sur avec ce se il",
    "der die das und ist ein eine zu den dem von mit sich nicht auf auch des im für als es",
    "el los las del y que en un una por con no se lo su al para como más o",
)
#: Character classes, as patterns of one character; what none of them matches is the last class (fixed values).
CLASSES = (r"[A-Z]", r"[0-9]", r"[.,;:!?'\"()\-]", r"[#*$%&|<>]", r"[^\x00-\x7F]")

#: Plain prose in any script: shares of letters with all that isn't ASCII, digits, punctuation and symbols (fixed values).
PROSE = (955, 10, 30, 5)
#: Distance of shapes: on sf0.01 about 90 % of the documents are within 0.49 of their own language's, 99 % beyond 0.68 of any other's.
SHAPE_LIMIT = 0.65
COMMON = 1_000  # least median share of common words (of SHARES) in a language that is judged by their shape
SHARES = 10_000  # steps that shares are rounded to
WORD_SHARES = 1_000_000

WINDOW = 8


def _words() -> list[str]:
    return sorted({w for line in COMMON_WORDS for w in line.split()})


def _repeat_positions(spans: Column) -> Column:
    """Words covered by windows that start at the ascending positions."""
    lengths = F.transform(spans, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(spans, i + 1) - p, F.lit(WINDOW))))
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def base_measures(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes and words (counts)."""
    df = docs.select("doc_id", "lang", text_or_empty().alias("text"), *carried)
    has_word = lambda line: line.rlike(WORD)
    df = df.select("*", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w"), F.filter(F.split("text", "\n"), has_word).alias("lines"))
    n = F.size("w")
    windows = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, F.lit(WINDOW))))
    no_longs = F.array().cast("array<bigint>")
    df = df.select("*", F.when(n >= WINDOW, windows).otherwise(no_longs).alias("h"))
    # only documents in which some window comes twice go through the sort of (hash, position)
    twice = F.size(F.array_distinct("h")) < F.size("h")
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = df.select("*", F.when(twice, pairs).otherwise(F.array().cast("array<struct<x:bigint,i:int>>")).alias("s"))
    same = lambda e, j: F.get("s", j).getField("x") == e.getField("x")
    marked = F.filter("s", lambda e, j: F.coalesce(same(e, j - 1), F.lit(False)) | F.coalesce(same(e, j + 1), F.lit(False)))
    df = df.select("*", F.sort_array(F.transform(marked, lambda e: e.getField("i"))).alias("p"))
    common = F.filter(F.transform("w", F.lower), lambda x: x.isin(_words()))
    df = df.select("*", F.concat(F.lit("|"), F.array_join(common, "||"), F.lit("|")).alias("found"), F.size(common).alias("n_common"))
    counts = [F.regexp_count("text", F.lit(c)).cast("long") for c in CLASSES]
    per_word = [((F.octet_length("found") - F.octet_length(F.replace("found", F.lit(f"|{w}|"), F.lit("")))) / (len(w.encode()) + 2)).cast("long") for w in _words()]
    return df.select(
        "doc_id",
        "lang",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        counts[3].alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_positions(F.col("p")).alias("n_repeat_words"),
        F.array(*counts).alias("classes"),
        F.array(*per_word).alias("words"),
        F.col("n_common").cast("long").alias("n_common"),
        *carried,
    ).withColumns(
        {
            "classes": F.concat("classes", F.array(F.col("word_chars") - F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x))),
            "words": F.concat("words", F.array(F.col("n_words") - F.col("n_common"))),
        }
    )


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays of equal length; null where either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    # the total is a variable of the lambda, so it is added up once and not for every element
    share = lambda a: F.get(F.transform(F.array(total(a)), lambda t: F.transform(a, lambda x: x / F.nullif(t, F.lit(0.0)))), 0)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(share(p), share(q), lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    divergence = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2
    # greatest leaves nulls out, so an empty array would be at distance 0
    return F.get(F.transform(F.array(divergence), lambda d: F.when(d.isNotNull(), F.sqrt(F.greatest(d, F.lit(0.0))))), 0)


def prose_distance(classes: Column) -> Column:
    """Distance of a character-class histogram to plain prose."""
    upper, digits, marks, symbols, beyond, rest = (F.get(classes, F.lit(k)) for k in range(len(CLASSES) + 1))
    return distance(F.array(upper + beyond + rest, digits, marks, symbols), F.array(*[F.lit(x).cast("long") for x in PROSE]))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


#: Languages whose references are broadcast, about 1 KB each; with more of them the join is shuffled.
BROADCAST_LANGUAGES = 2048


def _beside(measured: DataFrame, reference: DataFrame) -> DataFrame:
    if reference.count() <= BROADCAST_LANGUAGES:
        reference = F.broadcast(reference)
    return measured.join(reference, measured["lang"].eqNullSafe(reference["ref_lang"]), "left")


def _medians(sound: DataFrame, shares: Column, name: str) -> DataFrame:
    """ref_lang and the median of every one of the shares over documents that count once each."""
    counts = sound.select("lang", F.posexplode(shares).alias("at", "share")).groupBy("lang", "at", "share").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("lang", "at")
    ranked = counts.select("*", F.sum("n").over(own).alias("all"), F.sum("n").over(own.orderBy("share")).alias("upto")).filter(2 * F.col("upto") >= F.col("all"))
    medians = ranked.groupBy("lang", "at").agg(F.min("share").alias("share"))
    return medians.groupBy(F.col("lang").alias("ref_lang")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "share"))), lambda c: c.share).alias(name))


def _common() -> Column:
    return F.slice("words", 1, len(_words()))


def _shapes(near: DataFrame, shape_limit: float, min_words: int) -> DataFrame:
    """ref_lang, ref_common (median share of common words, in an array) and ref_shape."""
    long = near.filter(F.col("n_words") >= min_words).select("lang", "n_words", "words", (F.col("n_words") - F.get("words", F.lit(len(_words())))).alias("n"))
    mean = lambda df: df.groupBy(F.col("lang").alias("ref_lang")).agg(F.array(*[F.sum(F.floor(WORD_SHARES * F.get("words", F.lit(k)) / F.col("n") + 0.5)) for k in range(len(_words()))]).alias("ref_shape"))
    used = long.filter("n > 0")
    first = written(mean(used), "shapes")
    again = written(mean(_beside(used, first).filter(distance(_common(), F.col("ref_shape")) <= shape_limit).select("lang", "words", "n")), "shapes")
    common = _medians(long, F.array(F.floor(SHARES * F.col("n") / F.col("n_words") + 0.5)), "ref_common")
    return written(common.join(again.withColumnRenamed("ref_lang", "lang"), F.col("ref_lang").eqNullSafe(F.col("lang")), "left").drop("lang"), "shapes")


def references(measured: DataFrame, char_limit: float = 0.30, shape_limit: float | None = None, min_words: int = 60) -> DataFrame:
    """ref_lang, ref_classes, ref_words and, with a shape_limit, ref_common and ref_shape of every language that has a document to make them of, as a table."""
    sound = measured.filter(~base_failed() & (prose_distance(F.col("classes")) <= char_limit))
    shares = F.transform("classes", lambda x: F.floor(SHARES * x / F.col("word_chars") + 0.5))
    medians = written(_medians(sound, shares, "ref_classes"), "medians")
    near = _beside(sound, medians).filter(F.coalesce(distance(F.col("classes"), F.col("ref_classes")), F.lit(0.0)) <= char_limit)
    share = lambda k: F.floor(WORD_SHARES * F.get("words", F.lit(k)) / F.col("n_words") + 0.5)
    words = near.groupBy("lang").agg(F.array(*[F.sum(share(k)) for k in range(len(_words()) + 1)]).alias("ref_words"))
    found = medians.join(words, medians["ref_lang"].eqNullSafe(words["lang"]), "left").drop("lang")
    if shape_limit is not None:
        shapes = _shapes(near.drop("ref_lang", "ref_classes"), shape_limit, min_words).withColumnRenamed("ref_lang", "lang")
        found = found.join(shapes, F.col("ref_lang").eqNullSafe(F.col("lang")), "left").drop("lang")
    return written(found, "reference")


def judge(
    measured: DataFrame, reference: DataFrame, char_limit: float = 0.30, word_limit: float = 0.50, min_chars: int = 200, min_words: int = 60, shape_limit: float | None = None
) -> DataFrame:
    """measured with base_failed, both distances and kept."""
    far_chars = (F.col("word_chars") >= min_chars) & (F.coalesce(F.col("char_distance"), F.lit(0.0)) > char_limit)
    far_words = (F.col("n_words") >= min_words) & (F.coalesce(F.col("word_distance"), F.lit(0.0)) > word_limit)
    if shape_limit is not None:
        judged = (F.get("ref_common", F.lit(0)) >= COMMON) & F.col("ref_shape").isNotNull()
        shape = F.when(judged, F.coalesce(distance(_common(), F.col("ref_shape")), F.lit(1.0))).otherwise(0.0)
        far_words = far_words | ((F.col("n_words") >= min_words) & F.coalesce(shape > shape_limit, F.lit(False)))
    char_distance = F.coalesce(distance(F.col("classes"), F.col("ref_classes")), prose_distance(F.col("classes")))
    return (
        _beside(measured, reference)
        .withColumns({"char_distance": char_distance, "word_distance": distance(F.col("words"), F.col("ref_words"))})
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & ~far_chars & ~far_words)
        .drop("ref_lang", "ref_classes", "ref_words", "ref_common", "ref_shape")
    )


def measure_documents(docs: DataFrame, **limits) -> DataFrame:
    """A row of measures and verdict for each row of docs; the texts are read once."""
    measured = written(base_measures(docs), "quality")
    return judge(measured, references(measured), **limits)


def keep_good(docs: DataFrame, shape_limit: float = SHAPE_LIMIT, **limits) -> DataFrame:
    """The rows of docs that pass, with all their columns. The texts are measured once: rows and measures are written together."""
    whole = docs.select("doc_id", "lang", "text", F.struct("*").alias("__row"))
    measured = written(base_measures(whole, ("__row",)), "quality")
    reference = references(measured.drop("__row"), shape_limit=shape_limit)
    return judge(measured, reference, shape_limit=shape_limit, **limits).filter("kept").select("__row.*")
