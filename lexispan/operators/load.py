"""Reading load for any number of readers from histograms: what a threshold costs is looked up, and no token meets a reader.

Three kinds of triggers need no more than a number of a word or sentence: its frequency (rare), its letters (long) and its words (syntax).
Their scores are straight lines that level off, so the sum of scores beyond a threshold follows from how many values lie beyond
it and what they add up to. units() writes the numbers of a corpus once, in one pass over the texts; histograms() counts them by
document, source or whatever columns are kept; cumulated() turns the counts into running totals; loads() looks thresholds up in these. Its work is
readers x groups, and with a table of pairs only the pairs asked for.

Readers are rows of profile, min_zipf (in hundredths), max_word_length, max_sentence_words and weights by kind; a kind that the weights
don't name weighs 1. Scores are added exactly in the units of KINDS. Weighted sums are rounded to ten-thousandths of a kind before they are added.

Defined results: groups without words have no row; null and empty texts have no units; empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispan.functions import text as X

#: Kinds, and by how much 1 is divided in their sums of scores.
KINDS = {"rare": 200, "long": 10, "syntax": 100}
#: Where scores level off: hundredths of zipf below the bound, letters and words beyond theirs (fixed values of the scores).
RARE_SPAN, LONG_SPAN, SYNTAX_SPAN = 140, 7, 18
#: A word of a zipf of 4 or more is one of at most 100,000, whatever the corpus, for frequencies add up to 1.
FREQUENT = 400


def units(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns, lower and size: a row for each word with its letters, and one without lower for each sentence with its words. No shuffle."""
    sentence = docs.select(*keep, F.explode(X.sentences(F.col("text"))).alias("sentence"))
    words = sentence.select(*keep, X.found(F.col("sentence"), X.LETTERS).alias("w"))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("lower"), F.size("w").alias("size")))
    each = F.transform("w", lambda w: F.struct(F.lower(w).alias("lower"), F.length(w).alias("size")))
    return words.select(*keep, F.inline(F.concat(whole, each))).filter("lower is not null or size > 0")


def zipf_hundredths(counted: DataFrame) -> DataFrame:
    """lower, n and z, the zipf frequency in hundredths, from units or any table of words (with their number n, if it has one)."""
    n = F.sum("n") if "n" in counted.columns else F.count(F.lit(1))
    by_word = counted.filter("lower is not null").groupBy("lower").agg(n.alias("n"))
    total = by_word.agg(F.sum("n").alias("total"))
    zipf = F.round(F.log10(F.col("n") / F.col("total") * 1e9), 2)
    return by_word.crossJoin(F.broadcast(total)).select("lower", "n", F.round(100 * zipf).cast("long").alias("z"))


def loosest(readers: DataFrame) -> tuple[int, int, int]:
    """(greatest min_zipf, least max_word_length, least max_sentence_words) of all readers: beyond these nobody is held up."""
    row = readers.agg(F.max("min_zipf"), F.min("max_word_length"), F.min("max_sentence_words")).first()
    return tuple(int(x) if x is not None else 0 for x in row)


def histograms(rows: DataFrame, zipf: DataFrame, by: Sequence[str], bounds: tuple[int, int, int]) -> DataFrame:
    """The columns of `by`, kind, value and n: how often each value occurs in a group, as far as some reader is held up by it; kind words counts all words.

    Words that are frequent by arithmetic are taken out by a broadcast of at most 100,000 of them before what is left meets the
    frequencies, so that no word of that join is common."""
    rare_below, long_from, syntax_from = bounds
    kind = F.when(F.col("lower").isNull(), "syntax").otherwise("long")
    held = F.when(F.col("lower").isNull(), F.col("size") > syntax_from).otherwise(F.col("size") > long_from)
    sizes = rows.filter(held).groupBy(*by, kind.alias("kind"), F.col("size").cast("long").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    words = rows.groupBy(*by).agg(F.count("lower").alias("n")).filter("n > 0").select(*by, F.lit("words").alias("kind"), F.lit(0).cast("long").alias("value"), "n")
    common = zipf.filter(F.col("z") >= max(rare_below, FREQUENT)).select("lower")
    wanted = zipf.filter((F.col("z") > 0) & (F.col("z") < rare_below)).select("lower", "z")
    left = rows.filter("lower is not null").select(*by, "lower").join(F.broadcast(common), "lower", "left_anti")
    rare = left.join(wanted, "lower").groupBy(*by, F.lit("rare").alias("kind"), F.col("z").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.unionByName(words).unionByName(rare)


def cumulated(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """A row for each group: words, and for each kind an array of v, n and s by v: how many values are at most v, and what they add up to."""
    counts = counts.repartition(*by) if by else counts  # dealt out once, for the totals and for the arrays
    order = Window.partitionBy(*by, "kind").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    running = counts.withColumns({"total": F.sum("n").over(order), "added": F.sum(F.col("n") * F.col("value")).over(order)})
    point = F.struct(F.col("value").alias("v"), F.col("total").alias("n"), F.col("added").alias("s"))
    arrays = [F.array_sort(F.collect_list(F.when(F.col("kind") == k, point))).alias(k) for k in KINDS]
    return running.groupBy(*by).agg(F.max(F.when(F.col("kind") == "words", F.col("n"))).alias("words"), *arrays).filter("words > 0")


def _until(points: Column, value: Column | None = None) -> Column:
    """The running totals of all values up to `value`, or of all values; the points are looked through once."""
    none = F.struct(F.lit(0).cast("long").alias("v"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"))
    upto = points if value is None else F.filter(points, lambda p: p.v <= value)
    return F.coalesce(F.try_element_at(upto, F.lit(-1)), none)


def loads(index: DataFrame, readers: DataFrame, by: Sequence[str], pairs: DataFrame | None = None, few_groups: bool = False) -> DataFrame:
    """The columns of `by`, profile, words, triggers, their number by kind (rare, long, syntax) and load, for every group and reader or for the pairs given.

    Readers are broadcast against groups only where there are few of them in bytes; else Spark deals both sides out. With few_groups the groups are
    broadcast and readers dealt out, since few groups are few tasks, however many readers each of them meets."""
    r = readers.select("profile", "min_zipf", "max_word_length", "max_sentence_words", *[F.coalesce(F.try_element_at("weights", F.lit(k)), F.lit(1.0)).alias(f"w_{k}") for k in KINDS])
    if few_groups:
        spark = readers.sparkSession
        r = r.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "profile")
        index = F.broadcast(index)
    met = index.crossJoin(r) if pairs is None else index.join(pairs.select(*by, "profile").distinct(), list(by)).join(r, "profile")
    m, letters, length = F.col("min_zipf").cast("long"), F.col("max_word_length").cast("long"), F.col("max_sentence_words").cast("long")
    at = {
        "r0": _until(F.col("rare"), m - RARE_SPAN), "r1": _until(F.col("rare"), m - 1), "l0": _until(F.col("long"), letters), "l1": _until(F.col("long"), letters + LONG_SPAN - 1), "l2": _until(F.col("long")),
        "s0": _until(F.col("syntax"), length), "s1": _until(F.col("syntax"), length + SYNTAX_SPAN - 1), "s2": _until(F.col("syntax")),
    }
    met = met.withColumns(at)
    n = lambda a, b: F.col(f"{b}.n") - F.col(f"{a}.n")
    s = lambda a, b: F.col(f"{b}.s") - F.col(f"{a}.s")
    sums = {
        "rare": 200 * F.col("r0.n") + (m + 60) * n("r0", "r1") - s("r0", "r1"),
        "long": 10 * n("l1", "l2") + s("l0", "l1") + (3 - letters) * n("l0", "l1"),
        "syntax": 60 * n("s1", "s2") + 2 * s("s0", "s1") + (25 - 2 * length) * n("s0", "s1"),
    }
    counts = {"rare": F.col("r1.n"), "long": n("l0", "l2"), "syntax": n("s0", "s2")}
    total = sum((F.round(F.col(f"w_{k}") * sums[k] * (10_000 // KINDS[k])).cast("long") for k in KINDS), F.lit(0).cast("long"))
    out = met.select(*by, "profile", "words", *[c.alias(k) for k, c in counts.items()], total.alias("total"))
    # halves of a hundredth are rounded up
    hundredths = F.expr("(2 * total + words) div (2 * words)")
    return out.select(*by, "profile", "words", F.expr("rare + long + syntax").alias("triggers"), *counts, (hundredths / 100.0).alias("load"))


def in_hundredths(readers: DataFrame) -> DataFrame:
    """Profiles as readers: min_zipf in hundredths."""
    return readers.withColumn("min_zipf", F.round(100 * F.col("min_zipf")).cast("long"))


def flagged_words(rows: DataFrame, zipf: DataFrame, readers: DataFrame, top: int = 15) -> DataFrame:
    """The words that each of a few readers is held up by most often, as rare or as long ones; ties by the word.

    Words are counted once by spelling and letters; readers only meet the counts of words that hold up some reader."""
    rare_below, long_from, _ = loosest(readers)
    forms = rows.filter("lower is not null").groupBy("lower", "size").agg(F.count(F.lit(1)).alias("n"))
    known = forms.join(zipf.select("lower", "z"), "lower").filter(((F.col("z") > 0) & (F.col("z") < rare_below)) | (F.col("size") > long_from))
    times = ((F.col("z") > 0) & (F.col("z") < F.col("min_zipf"))).cast("long") + (F.col("size") > F.col("max_word_length")).cast("long")
    each = known.crossJoin(F.broadcast(readers.select("profile", "min_zipf", "max_word_length"))).groupBy("profile", "lower").agg(F.sum(F.col("n") * times).alias("flagged")).filter("flagged > 0")
    place = F.row_number().over(Window.partitionBy("profile").orderBy(F.desc("flagged"), "lower"))
    return each.withColumn("place", place.cast("long")).filter(F.col("place") <= top)
