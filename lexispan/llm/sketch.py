"""Document fingerprints with DataFrame functions only: every shingle hash below a fixed fraction of the range.

The fraction is the same for all documents, so sketches of unequal documents can be merged and compared: the
share of one sketch's hashes found in another estimates how much of the first document the second contains. With n
shingles and a share p the estimate's standard error is sqrt(p (1 - p) * scale / n); a text that retains nothing, as
happens to most of fewer than `scale` shingles, is like no other but an equal one. Sketches of groups of documents
(merged) are tables of (group, hash), so a group of any size stays spread over tasks.
A text of fewer words than a shingle takes is one shingle. A fingerprint is the digest of the text, a colon and
the retained hashes in order, their first 8 hexadecimal digits each, that is about one character for each word;
texts that retain nothing are told apart by the digest.

The next document is found without a global sort: bounds taken from quantiles of doc_id deal documents to
buckets, and the document at each bound is also sent to the bucket before it, so that one shuffle brings every
document together with its successor.

Defined results: null texts are empty; an empty text retains nothing and is like another text only if both
fingerprints are equal (1, else 0); equal doc_ids are ordered by their text; null doc_ids come last;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, text_or_empty

SHINGLE = 5
#: One hash of so many is retained.
SCALE = 8
#: Buckets at most; their bounds are all that reaches the driver.
MAX_BUCKETS = 4096


def hashes(words: Column, scale: int = SCALE, shingle: int = SHINGLE) -> Column:
    """The sorted distinct shingle hashes below 1 / scale of the 64-bit range."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (shingle - 1), F.lit(1)))
    every = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(shingle))))
    limit = -(2**63) + 2**64 // scale - 1
    return F.when(F.size(words) > 0, F.array_sort(F.array_distinct(F.filter(every, lambda h: h <= F.lit(limit).cast("long"))))).otherwise(F.array().cast("array<bigint>"))


def fingerprint(text: Column, sketch: Column) -> Column:
    hexed = F.transform(sketch, lambda h: F.substring(F.lpad(F.lower(F.hex(h)), 16, "0"), 1, 8))
    return F.concat(F.lpad(F.lower(F.hex(F.xxhash64(text))), 16, "0"), F.lit(":"), F.array_join(hexed, ""))


def containment(a: Column, b: Column) -> Column:
    """Share of sketch a found in sketch b; null where a is empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(a), F.lit(0))


def sketches(docs: DataFrame, by: list[str], scale: int = SCALE, shingle: int = SHINGLE) -> DataFrame:
    """The columns `by` and the sketch of every row of docs."""
    words = F.regexp_extract_all(text_or_empty(), F.lit(WORD), F.lit(0))
    return docs.select(*by, words.alias("w")).select(*by, hashes(F.col("w"), scale, shingle).alias("sketch"))


def merged(sketched: DataFrame, by: list[str]) -> DataFrame:
    """The union of the sketches of every group as rows (by, hash); merging merged tables is a union and a distinct."""
    return sketched.select(*by, F.explode("sketch").alias("hash")).distinct()


def contained(sketched: DataFrame, id_column: str, collection: DataFrame) -> DataFrame:
    """id, retained hashes and the share of them in a merged collection (a table with the column hash); null where nothing is retained."""
    known = collection.select("hash").distinct().withColumn("known", F.lit(1))
    rows = sketched.select(id_column, F.explode_outer("sketch").alias("hash")).join(known, "hash", "left")
    return rows.groupBy(id_column).agg(F.count("hash").alias("retained"), (F.count("known") / F.nullif(F.count("hash"), F.lit(0))).alias("share"))


def bucket_bounds(docs: DataFrame, buckets: int) -> list[int]:
    """Ascending doc_ids of docs, the smallest first, that cut it into at most so many parts of about equal size."""
    key = F.col("doc_id").cast("long")
    shares = [k / buckets for k in range(buckets)]
    found = docs.agg(F.percentile_approx(key, shares, 10 * buckets), F.min(key)).first()
    return sorted({*(found[0] or []), *([] if found[1] is None else [found[1]])})


def seated(rows: DataFrame, bounds: list[int]) -> DataFrame:
    """rows with bucket k, and guest = 1 for the extra copy of each bound's document in the bucket before its own."""
    n = max(1, len(bounds))
    known = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in range((n - 1).bit_length() - 1, -1, -1)]).cast("array<int>")
    # binary search: the last bound that is not above doc_id
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(known, at + step) <= F.col("doc_id"), at + step).otherwise(at))
    rows = rows.withColumn("k", F.when(F.col("doc_id").isNull(), F.lit(n - 1)).otherwise(found))
    at_bound = F.coalesce(F.get(known, F.col("k")) == F.col("doc_id"), F.lit(not bounds))
    seat = lambda k, guest: F.struct(k.alias("k"), F.lit(guest).alias("guest"))
    own, ahead = seat(F.col("k"), 0), seat(F.pmod(F.col("k") - 1, F.lit(n)), 1)
    return rows.withColumn("seat", F.explode(F.when(at_bound, F.array(own, ahead)).otherwise(F.array(own)))).drop("k").select("*", "seat.*").drop("seat")


def fingerprint_documents(docs: DataFrame, scale: int = SCALE, shingle: int = SHINGLE, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    near_edited and near_next are the share of the document's own sketch in the edited text's and in the next document's.
    """
    buckets = buckets or min(MAX_BUCKETS, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    words = lambda c: F.regexp_extract_all(c, F.lit(WORD), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("w", words(F.col("text"))).withColumn("sketch", hashes(F.col("w"), scale, shingle)).drop("w")
    order = Window.partitionBy("k").orderBy("guest", F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    ahead = seated(rows, bucket_bounds(docs, buckets)).withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", "sketch")}).filter("guest = 0")
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    df = ahead.select("doc_id", n.cast("long").alias("n_chars"), "text", "sketch", "next_text", "next_sketch", edited.alias("edited"))
    df = df.withColumn("w", words(F.col("edited"))).withColumn("edited_sketch", hashes(F.col("w"), scale, shingle))
    df = df.select(
        "*",
        fingerprint(F.col("text"), F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited"), F.col("edited_sketch")).alias("edited_fingerprint"),
    )
    near = lambda same, other: F.when(same, F.lit(1.0)).otherwise(F.coalesce(containment(F.col("sketch"), F.col(other)), F.lit(0.0)))
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        near(F.col("text") == F.col("edited"), "edited_sketch").alias("near_edited"),
        near(F.col("text") == F.col("next_text"), "next_sketch").alias("near_next"),
    )
