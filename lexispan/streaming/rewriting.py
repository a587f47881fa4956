"""Rewriting a queue of chapters as they come: what was computed once is never computed again, and what failed is tried again.

A batch takes the new chapters and those that failed before and have attempts left. Texts are told by the digest of version, engine and text; digests that the
cache has are looked up, the others go once each through the rewriter, and what it accepts is added to the cache. Cache and results are logs of one folder a
batch: a batch that Spark runs again writes its own folder again and reads only those before it, so nothing comes twice. current() is the result by chapter, the
latest batch first.

Defined results: a null text fails at once and isn't tried again; equal texts are computed once, whatever their chapters; a chapter that comes again takes the
place of the earlier one; an empty batch writes nothing new but still tries what failed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CHAPTER = "book_id long, chapter int, text string"
DONE = "book_id long, chapter int, source string, text string, status string, attempts int, cached boolean"
CACHE = "cache_key string, output string"


def _log(spark: SparkSession, path: str, schema: str, before: int | None) -> DataFrame:
    """A log's rows with their batch, from batches before the given one; an empty folder is made where there is no log yet."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/batch=-1")
    rows = spark.read.schema(f"{schema}, batch long").parquet(path)
    return rows if before is None else rows.filter(F.col("batch") < before)


def latest(rows: DataFrame) -> DataFrame:
    """Of each chapter the row of its last batch."""
    columns = [c for c in rows.columns if c not in ("book_id", "chapter")]
    last = rows.groupBy("book_id", "chapter").agg(F.max_by(F.struct(*columns), "batch").alias("x"))
    return last.select("book_id", "chapter", "x.*")


def current(spark: SparkSession, out: str) -> DataFrame:
    """book_id, chapter, source, text, status (ready or failed), attempts, cached and batch of every chapter that was taken."""
    return latest(_log(spark, f"{out}/done", DONE, None))


def rewrite_batch(batch: DataFrame, number: int, rewrite: Callable[[DataFrame], DataFrame], out: str, version: str = "v1", engine: str = "rules", most_attempts: int = 2) -> None:
    """One batch of chapters (book_id, chapter, text). rewrite takes cache_key and text and gives cache_key and text, null where it failed."""
    spark = batch.sparkSession
    known = latest(_log(spark, f"{out}/done", DONE, number))
    again = known.filter((F.col("status") == "failed") & F.col("source").isNotNull() & (F.col("attempts") < most_attempts))
    new = batch.groupBy("book_id", "chapter").agg(F.max("text").alias("source")).withColumn("attempts", F.lit(0))
    wanted = new.unionByName(again.select("book_id", "chapter", "source", "attempts").join(new.select("book_id", "chapter"), ["book_id", "chapter"], "left_anti"))
    wanted = wanted.withColumn("cache_key", F.when(F.col("source").isNotNull(), F.sha2(F.concat_ws("|", F.lit(version), F.lit(engine), "source"), 256))).persist()
    cache = _log(spark, f"{out}/cache", CACHE, number).select("cache_key", "output").dropDuplicates(["cache_key"])
    missing = wanted.filter("cache_key is not null").groupBy("cache_key").agg(F.first("source").alias("text")).join(cache, "cache_key", "left_anti").persist()
    if missing.isEmpty():
        fresh = spark.createDataFrame([], CACHE)
    else:
        fresh = rewrite(missing).select("cache_key", F.col("text").alias("output")).filter("output is not null")
    fresh.write.mode("overwrite").parquet(f"{out}/cache/batch={number}")
    computed = spark.read.schema(CACHE).parquet(f"{out}/cache/batch={number}").withColumn("cached", F.lit(False))
    every = cache.withColumn("cached", F.lit(True)).unionByName(computed)
    done = wanted.join(every, "cache_key", "left")
    status = F.when(F.col("output").isNull(), "failed").otherwise("ready")
    done = done.select("book_id", "chapter", "source", F.col("output").alias("text"), status.alias("status"), (F.col("attempts") + 1).alias("attempts"), F.coalesce("cached", F.lit(False)).alias("cached"))
    done.write.mode("overwrite").parquet(f"{out}/done/batch={number}")
    wanted.unpersist()
    missing.unpersist()


def rewrite_incrementally(queue: DataFrame, rewrite: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, version: str = "v1", engine: str = "rules", most_attempts: int = 2) -> StreamingQuery:
    """Runs rewrite_batch over what is new in the stream `queue`; a restart goes on where the checkpoint is."""

    def process(batch: DataFrame, number: int) -> None:
        rewrite_batch(batch, number, rewrite, out, version, engine, most_attempts)

    return queue.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(done: DataFrame, chapters: DataFrame) -> DataFrame:
    """book_id, chapters, ready, failed and progress in percent."""
    by = done.groupBy("book_id").agg(F.count_if(F.col("status") == "ready").alias("ready"), F.count_if(F.col("status") == "failed").alias("failed"))
    total = chapters.groupBy("book_id").agg(F.count(F.lit(1)).alias("chapters"))
    n = lambda c: F.coalesce(c, F.lit(0))
    return total.join(by, "book_id", "left").select("book_id", "chapters", n("ready").alias("ready"), n("failed").alias("failed"), F.floor(100 * (n("ready") + n("failed")) / F.col("chapters")).alias("progress"))
