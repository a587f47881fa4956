"""Mixing sources to target weights by entropy balancing.

Sources get targets in words: shares by weight of a wanted total, never above a multiple of their own size, the
excess being shared again by weight. Inside a source, document rates r minimise the relative entropy to 1 under
the constraint that sum(size * r) is the target and r stays at most `most`; the dual has one number per source and
the solution is exponentially tilted, r = min(most, exp(lambda * size / mean size)). Newton's iterations run on a
table of (source, size, documents), each a join with the sources' numbers and an aggregation; a bracket
around each root makes a step that leaves it a bisection. Rates are then rounded to whole copies: documents of
a source are dealt to shards of some thousands by hash, and inside a shard, by falling size, what rounding
leaves over is carried to the next document, so that small documents even out what large ones left.

Defined results: a null text has size 0; a null source is a source and comes last; documents of size 0 are taken
once for words' sake and add nothing; repeated rows are documents of their own; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, mapped, text_or_empty, written

SHARD_ROWS = 4000
TOLERANCE = 1e-9
MAX_STEPS = 200


def size_in_words(text: Column) -> Column:
    return F.size(F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+")).cast("long") - F.when(text.rlike(WORD), 0).otherwise(1)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), total_share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, documents and target: level water, filled into sources whose height is most * size / weight."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    # one row for each source: their number, not the data's, is what one task sorts here
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(rank, F.lit(len(weights)))))
    cap = most * F.col("source_size")
    order = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    by = by.withColumns({"cap": cap, "wanted": total_share * F.sum("source_size").over(whole), "full": F.sum(cap).over(order), "passed": F.sum("weight").over(order), "all_weights": F.sum("weight").over(whole)})
    # the sources up to here are full if the level that would then be needed lies above this one's height
    level = (F.col("wanted") - F.col("full") + F.col("cap")) / (F.col("all_weights") - F.col("passed") + F.col("weight"))
    by = by.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("h"), F.col("level").alias("level")))).over(whole).getField("level")
    return by.withColumn("target", F.least(F.col("cap"), F.coalesce(first, F.lit(math.inf)) * F.col("weight"))).select("source", "source_size", "documents", "target")


def tilts(sizes: DataFrame, goals: DataFrame, most: float = 2.0) -> DataFrame:
    """source and lambda; lambda is infinite where every document has the highest rate."""
    moments = written(sizes.groupBy(F.col("source").alias("m_source"), "size").agg(F.count(F.lit(1)).alias("n")), "moments")
    open_end = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    state = goals.select(
        "source", "target", (F.col("source_size") / F.col("documents")).alias("scale"), F.lit(0.0).alias("tilt"), F.lit(-math.inf).alias("low"), F.lit(math.inf).alias("high"), open_end.alias("done")
    )
    state = written(state.withColumn("tilt", F.when(F.col("done"), F.lit(math.inf)).otherwise(F.col("tilt"))), "tilts")
    for _ in range(MAX_STEPS):
        x = F.col("size") / F.col("scale")
        rate = F.exp(F.least(F.col("tilt") * x, F.lit(700.0)))
        joined = moments.join(F.broadcast(state) if state.count() <= 10_000 else state, moments["m_source"].eqNullSafe(state["source"])).filter("not done")
        sums = joined.groupBy(F.col("source").alias("s")).agg(
            F.sum(F.col("n") * F.col("size") * F.least(rate, F.lit(most))).alias("got"), F.sum(F.when(rate < most, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("slope")
        )
        gap = F.col("got") - F.col("target")
        step = F.col("tilt") - gap / F.col("slope")
        low, high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        # inside the bracket Newton's step counts; else halve it, or reach out where one end is open
        halved = F.when(low == -math.inf, F.col("tilt") - 2 * F.greatest(F.abs("tilt"), F.lit(1.0))).when(high == math.inf, F.col("tilt") + 2 * F.greatest(F.abs("tilt"), F.lit(1.0))).otherwise((low + high) / 2)
        moved = F.when((F.col("slope") > 0) & (step > low) & (step < high), step).otherwise(halved)
        close = F.abs(gap) <= TOLERANCE * F.col("target") + 1e-6
        stuck = F.col("got").isNull()
        new = state.join(sums, state["source"].eqNullSafe(sums["s"]), "left").select(
            "source", "target", "scale",
            F.when(F.col("done") | stuck | close, F.col("tilt")).otherwise(moved).alias("tilt"),
            F.when(stuck, F.col("low")).otherwise(low).alias("low"), F.when(stuck, F.col("high")).otherwise(high).alias("high"),
            (F.col("done") | stuck | F.coalesce(close, F.lit(False))).alias("done"),
        )
        state = written(new, "tilts")
        if not state.filter("not done").limit(1).count():
            return state.select("source", "tilt", "scale")
    raise ValueError(f"no tilt within {MAX_STEPS} steps for some source")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), total_share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and row (a number of the row of docs) for each row of docs."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_in_words(text_or_empty()).alias("size"), F.xxhash64("text").alias("text_hash"))
    sizes = written(sized, "sizes")
    goals = written(targets(sizes, weights, total_share, most), "targets")
    found = tilts(sizes, goals, most)
    known = goals.join(found.select(F.col("source").alias("t"), "tilt", "scale"), F.col("source").eqNullSafe(F.col("t"))).drop("t").withColumnRenamed("source", "g")
    rated = sizes.join(F.broadcast(known) if known.count() <= 10_000 else known, sizes["source"].eqNullSafe(F.col("g"))).drop("g")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("tilt") == math.inf, F.lit(most)).otherwise(F.least(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(700.0))), F.lit(most)))
    shard = F.pmod(F.xxhash64("doc_id", "text_hash"), F.greatest(F.ceil(F.col("documents") / SHARD_ROWS), F.lit(1)))
    dealt = rated.withColumns({"rate": rate, "shard": shard}).repartition("source", "shard").sortWithinPartitions("source", "shard", F.desc("size"), "doc_id", "text_hash")
    return rounded(dealt.select("doc_id", "size", "source_size", "target", "source", "shard", "rate", "text_hash"), most)


def rounded(dealt: DataFrame, most: float) -> DataFrame:
    """Whole copies for the rates, carrying what is left over along each sorted shard."""
    schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("source_size", pa.int64()), ("target", pa.float64()), ("taken", pa.int64()), ("copies", pa.int64()), ("text_hash", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, carry = None, 0.0
        for batch in batches:
            copies = []
            for source, shard, size, rate in zip(*(batch.column(c).to_pylist() for c in ("source", "shard", "size", "rate")), strict=True):
                if (source, shard) != key:
                    key, carry = (source, shard), 0.0
                if size:
                    n = min(int(most), max(0, math.floor(rate + carry / size + 0.5)))
                    carry += (rate - n) * size
                else:
                    n = 1
                copies.append(n)
            n, size = pa.array(copies, pa.int64()), batch.column("size")
            taken = pa.array([c * s for c, s in zip(copies, size.to_pylist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, batch.column("source_size"), batch.column("target"), taken, n, batch.column("text_hash")], schema=schema)

    return mapped(dealt, run, "doc_id long, size long, source_size long, target double, taken long, copies long, text_hash long")


def take_mixed(docs: DataFrame, **mixing) -> DataFrame:
    """docs with every row as often as the mix takes it; equal rows are dealt their copies in any order."""
    plan = mix(docs, **mixing)
    share = plan.groupBy("doc_id", "text_hash").agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows")).withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    joined = docs.join(share, on)
    # rows that are equal in doc_id and text share their copies evenly, the rest going to the first
    number = F.row_number().over(Window.partitionBy("__id", "__hash").orderBy(F.lit(1)))
    single = joined.filter("__rows = 1").withColumn("__n", F.col("__copies"))
    several = joined.filter("__rows > 1").withColumn("__n", F.floor(F.col("__copies") / F.col("__rows")) + (number <= F.col("__copies") % F.col("__rows")).cast("long"))
    taken = single.unionByName(several).filter("__n > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select(*docs.columns)
