"""Structures on intervals [start, end): islands of what overlaps, choices that depend on earlier ones, and runs of equal neighbours.

Choices that depend on earlier ones are folds over an ordered array. Intervals of different islands never meet, so a fold only
sees one island, which holds the few intervals that cover one another, and not a whole sentence or document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def islands(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """rows with island: intervals of equal keys have one number if a chain of overlaps connects them; touching ends don't overlap."""
    order = Window.partitionBy(*keys).orderBy(start, F.desc(end))
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(before <= F.col(start), F.lit(True)).cast("long")
    return rows.withColumn("begins", begins).withColumn("island", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("begins")


def first_come(rows: DataFrame, keys: list[str], order: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """The rows that are taken when they are tried in `order` and one that overlaps a taken one is refused.

    What was refused takes nothing, so a row whose only rival was itself refused is taken. Rows of an empty or null interval, or whose keys
    are equal in all of `order`, are tried in the order of their other columns; every column must be of a type that can be ordered."""
    lead = list(dict.fromkeys([*order, start, end]))
    columns = [*lead, *(c for c in rows.columns if c not in lead and c not in keys)]
    held = islands(rows, keys, start, end).groupBy(*keys, "island").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("tried"))
    free = lambda taken, x: ~F.exists(taken, lambda t: (t[start] < x[end]) & (x[start] < t[end]))
    taken = F.aggregate("tried", F.slice("tried", 1, 0), lambda so_far, x: F.when(free(so_far, x), F.concat(so_far, F.array(x))).otherwise(so_far))
    one = F.when(F.size("tried") == 1, F.col("tried")).otherwise(taken)
    return held.select(*keys, F.inline(one)).select(*rows.columns)


def runs(rows: DataFrame, keys: list[str], order: str, label: Column, begins: Column | None = None) -> DataFrame:
    """rows with a label that isn't null, and run: neighbours of one label share a number; where `begins` holds a new run starts."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("label", label)
    new = ~F.col("label").eqNullSafe(F.lag("label").over(w))
    if begins is not None:
        new = new | F.coalesce(begins, F.lit(False))
    marked = marked.withColumn("new", new.cast("long"))
    return marked.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new").filter("label is not null")
