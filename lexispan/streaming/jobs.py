"""Structured Streaming forms of the event jobs: the same aggregates with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame) -> DataFrame:
    """Event times with a zone, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_views(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Views of each path and day; a day is closed once events are `late` past it."""
    day = F.window("ts", "1 day")
    counts = _timed(events).withWatermark("ts", late).groupBy(day.alias("w"), F.concat(F.lit("/"), "event_type").alias("path")).agg(F.count(F.lit(1)).alias("views"))
    return counts.select(F.to_date("w.start").alias("day"), "path", "views")


def once(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events without those whose event_id came before, as long as it isn't older than the watermark."""
    return _timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sliding_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    counts = _timed(events).withWatermark("ts", late).groupBy(F.window("ts", "7 days", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, started, ended and events of reading sessions that end where nothing comes for the gap."""
    counts = _timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.max("ts").alias("ended"), F.count(F.lit(1)).alias("events"))
    return counts.select("user_id", F.col("w.start").alias("started"), "ended", "events")


def finished(events: DataFrame, within: str = "1 day", late: str = "1 hour") -> DataFrame:
    """item_id, started_at and finished_at: starts (event_type start) joined with finishes of the same item that follow in time."""
    timed = _timed(events)
    start = timed.filter("event_type = 'start'").select("item_id", F.col("ts").alias("started_at")).withWatermark("started_at", late)
    finish = timed.filter("event_type = 'finish'").select(F.col("item_id").alias("f_id"), F.col("ts").alias("finished_at")).withWatermark("finished_at", late)
    return start.join(finish, F.expr(f"item_id = f_id and finished_at >= started_at and finished_at <= started_at + interval {within}")).drop("f_id")
