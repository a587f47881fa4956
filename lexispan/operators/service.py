"""Reader events: tests, feedback, page views and states, over an event table (event_id, ts, user_id, event_type, value, props)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def anchored_score(value: Column, zero: float, full: float) -> Column:
    """0 at one anchor, 100 at the other, straight between them and clipped outside."""
    return F.least(F.greatest((value - zero) / (full - zero) * 100, F.lit(0.0)), F.lit(100.0))


def graded(events: DataFrame, most_wpm: float = 1200.0) -> DataFrame:
    """user_id, condition (by parity of event_id) and wpm of every plausible reading."""
    condition = F.when(F.col("event_id") % 2 == 0, "original").otherwise("rewritten")
    rows = events.filter("value > 0").select("event_id", "user_id", condition.alias("condition"), F.round(F.col("value") * 10, 1).alias("wpm"))
    return rows.filter(F.col("wpm") <= most_wpm)


def results_by_reader(events: DataFrame) -> DataFrame:
    by = graded(events).groupBy("user_id", "condition")
    # in whole tenths, so that the sum is exact in any order, and halves are rounded up
    sums = by.agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("wpm") * 10).cast("long")).alias("tenths"))
    return sums.select("user_id", "condition", "n", (F.expr("(2 * tenths + n) div (2 * n)") / 10.0).alias("mean_wpm"))


def speed_verdicts(events: DataFrame) -> DataFrame:
    """user_id, change of speed in percent and what it says; readers with both conditions only."""
    by = graded(events).groupBy("user_id").pivot("condition", ["original", "rewritten"]).agg(F.avg("wpm"))
    change = F.round((F.col("rewritten") - F.col("original")) / F.col("original") * 100).cast("long")
    rows = by.filter("original is not null and rewritten is not null").select("user_id", change.alias("change"))
    return rows.withColumn("verdict", F.when(F.abs("change") < 3, "same").when(F.col("change") > 0, "faster").otherwise("slower"))


def rolling_summary(events: DataFrame, days: tuple[int, ...] = (7, 30)) -> DataFrame:
    """window_days, event_type (all for the total), n and mean value up to the last event: one pass over the events."""
    last = events.agg(F.max("ts").alias("last"))
    rows = events.crossJoin(F.broadcast(last)).withColumn("window_days", F.explode(F.array(*[F.lit(d) for d in days])))
    rows = rows.filter(F.col("ts") > F.col("last") - F.make_dt_interval(F.col("window_days")))
    out = rows.groupingSets([["window_days"], ["window_days", "event_type"]], "window_days", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 2).alias("mean_value"))
    return out.select("window_days", F.coalesce("event_type", F.lit("all")).alias("event_type"), "n", "mean_value")


def daily_views(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("ts").alias("day"), F.concat(F.lit("/"), "event_type").alias("path")).agg(F.count(F.lit(1)).alias("views"), F.countDistinct("user_id").alias("readers"))


def top_paths(events: DataFrame, n: int = 10) -> DataFrame:
    """The paths (type and first props value) seen most; ties by path."""
    path = F.concat(F.lit("/"), "event_type", F.lit("/"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("none")))
    return events.groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("views")).orderBy(F.desc("views"), "path").limit(n)


def latest_states(events: DataFrame) -> DataFrame:
    """Each user's last event and first one of all, by time and event_id."""
    last = F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id"))
    out = events.groupBy("user_id").agg(last.alias("l"), F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"), F.count(F.lit(1)).alias("events"))
    return out.select("user_id", F.col("l.event_type").alias("last_type"), F.col("l.value").alias("last_value"), "first_type", "events")


def retained(events: DataFrame, days: int = 20, most: int = 5000) -> DataFrame:
    """user_id and event_type keys whose last use is within so many days of the last event; beyond `most`, the oldest go.

    The bound on rows is what this retention rule is about."""
    keys = events.groupBy("user_id", "event_type").agg(F.max("ts").alias("last_hit"), F.count(F.lit(1)).alias("hits"))
    last = events.agg(F.max("ts").alias("last"))
    fresh = keys.crossJoin(F.broadcast(last)).filter(F.col("last_hit") >= F.col("last") - F.make_dt_interval(F.lit(days))).drop("last")
    return fresh.orderBy(F.desc_nulls_last("last_hit"), "user_id", "event_type").limit(most)


def assignments(events: DataFrame) -> DataFrame:
    """user_id and the side that a digest of the id picks for the rewritten text."""
    side = F.when(F.substring(F.md5(F.col("user_id").cast("string")), 1, 1).isin(*"01234567"), "first").otherwise("second")
    return events.select("user_id").distinct().select("user_id", side.alias("rewritten_side"))


def folded_feedback(events: DataFrame) -> DataFrame:
    """user_id, triggers and safe words: the latest of error and click on each key of a user decides; errors trigger."""
    key = F.get_json_object("props", "$.k")
    latest = events.filter(F.col("event_type").isin("error", "click")).groupBy("user_id", key.alias("k")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return latest.groupBy("user_id").agg(F.count_if(F.col("last") == "error").alias("triggers"), F.count_if(F.col("last") == "click").alias("safe"))


def axis_scores(events: DataFrame) -> DataFrame:
    """Support scores of each user's values by type, on anchors taken from the task: accuracy and response time."""
    by = events.groupBy("user_id").agg(F.avg((F.col("value") > 50).cast("double")).alias("accuracy"), F.percentile("value", F.lit(0.5)).alias("median_value"))
    return by.select("user_id", F.round(anchored_score(F.col("accuracy"), 1.0, 0.5), 1).alias("phonological"), F.round(anchored_score(F.col("median_value"), 25.0, 70.0), 1).alias("speed"))


def sliding_counts(events: DataFrame) -> DataFrame:
    """Events of each type in windows of 7 days that start every day."""
    return events.groupBy(F.window("ts", "7 days", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """user_id, session number, start, end and events: a session ends where nothing comes for the gap."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce((F.col("ts") - F.lag("ts").over(w) > F.make_dt_interval(mins=F.lit(gap_minutes))).cast("int"), F.lit(1))
    numbered = events.withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return numbered.groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("events"))
