"""Decisions event by event as a stream and as a table, and rewriting of a queue with a cache and retries."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lexispan.streaming import decisions, rewriting

EVENTS = "event_id long, user_id long, ts timestamp_ntz"


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def plain(rows, most, seconds):
    out, kept = {}, {}
    for e, u, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        kept[u] = [k for k in kept.get(u, []) if k > t - dt.timedelta(seconds=seconds)]
        out.setdefault((u, e, t), []).append(len(kept[u]) < most)
        if len(kept[u]) < most:
            kept[u].append(t)
    return out


def decided(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.at, r.event_id)):
        out.setdefault((r.user_id, r.event_id, dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=r.at)), []).append(r.accepted)
    return {k: sorted(v) for k, v in out.items()}


def events(rng, n):
    rows = [(k, rng.choice([1, 1, 1, 2, 3, None]), at(round(rng.random() * 900, 3))) for k in range(n)]
    return [*rows, (n, 1, at(1)), (n + 1, 1, at(1)), (n + 2, 2, at(5000)), (0, 9, at(3)), (0, 9, at(3))]


def test_a_table_is_decided_as_by_a_loop(spark):
    rng = random.Random(4)
    for most, seconds in ((3, 60.0), (1, 7.5), (10, 3600.0)):
        rows = events(rng, 300)
        frame = spark.createDataFrame([*rows, (999, 1, None)], EVENTS)
        got = decided(decisions.decided_table(frame, most, seconds).collect())
        assert got == {k: sorted(v) for k, v in plain(rows, most, seconds).items()}
    assert decisions.decided_table(spark.createDataFrame([], EVENTS)).count() == 0


def test_a_table_is_decided_by_the_batch(spark):
    rng = random.Random(9)
    rows = events(rng, 200)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # stretches go on from batch to batch
    try:
        frame = decisions.decided_table(spark.createDataFrame(rows, EVENTS), 3, 60.0)
        assert decided(frame.collect()) == {k: sorted(v) for k, v in plain(rows, 3, 60.0).items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in frame._jdf.queryExecution().executedPlan().toString()  # a call of Python for each stretch took 254 s on sf0.1


def test_refused_events_do_not_count():
    flags, kept = decisions.accepted_in_turn([0, 1, 2, 60, 61], [], 2, 60)
    assert flags == [True, True, False, True, True] and kept == [60, 61]


def test_a_replayed_stream_decides_as_the_table(spark, tmp_path):
    rng = random.Random(7)
    rows = sorted((r for r in events(rng, 200) if r[1] is not None), key=lambda r: (r[2], r[0]))
    source = f"file://{tmp_path}/in"
    got = []
    for k in range(0, len(rows), 70):  # one file a run, so every run is a batch that finds the state of those before
        spark.createDataFrame(rows[k : k + 70], EVENTS).coalesce(1).write.mode("append").json(source)
        stream = decisions.decided(spark.readStream.schema(EVENTS).json(source), 3, 60.0, "1 hour")
        query = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    got = decided(spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert got == decided(decisions.decided_table(spark.createDataFrame(rows, EVENTS), 3, 60.0).collect())


def test_a_queue_is_rewritten_once_and_failures_are_tried_once_more(spark, tmp_path):
    out, cp, queue = (f"file://{tmp_path}/{x}" for x in ("out", "cp", "queue"))
    seen: list[list[str]] = []

    def rewrite(rows):
        texts = sorted(r.text for r in rows.collect())
        seen.append(texts)
        return rows.withColumn("text", F.when(~F.col("text").startswith("bad") | F.lit(len(seen) > 2), F.upper("text")))

    def run(*rows):
        if rows:
            spark.createDataFrame(rows, rewriting.CHAPTER).coalesce(1).write.mode("append").json(queue)
        stream = spark.readStream.schema(rewriting.CHAPTER).json(queue)
        rewriting.rewrite_incrementally(stream, rewrite, out, cp).awaitTermination()
        return {(r.book_id, r.chapter): (r.text, r.status, r.attempts, r.cached) for r in rewriting.current(spark, out).collect()}

    first = run((1, 1, "a"), (1, 2, None), (2, 1, "a"), (2, 2, "bad"), (2, 2, "bad"))
    assert seen == [["a", "bad"]]
    assert first == {(1, 1): ("A", "ready", 1, False), (1, 2): (None, "failed", 1, False), (2, 1): ("A", "ready", 1, False), (2, 2): (None, "failed", 1, False)}
    assert run() == first and len(seen) == 1  # nothing new: nothing is computed
    second = run((3, 1, "a"))
    assert seen[1:] == [["bad"]] and second[(3, 1)] == ("A", "ready", 1, True) and second[(2, 2)] == (None, "failed", 2, False)
    third = run((3, 2, "c"), (1, 1, "new"))  # two attempts are all that bad has
    assert seen[2:] == [["c", "new"]] and third[(2, 2)][1] == "failed" and third[(1, 1)] == ("NEW", "ready", 1, False) and len(third) == 6
    chapters = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (4, 1)], "book_id long, chapter int")
    done = rewriting.current(spark, out)
    assert {tuple(r) for r in rewriting.progress(done, chapters).collect()} == {(1, 2, 1, 1, 100), (2, 2, 1, 1, 100), (4, 1, 0, 0, 0)}
    # a batch that runs again writes its folder again and sees only those before it
    again = spark.createDataFrame([(3, 1, "a")], rewriting.CHAPTER)
    rewriting.rewrite_batch(again, 1, rewrite, out)
    assert seen[3:] == [["bad"]] and {(r.book_id, r.chapter) for r in rewriting.current(spark, out).collect()} == set(third)
