"""Typed tables of the service read into the event table, and queries on them.

The given data has one table of events; here its columns are read as what the operators ask for: a click is a bug report,
a view an idea, and so on. Every event is used in every table that takes its type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.operators import battery as B
from lexispan.operators import readers as R
from lexispan.operators import states as S

AS_OF = "2024-01-31"
#: What an event's type stands for (fixed values of this mapping).
KIND = {"click": "bug", "view": "idea", "error": "question", "purchase": "praise"}
BILLING = {"click": "updated", "view": "updated", "purchase": "invoice_paid", "error": "invoice_failed"}
PAIRS = ("p0", "p1", "p2")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def _named(column: str, names: dict[str, str], other: str):
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.col(column)), F.lit(other))


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    status = F.when(F.col("k") % 3 == 0, "new").when(F.col("k") % 3 == 1, "seen").otherwise("done")
    return e.select(F.col("event_id").alias("id"), "user_id", _named("event_type", KIND, "tripped").alias("kind"), status.alias("status"), F.col("ts").alias("created_at"), (F.floor("value") % 5 + 1).alias("rating"))


def feedback_rolling_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.feedback_summary(_feedback(spark, sf_dir), AS_OF)


def page_view_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    referrer = F.concat(F.lit("https://H"), (F.col("user_id") % 4).cast("string"), F.lit(".example:8080/x"))
    e = _events(spark, sf_dir).select("ts", F.concat_ws("/", "event_type", F.col("k").cast("string")).alias("path"), F.when(F.col("user_id") % 5 > 0, referrer).alias("referrer"))
    return S.page_views(e)


def newsletter_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).filter("event_type in ('click', 'view', 'error')")
    email = F.concat(F.lit(" U"), F.col("user_id").cast("string"), F.lit("@Mail.example "))
    kind = F.when(F.col("event_type") == "error", "unsubscribe").otherwise("signup")
    return S.newsletter_states(e.select(email.alias("email"), F.struct("ts", "event_id").alias("at"), kind.alias("kind"), F.col("event_type").alias("source"))).select("email", "source", F.col("created_at.ts").alias("created_at"), F.col("unsubscribed_at.ts").alias("unsubscribed_at"))


def _billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    status = F.when(F.col("event_type").isin("click", "view"), F.when(F.col("k") % 4 == 3, "canceled").otherwise("active"))
    return e.select("event_id", F.col("ts").alias("at"), _named("event_type", BILLING, "deleted").alias("type"), F.col("user_id").alias("subscription_id"), "user_id", status.alias("status"), (F.col("ts") + F.make_dt_interval(F.lit(7))).alias("period_end"))


def subscription_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.subscription_states(_billing(spark, sf_dir))


def quota_at_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan that was in force at each click, from the purchases (seven days) and errors (free) before it."""
    e = _events(spark, sf_dir)
    states = e.filter("event_type in ('purchase', 'error')").select("user_id", F.col("ts").alias("at"), F.when(F.col("event_type") == "purchase", "pro").otherwise("free").alias("plan"), (F.col("ts") + F.make_dt_interval(F.lit(7))).alias("plan_until"))
    last = states.groupBy("user_id", "at").agg(F.max(F.struct("plan", "plan_until")).alias("s")).select("user_id", "at", "s.*")
    return S.plan_at(e.filter("event_type = 'click'").select("event_id", "user_id", F.col("ts").alias("at")), last).select("event_id", "user_id", "pro", F.col("word_limit").cast("long").alias("word_limit"))


def recording_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    mime = F.when(F.col("event_type") == "error", "text/plain").otherwise("audio/webm")
    r = e.select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"), mime.alias("mime"), (F.col("value") * 300_000).alias("bytes"), (F.col("value") * 10).alias("seconds"))
    return S.admitted_recordings(r).groupBy("user_id", F.coalesce("reason", F.lit("admitted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def library_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    plan = F.when(F.col("user_id") % 2 == 0, "pro").otherwise("free")
    return S.library_status(e.select("user_id", plan.alias("plan"), F.col("event_type").alias("status"), F.floor(F.col("value") * 1000).alias("words"), F.col("k").alias("chapters"), (F.col("k") % 101).alias("progress"), F.lit(0.0).alias("cost_usd"))).drop("cost_usd")


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _events(spark, sf_dir).filter("value > 0")
    condition = F.when(F.col("event_id") % 2 == 0, "original").otherwise("rewritten")
    answers = F.create_map(F.lit("q1"), F.col("k") % 3, F.lit("q2"), F.col("k") % 2)
    items = e.select(
        F.col("event_id").alias("item_id"), "user_id", (F.col("k") % 2).alias("passage_id"), condition.alias("condition"), F.lit(250).alias("words"), (F.col("value") * 2).alias("seconds"),
        answers.alias("answers"), F.array(F.upper("event_type"), F.lit(" "), F.col("event_type")).alias("tripped"), F.col("ts").alias("recorded_at"),
    )
    passages = spark.range(2).select(F.col("id").alias("passage_id"), F.create_map(F.lit("q1"), F.col("id"), F.lit("q2"), F.col("id")).alias("answers"))
    return R.graded_items(items, passages)


def test_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.results(_items(spark, sf_dir)[0])


def comprehension_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.speed_changes(R.results(_items(spark, sf_dir)[0]))


def site_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.site_results(_items(spark, sf_dir)[0])


def rejected_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def next_test_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    pairs = spark.createDataFrame([(k, p) for k, p in enumerate(PAIRS)], "place int, pair string")
    had = e.filter("event_type = 'purchase'").select("user_id", F.concat(F.lit("p"), (F.col("k") % 4).cast("string")).alias("pair"))
    return R.next_pairs(e, pairs, had)


def reader_word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).filter("event_type in ('error', 'click', 'view')")
    kind = F.when(F.col("event_type") == "error", "tripped").when(F.col("event_type") == "click", "safe").otherwise("remove")
    f = e.select("user_id", F.struct("ts", "event_id").alias("at"), kind.alias("kind"), F.concat(F.lit(" W"), F.col("k").cast("string")).alias("word"), F.lit(None).cast("string").alias("put"))
    return R.folded_feedback(f).select("user_id", F.array_join("trigger_words", " ").alias("trigger_words"), F.array_join("safe_words", " ").alias("safe_words"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each reader: errors and clicks are trials of the two choice tasks, views times of words, k a digit span."""
    e = _events(spark, sf_dir)
    trial = F.struct(F.col("event_id").cast("string").alias("id"), (F.col("value") > 30).alias("correct"), F.when(F.col("k") % 7 > 0, F.col("value") * 40).alias("rt_ms"))
    of = lambda t, x: F.array_sort(F.collect_list(F.when(F.col("event_type") == t, F.struct("event_id", x.alias("x")))))
    by = e.groupBy("user_id").agg(of("error", trial).alias("c"), of("click", trial).alias("d"), of("view", F.col("value") * 10).alias("w"), F.max(F.col("k") % 8).cast("int").alias("digits"))
    xs = lambda c: F.transform(c, lambda t: t.x)
    probe = F.array(F.struct(F.lit("none").alias("condition"), xs("w").alias("word_rts")))
    raw = F.to_json(F.struct(F.struct(xs("c").alias("trials")).alias("orthographic_choice"), F.struct(xs("d").alias("trials")).alias("pseudohomophone"), F.struct(probe.alias("trials")).alias("heteronym"), F.struct(F.col("digits").alias("span")).alias("digit_span")))
    return by.select(F.col("user_id").alias("run_id"), "user_id", raw.alias("raw"))


def battery_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.score_battery(_runs(spark, sf_dir)).select("run_id", "phonological", "orthographic", "rate", "attention", "vas_confidence")


def battery_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.mean_support(B.score_battery(_runs(spark, sf_dir)).filter("phonological_confidence = 'normal'")).filter("axis in ('orthographic', 'attention')")


def site_pulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pulse(feedback_rolling_summary(spark, sf_dir), site_results(spark, sf_dir), battery_means(spark, sf_dir))


_E = "e AS (SELECT *, (props->>'$.k')::BIGINT AS k FROM events)"
_ITEMS = f"""{_E}, g AS (SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN 'original' ELSE 'rewritten' END AS condition, round(250 / (value * 2 / 60), 1) AS wpm,
 (k % 3 = k % 2)::INT + 1 AS correct FROM e WHERE value > 0), ok AS (SELECT * FROM g WHERE wpm <= 1200),
 r AS (SELECT user_id, condition, count(*) AS n, round(avg(wpm), 1) AS mean_wpm, round(100 * avg(correct / 2), 1) AS comprehension FROM ok GROUP BY ALL)"""
_SUP = "least(greatest(({0} - {1}) / ({2} - {1}) * 100, 0), 100)"
_CHOICE = "least(100, {} + coalesce({}, 0) / 100 * 15)".format(_SUP.format("avg((value > 30)::INT)", "1.0::DOUBLE", "0.5::DOUBLE"), _SUP.format("median(value * 40) FILTER (k % 7 > 0 AND value > 0)", "800.0::DOUBLE", "3000.0::DOUBLE"))
_BATTERY = f"""{_E}, c AS (SELECT user_id, {_CHOICE} AS s FROM e WHERE event_type = 'error' GROUP BY user_id), d AS (SELECT user_id, {_CHOICE} AS s FROM e WHERE event_type = 'click' GROUP BY user_id),
 w AS (SELECT user_id, {_SUP.format("median(value * 10)", "250.0::DOUBLE", "700.0::DOUBLE")} AS s FROM e WHERE event_type = 'view' AND value > 0 GROUP BY user_id),
 a AS (SELECT user_id, {_SUP.format("max(k % 8)", "6.0::DOUBLE", "3.0::DOUBLE")} AS s FROM e GROUP BY user_id),
 b AS (SELECT a.user_id AS run_id, round_even(coalesce(d.s, 0), 1) AS phonological, d.s IS NOT NULL AS sure, round_even(coalesce(c.s, 0), 1) AS orthographic, round_even(coalesce(w.s, 0), 1) AS rate, round_even(coalesce(a.s, 0), 1) AS attention, 'low' AS vas_confidence
 FROM a LEFT JOIN c ON a.user_id = c.user_id LEFT JOIN d ON a.user_id = d.user_id LEFT JOIN w ON a.user_id = w.user_id)"""

ORACLE = {
    "feedback_rolling_summary": f"""WITH {_E}, f AS (SELECT event_id, ts, CASE event_type WHEN 'click' THEN 'bug' WHEN 'view' THEN 'idea' WHEN 'error' THEN 'question' WHEN 'purchase' THEN 'praise' ELSE 'tripped' END AS kind,
 CASE k % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'seen' ELSE 'done' END AS status, floor(value)::BIGINT % 5 + 1 AS rating FROM e),
 r AS (SELECT f.*, d::INT AS window_days FROM f, (VALUES (7), (30)) w(d) WHERE ts > TIMESTAMP '{AS_OF}' - to_days(d) AND ts <= TIMESTAMP '{AS_OF}')
 SELECT window_days, coalesce(kind, 'all') AS kind, coalesce(status, 'all') AS status, count(*) AS n, round(avg(rating), 2) AS mean_rating FROM r GROUP BY GROUPING SETS ((window_days), (window_days, kind), (window_days, status))""",
    "page_view_counts": f"""WITH {_E} SELECT ts::DATE AS day, '/' || event_type || coalesce('/' || k::VARCHAR, '') AS path, CASE WHEN user_id % 5 > 0 THEN 'h' || (user_id % 4) || '.example' ELSE '' END AS referrer_host, count(*) AS views FROM e GROUP BY ALL""",
    "newsletter_states": """WITH s AS (SELECT 'u' || user_id || '@mail.example' AS email, event_type AS source, ts, event_id FROM events WHERE event_type IN ('click', 'view', 'error'))
 SELECT email, arg_min(source, {'t': ts, 'i': event_id}) FILTER (source <> 'error') AS source, min(ts) FILTER (source <> 'error') AS created_at,
 CASE WHEN arg_max(source, {'t': ts, 'i': event_id}) = 'error' THEN max(ts) END AS unsubscribed_at FROM s GROUP BY email HAVING min(ts) FILTER (source <> 'error') IS NOT NULL""",
    "subscription_states": f"""WITH {_E}, b AS (SELECT user_id, ts, event_id, event_type IN ('click', 'view', 'purchase', 'error') AS kept, CASE WHEN event_type IN ('click', 'view') THEN CASE WHEN k % 4 = 3 THEN 'canceled' ELSE 'active' END
  WHEN event_type = 'purchase' THEN 'active' WHEN event_type = 'error' THEN 'past_due' ELSE 'canceled' END AS now FROM e),
 l AS (SELECT user_id, arg_max(now, {{'t': ts, 'i': event_id}}) AS status, max(ts) FILTER (kept) AS last FROM b GROUP BY user_id)
 SELECT user_id AS subscription_id, user_id, status, CASE WHEN status IN ('active', 'past_due') THEN 'pro' ELSE 'free' END AS plan, CASE WHEN status IN ('active', 'past_due') THEN last + INTERVAL 10 DAY END AS plan_until FROM l""",
    "quota_at_events": """WITH s AS (SELECT user_id, ts, max(CASE WHEN event_type = 'purchase' THEN 'pro' ELSE 'free' END) AS plan FROM events WHERE event_type IN ('purchase', 'error') GROUP BY ALL),
 c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), j AS (SELECT c.*, s.plan, s.ts AS since FROM c ASOF LEFT JOIN s ON c.user_id = s.user_id AND c.ts >= s.ts)
 SELECT event_id, user_id, coalesce(plan = 'pro' AND since + INTERVAL 7 DAY > ts, false) AS pro, CASE WHEN plan = 'pro' AND since + INTERVAL 7 DAY > ts THEN 300000 ELSE 60000 END::BIGINT AS word_limit FROM j""",
    "recording_admission": """WITH r AS (SELECT *, CASE WHEN event_type = 'error' THEN 'type' WHEN value * 300000 > 26214400 THEN 'size' WHEN value * 10 > 900 THEN 'length' END AS bad FROM events),
 n AS (SELECT *, count(*) FILTER (bad IS NULL) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM r)
 SELECT user_id, coalesce(bad, CASE WHEN n > 50 THEN 'full' END, 'admitted') AS reason, count(*) AS n FROM n GROUP BY ALL""",
    "library_status": f"""WITH {_E}, b AS (SELECT user_id, CASE WHEN floor(value * 1000) > CASE WHEN user_id % 2 = 0 THEN 300000 ELSE 60000 END THEN 'rejected' ELSE event_type END AS status, floor(value * 1000)::BIGINT AS words, k FROM e)
 SELECT user_id, status, count(*) AS books, sum(words)::BIGINT AS words, sum(k)::BIGINT AS chapters, round(avg(k % 101), 1) AS progress FROM b GROUP BY ALL""",
    "test_results": f"WITH {_ITEMS} SELECT * FROM r",
    "comprehension_verdicts": f"""WITH {_ITEMS}, p AS (SELECT o.user_id, round((w.mean_wpm - o.mean_wpm) / o.mean_wpm * 100)::BIGINT AS change, round(w.comprehension - o.comprehension, 1) AS comprehension_change
 FROM r o JOIN r w ON o.user_id = w.user_id AND o.condition = 'original' AND w.condition = 'rewritten') SELECT *, CASE WHEN abs(change) < 3 THEN 'same' WHEN change > 0 THEN 'faster' ELSE 'slower' END AS verdict FROM p""",
    "site_results": f"WITH {_ITEMS} SELECT condition, round(avg(wpm), 1) AS mean_wpm, count(*) AS n FROM ok GROUP BY ALL",
    "rejected_items": f"WITH {_ITEMS} SELECT 'too_fast' AS reason, count(*) AS n FROM g WHERE wpm > 1200 HAVING count(*) > 0",
    "next_test_pairs": f"""WITH {_E}, h AS (SELECT user_id, list(DISTINCT 'p' || (k % 4)) FILTER (event_type = 'purchase') AS had, count(*) FILTER (event_type = 'purchase') AS n FROM e GROUP BY user_id)
 SELECT user_id, coalesce(list_filter(['p0', 'p1', 'p2'], lambda p: NOT list_contains(coalesce(had, []), p))[1], ['p0', 'p1', 'p2'][n % 3 + 1]) AS pair FROM h""",
    "reader_word_lists": f"""WITH {_E}, l AS (SELECT user_id, 'w' || k AS word, arg_max(event_type, {{'t': ts, 'i': event_id}}) AS last FROM e WHERE event_type IN ('error', 'click', 'view') GROUP BY ALL)
 SELECT user_id, coalesce(string_agg(word, ' ' ORDER BY word) FILTER (last = 'error'), '') AS trigger_words, coalesce(string_agg(word, ' ' ORDER BY word) FILTER (last = 'click'), '') AS safe_words FROM l GROUP BY user_id""",
    "battery_scores": f"WITH {_BATTERY} SELECT run_id, phonological, orthographic, rate, attention, vas_confidence FROM b",
    "battery_means": f"""WITH {_BATTERY} SELECT 'orthographic' AS axis, round(avg(orthographic), 1) AS mean_support, count(*) AS runs FROM b WHERE sure HAVING count(*) > 0
 UNION ALL SELECT 'attention', round(avg(attention), 1), count(*) FROM b WHERE sure HAVING count(*) > 0""",
}

QUERIES = {
    f.__name__: f
    for f in (
        feedback_rolling_summary, page_view_counts, newsletter_states, subscription_states, quota_at_events, recording_admission, library_status, test_results, comprehension_verdicts, site_results,
        rejected_items, next_test_pairs, reader_word_lists, battery_scores, battery_means, site_pulse,
    )
}
