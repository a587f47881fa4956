"""Queries on reader events, with SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexispan.operators import service as S
from lexispan.streaming import decisions

#: So many accepted events of a user in so many seconds.
MOST, SECONDS = 3, 21_600

_NAMES = {
    "results_by_reader": S.results_by_reader,
    "speed_verdicts": S.speed_verdicts,
    "rolling_summary": S.rolling_summary,
    "daily_views": S.daily_views,
    "top_paths": S.top_paths,
    "latest_states": S.latest_states,
    "cache_retention": S.retained,
    "test_assignments": S.assignments,
    "folded_feedback": S.folded_feedback,
    "axis_scores": S.axis_scores,
    "sliding_counts": S.sliding_counts,
    "reading_sessions": S.sessions,
    "rate_decisions": lambda events: decisions.decided_table(events, MOST, SECONDS),
}


def _query(operator):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(spark.read.parquet(f"{sf_dir}/events.parquet"))

    return run


QUERIES = {name: _query(operator) for name, operator in _NAMES.items()}

_GRADED = "WITH g AS (SELECT * FROM (SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN 'original' ELSE 'rewritten' END AS condition, round(value * 10, 1) AS wpm FROM events WHERE value > 0) WHERE wpm <= 1200)"

ORACLE = {
    "results_by_reader": f"{_GRADED} SELECT user_id, condition, count(*) AS n, ((2 * sum(round(wpm * 10)::BIGINT)::BIGINT + count(*)) // (2 * count(*))) / 10.0::DOUBLE AS mean_wpm FROM g GROUP BY ALL",
    "speed_verdicts": f"""{_GRADED}, p AS (SELECT user_id, avg(wpm) FILTER (condition = 'original') AS o, avg(wpm) FILTER (condition = 'rewritten') AS r FROM g GROUP BY ALL),
 c AS (SELECT user_id, round((r - o) / o * 100)::BIGINT AS change FROM p WHERE o IS NOT NULL AND r IS NOT NULL)
 SELECT user_id, change, CASE WHEN abs(change) < 3 THEN 'same' WHEN change > 0 THEN 'faster' ELSE 'slower' END AS verdict FROM c""",
    "rolling_summary": """WITH r AS (SELECT e.*, d::INT AS window_days FROM events e, (VALUES (7), (30)) w(d) WHERE ts > (SELECT max(ts) FROM events) - to_days(d))
 SELECT window_days, coalesce(event_type, 'all') AS event_type, count(*) AS n, round(avg(value), 2) AS mean_value FROM r GROUP BY GROUPING SETS ((window_days), (window_days, event_type))""",
    "daily_views": "SELECT ts::DATE AS day, '/' || event_type AS path, count(*) AS views, count(DISTINCT user_id) AS readers FROM events GROUP BY ALL",
    "top_paths": "SELECT '/' || event_type || '/' || coalesce(props->>'$.k', 'none') AS path, count(*) AS views FROM events GROUP BY 1 ORDER BY views DESC, path LIMIT 10",
    "latest_states": """SELECT user_id, (arg_max({'t': event_type, 'v': value}, {'ts': ts, 'id': event_id})).t AS last_type, (arg_max({'t': event_type, 'v': value}, {'ts': ts, 'id': event_id})).v AS last_value,
 arg_min(event_type, {'ts': ts, 'id': event_id}) AS first_type, count(*) AS events FROM events GROUP BY user_id""",
    "cache_retention": """WITH k AS (SELECT user_id, event_type, max(ts) AS last_hit, count(*) AS hits FROM events GROUP BY ALL)
 SELECT * FROM k WHERE last_hit >= (SELECT max(ts) FROM events) - INTERVAL 20 DAY ORDER BY last_hit DESC NULLS LAST, user_id, event_type LIMIT 5000""",
    "test_assignments": "SELECT DISTINCT user_id, CASE WHEN left(md5(user_id::VARCHAR), 1) < '8' THEN 'first' ELSE 'second' END AS rewritten_side FROM events",
    "folded_feedback": """WITH l AS (SELECT user_id, props->>'$.k' AS k, arg_max(event_type, {'ts': ts, 'id': event_id}) AS last FROM events WHERE event_type IN ('error', 'click') GROUP BY ALL)
 SELECT user_id, count(*) FILTER (last = 'error') AS triggers, count(*) FILTER (last = 'click') AS safe FROM l GROUP BY user_id""",
    "axis_scores": """WITH a AS (SELECT user_id, avg((value > 50)::INT) AS acc, quantile_cont(value, 0.5) AS med FROM events GROUP BY user_id)
 SELECT user_id, round(least(greatest((acc - 1.0::DOUBLE) / (0.5::DOUBLE - 1.0::DOUBLE) * 100, 0), 100), 1) AS phonological, round(least(greatest((med - 25.0::DOUBLE) / (70.0::DOUBLE - 25.0::DOUBLE) * 100, 0), 100), 1) AS speed FROM a""",
    "sliding_counts": """SELECT time_bucket(INTERVAL 1 DAY, ts) - to_days(k::INT) AS window_start, event_type, count(*) AS n FROM events, range(0, 7) r(k) GROUP BY ALL""",
    "reading_sessions": """WITH l AS (SELECT *, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w) > 30 * 60000000)::INT, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM l) SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM s GROUP BY ALL""",
    "rate_decisions": f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS "at", row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE ts IS NOT NULL AND event_id IS NOT NULL),
 r AS (SELECT user_id, k, event_id, "at", true AS accepted, ["at"] AS kept FROM e WHERE k = 1
  UNION ALL SELECT user_id, k, event_id, "at", len(held) < {MOST}, CASE WHEN len(held) < {MOST} THEN list_append(held, "at") ELSE held END
  FROM (SELECT e.*, list_filter(r.kept, lambda x: x > e."at" - {SECONDS * 1_000_000}) AS held FROM r JOIN e ON e.user_id IS NOT DISTINCT FROM r.user_id AND e.k = r.k + 1))
 SELECT user_id, event_id, "at", accepted FROM r""",
}
