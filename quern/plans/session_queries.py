"""Session, debounce and metric queries over events: the user is the session, the key in props the node."""

from pyspark.sql import functions as F

from quern.operators import metrics as ME
from quern.operators import sessions as SE
from quern.queries import query, table

_ACTION = {"view": "visit", "click": "frontier", "error": "reason", "signup": "annotate"}
_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ACTION.items()) + " ELSE 'other' END"
LOG = f"log AS (SELECT user_id::VARCHAR AS session_id, event_id AS seq, ts, {_CASE} AS action, json_extract_string(props, '$.k') AS node_id, value AS priority, props AS text FROM events)"
CAP = 40


def session_log(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), "ts", F.expr(_CASE).alias("action"),
        F.get_json_object("props", "$.k").alias("node_id"), F.col("value").alias("priority"), F.col("props").alias("text"),
    )


_V = f"""v AS (SELECT session_id, node_id, min(seq) AS first_seq, max(seq) AS last_visit FROM log WHERE action = 'visit' AND node_id IS NOT NULL GROUP BY ALL),
vis AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first_seq, node_id) AS n FROM v)"""
_F = f"""fr AS (SELECT l.session_id, l.node_id, max(coalesce(l.priority, 1.0)) AS priority FROM log l LEFT JOIN vis USING (session_id, node_id)
WHERE l.action = 'frontier' AND l.node_id IS NOT NULL AND (vis.n IS NULL OR (vis.n > {{cap}} AND l.seq > vis.last_visit)) GROUP BY ALL)"""


@query(f"WITH {LOG}, {_V} SELECT session_id, node_id, first_seq FROM vis WHERE n <= {CAP}")
def session_visited_cap(spark, sf):
    return SE.visited(session_log(spark, sf), CAP)


@query(f"WITH {LOG}, {_V}, {_F.format(cap=CAP)} SELECT * FROM (SELECT session_id, node_id, priority, row_number() OVER (PARTITION BY session_id ORDER BY priority DESC, node_id)::INT AS rank FROM fr) WHERE rank <= 10")
def session_frontier_top10(spark, sf):
    return SE.frontier_top(session_log(spark, sf), 10, CAP)


@query(f"WITH {LOG} SELECT * FROM (SELECT session_id, seq, text, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC)::INT AS rank FROM log WHERE action = 'reason') WHERE rank <= 10")
def session_recent10(spark, sf):
    return SE.recent_log(session_log(spark, sf), 10)


@query(f"WITH {LOG} SELECT session_id, node_id, arg_max(text, seq) AS note FROM log WHERE action = 'annotate' AND node_id IS NOT NULL GROUP BY ALL")
def session_annotations(spark, sf):
    return SE.annotations(session_log(spark, sf))


@query(f"""WITH {LOG}, {_V}, {_F.format(cap=10000)}
SELECT session_id, min(ts) AS created_at, max(ts) AS last_accessed_at, least(count(*) FILTER (action = 'reason'), 1000) AS log_count,
  (SELECT count(*) FROM vis WHERE vis.session_id = log.session_id AND n <= 10000) AS visited_count, (SELECT count(*) FROM fr WHERE fr.session_id = log.session_id) AS frontier_count,
  (SELECT count(DISTINCT node_id) FROM log a WHERE a.session_id = log.session_id AND action = 'annotate') AS annotation_count FROM log GROUP BY session_id""")
def session_summary(spark, sf):
    return SE.summary(session_log(spark, sf))


#: The last state of the session stream of plans.pipeline_queries.
STREAM = f"""WITH {LOG}, {_V}, {_F.format(cap=10000)}
SELECT session_id, max(seq) AS last_seq, least(count(*) FILTER (action = 'reason'), 1000) AS log_count,
  (SELECT count(*) FROM vis WHERE vis.session_id = log.session_id AND n <= 10000) AS visited_count, (SELECT count(*) FROM fr WHERE fr.session_id = log.session_id) AS frontier_count,
  (SELECT count(DISTINCT node_id) FROM log a WHERE a.session_id = log.session_id AND action = 'annotate') AS annotation_count FROM log GROUP BY session_id"""


@query(f"WITH {LOG} SELECT session_id, max(ts) AS last_accessed_at FROM log GROUP BY 1 HAVING epoch_ms(TIMESTAMP '2024-01-31 00:00:00') - epoch_ms(max(ts)) > 3600000")
def session_expired(spark, sf):
    return SE.expired(session_log(spark, sf), "2024-01-31 00:00:00")


@query("""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 3600 SECOND OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS start FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(start) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM g)
SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS merged FROM s GROUP BY user_id, grp""")
def debounce_events(spark, sf):
    from quern.streaming.watch import debounce

    e = table(spark, sf, "events")
    return debounce(e, ["user_id"], "1 hour", F.struct("ts", "event_id", "event_type")).select("user_id", F.col("last.ts").alias("ts"), F.col("last.event_type").alias("event_type"), "merged")


_Q = "FILTER (WHERE true)"


@query("""WITH l AS (SELECT event_id AS seq, value AS latency_ms, json_extract_string(props, '$.k')::INT AS results, event_type = 'click' AS used_fallback, event_type = 'error' AS failed FROM events),
s AS (SELECT * FROM l ORDER BY seq DESC LIMIT 1000), o AS (SELECT list(latency_ms ORDER BY latency_ms) AS v, count(*) AS n, avg(latency_ms) AS m, avg(results) AS r FROM s)
SELECT v[greatest(1, ceil(0.5 * n)::INT)] AS p50, v[greatest(1, ceil(0.9 * n)::INT)] AS p90, v[greatest(1, ceil(0.95 * n)::INT)] AS p95, v[greatest(1, ceil(0.99 * n)::INT)] AS p99,
  round(m, 6) AS mean_ms, round(r, 6) AS mean_results, (SELECT count(*) FROM l) AS searches,
  round((SELECT count(*) FILTER (used_fallback) / count(*)::DOUBLE FROM l), 6) AS fallback_rate, round((SELECT count(*) FILTER (failed) / count(*)::DOUBLE FROM l), 6) AS error_rate FROM o""")
def metrics_summary(spark, sf):
    log = table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), F.col("value").alias("latency_ms"), F.get_json_object("props", "$.k").cast("int").alias("results"),
        (F.col("event_type") == "click").alias("used_fallback"), (F.col("event_type") == "error").alias("failed"),
    )
    m = ME.summary(log)
    return m.select(*[F.round(c, 6).alias(c) if c in ("mean_ms", "mean_results", "fallback_rate", "error_rate") else c for c in m.columns])
