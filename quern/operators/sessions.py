"""Exploration sessions as a fold over their event log: visits, frontier, reasoning log and notes.

Events are (session_id, seq, ts, action, node_id, priority, text) with the actions visit, frontier, reason, annotate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VISITED_CAP, LOG_CAP, FRONTIER_SHOWN, LOG_SHOWN, TTL_S = 10_000, 1_000, 10, 10, 3600


def visited(events: DataFrame, cap: int = VISITED_CAP) -> DataFrame:
    """(session_id, node_id, first_seq): the first ``cap`` distinct nodes that each session visited."""
    v = events.filter("action = 'visit' and node_id is not null").groupBy("session_id", "node_id").agg(F.min("seq").alias("first_seq"))
    w = Window.partitionBy("session_id").orderBy("first_seq", "node_id")
    return v.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= cap).drop("n")


def frontier(events: DataFrame, cap: int = VISITED_CAP) -> DataFrame:
    """(session_id, node_id, priority): the greatest priority of each node that is not visited.

    A visit takes a node off the frontier and keeps it off; beyond the cap it only takes it off, so later additions
    count again.
    """
    last = events.filter("action = 'visit' and node_id is not null").groupBy("session_id", "node_id").agg(F.max("seq").alias("last_visit"))
    adds = events.filter("action = 'frontier' and node_id is not null").select("session_id", "node_id", "seq", F.coalesce("priority", F.lit(1.0)).alias("priority"))
    return (
        adds.join(visited(events, cap).select("session_id", "node_id"), ["session_id", "node_id"], "left_anti")
        .join(last, ["session_id", "node_id"], "left")
        .filter("last_visit is null or seq > last_visit")
        .groupBy("session_id", "node_id")
        .agg(F.max("priority").alias("priority"))
    )


def frontier_top(events: DataFrame, n: int = FRONTIER_SHOWN, cap: int = VISITED_CAP) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy(F.desc("priority"), "node_id")
    return frontier(events, cap).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def recent_log(events: DataFrame, n: int = LOG_SHOWN) -> DataFrame:
    """(session_id, seq, text, rank): the last ``n`` reasoning entries, newest first."""
    w = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    return events.filter("action = 'reason'").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("session_id", "seq", "text", "rank")


def annotations(events: DataFrame) -> DataFrame:
    """(session_id, node_id, note): the last note of each node."""
    return events.filter("action = 'annotate' and node_id is not null").groupBy("session_id", "node_id").agg(F.max(F.struct("seq", "text"))["text"].alias("note"))


def summary(events: DataFrame, cap: int = VISITED_CAP, log_cap: int = LOG_CAP) -> DataFrame:
    """One row per session with its counts and the stamps of its first and last event."""
    base = events.groupBy("session_id").agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("last_accessed_at"), F.least(F.count_if(F.col("action") == "reason"), F.lit(log_cap)).alias("log_count")
    )
    v = visited(events, cap).groupBy("session_id").agg(F.count("*").alias("visited_count"))
    f = frontier(events, cap).groupBy("session_id").agg(F.count("*").alias("frontier_count"))
    a = annotations(events).groupBy("session_id").agg(F.count("*").alias("annotation_count"))
    return base.join(v, "session_id", "left").join(f, "session_id", "left").join(a, "session_id", "left").fillna(0, ["visited_count", "frontier_count", "annotation_count"])


def expired(events: DataFrame, now, ttl_s: int = TTL_S) -> DataFrame:
    """(session_id, last_accessed_at) of sessions whose last access lies more than the limit before ``now``."""
    last = events.groupBy("session_id").agg(F.max("ts").alias("last_accessed_at"))
    return last.filter(F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis(F.col("last_accessed_at").cast("timestamp")) > ttl_s * 1000)


def frontier_priority(weight, depth):
    """Priority with which a neighbour is put on the frontier."""
    return weight / depth
