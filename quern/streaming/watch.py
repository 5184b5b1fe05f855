"""File changes as a stream: debouncing, and applying batches of changes to an index."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def debounce(events: DataFrame, keys: list[str], gap: str = "1 second", newest: Column | None = None, ts: str = "ts") -> DataFrame:
    """Last event of every run of events of a key whose gaps are below ``gap``: keys, last, merged.

    Works on batches and on streams with a watermark; there a run is emitted once the watermark has passed its end.
    """
    newest = newest if newest is not None else F.struct(ts, *[c for c in events.columns if c not in keys and c != ts])
    return events.groupBy(*keys, F.session_window(ts, gap)).agg(F.max(newest).alias("last"), F.count("*").alias("merged")).drop("session_window")


def coalesce_changes(batch: DataFrame) -> DataFrame:
    """The last change of every file in a micro-batch; at equal stamps a removal wins over a change."""
    rank = F.when(F.col("kind") == "unlink", 1).otherwise(0)
    return batch.groupBy("file_path").agg(F.max(F.struct("ts", rank.alias("r"), "kind", "content")).alias("c")).select("file_path", "c.ts", "c.kind", "c.content")


def debounced(changes: DataFrame, gap: str = "500 milliseconds", late: str = "0 seconds") -> DataFrame:
    """The last change of every run of changes of a file whose gaps are below ``gap``, once the run is over: the watermark on
    ``ts``, which lags ``late`` behind, has to pass its end. Removals are not held back: they come at once, and again where
    they end a run, so a change in front of one cannot bring the file back. At equal stamps a removal wins."""
    order = F.struct("ts", F.when(F.col("kind") == "unlink", 1).otherwise(0).alias("r"), "kind", "content")
    runs = debounce(changes.withWatermark("ts", late), ["file_path"], gap, newest=order)
    held = runs.select("file_path", "last.ts", "last.kind", "last.content", "merged")
    gone = changes.filter("kind = 'unlink'").select("file_path", "ts", "kind", "content", F.lit(1).cast("bigint").alias("merged"))
    return held.unionByName(gone)


def watch(changes: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str, available_now: bool = False, gap: str | None = None):
    """Start a query that gives ``apply`` the last change of every file of each micro-batch; with ``gap`` only changes that no
    other change of the file follows within it (see :func:`debounced`).

    ``apply`` gets (file_path, ts, kind, content) and must be idempotent: a batch is repeated after a failure. The
    index engine's ``apply_changes`` is, because it replaces whole files in one commit.
    """

    def step(batch: DataFrame, _epoch: int) -> None:
        c = coalesce_changes(batch)
        if not c.isEmpty():
            apply(c)

    source = changes if gap is None else debounced(changes, gap).drop("merged")
    w = source.writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")).start()


def stop(query, timeout_s: float = 30) -> bool:
    """Let the micro-batch under way end, for at most ``timeout_s``, then stop; whether it ended.

    What arrives meanwhile is not waited for: it is read when a query starts again from the same checkpoint.
    """
    end = time.monotonic() + timeout_s
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < end:
        time.sleep(0.05)
    ended = not (query.isActive and query.status["isTriggerActive"])
    query.stop()
    return ended
