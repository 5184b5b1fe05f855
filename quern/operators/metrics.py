"""Search metrics over an event log (seq, latency_ms, results, used_fallback, failed)."""

from __future__ import annotations

from collections import Counter, deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLES = 1000


def last_samples(log: DataFrame, n: int = SAMPLES) -> DataFrame:
    return log.orderBy(F.desc("seq")).limit(n)


def percentile(c: str, p: float) -> Column:
    """Nearest rank; 0 without samples."""
    return F.coalesce(F.expr(f"percentile_disc({p}) within group (order by {c})"), F.lit(0.0))


def summary(log: DataFrame, n: int = SAMPLES) -> DataFrame:
    """One row: latency percentiles of the last ``n`` searches, rates and counts over all."""
    s = last_samples(log, n).agg(
        percentile("latency_ms", 0.5).alias("p50"), percentile("latency_ms", 0.9).alias("p90"), percentile("latency_ms", 0.95).alias("p95"),
        percentile("latency_ms", 0.99).alias("p99"), F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("mean_ms"),
        F.coalesce(F.avg("results"), F.lit(0.0)).alias("mean_results"),
    )
    rate = lambda c: F.coalesce(F.try_divide(F.count_if(c).cast("double"), F.count("*")), F.lit(0.0))
    a = log.agg(F.count("*").alias("searches"), rate(F.col("used_fallback")).alias("fallback_rate"), rate(F.col("failed")).alias("error_rate"))
    return s.crossJoin(a)  # one row each


def index_stats(files: DataFrame) -> DataFrame:
    """One row of counts over (file_path, status, chunks): status is new, changed, same, skipped or deleted."""
    return files.agg(
        F.count_if(F.col("status") != "deleted").alias("total_files"),
        F.count_if(F.col("status").isin("new", "changed")).alias("indexed_files"),
        F.count_if(F.col("status").isin("same", "skipped")).alias("skipped_files"),
        F.coalesce(F.sum(F.when(F.col("status").isin("new", "changed"), F.col("chunks"))), F.lit(0)).cast("bigint").alias("total_chunks"),
    )


class Recorder:
    """What an engine did since it began: the last ``SAMPLES`` searches, and totals that forget nothing."""

    def __init__(self, samples: int = SAMPLES):
        self.samples: deque[tuple] = deque(maxlen=samples)
        self._n: Counter = Counter()

    def search(self, latency_ms: float, results: int, used_fallback: bool = False, failed: bool = False) -> None:
        self.samples.append((self._n["searches"], latency_ms, results, used_fallback, failed))
        self.count(searches=1, fallbacks=int(used_fallback), search_errors=int(failed))

    def count(self, **more: int) -> None:
        """Add to totals: files_indexed, chunks_created, embeddings_generated, index_ms, index_errors."""
        self._n.update(more)

    def totals(self) -> dict:
        n = self._n
        rate = lambda c: n[c] / n["searches"] if n["searches"] else 0.0
        names = ("searches", "fallbacks", "search_errors", "files_indexed", "chunks_created", "embeddings_generated", "index_ms", "index_errors")
        return {k: n[k] for k in names} | {"fallback_rate": rate("fallbacks"), "error_rate": rate("search_errors")}

    def reset(self) -> None:
        self.samples.clear()
        self._n.clear()
