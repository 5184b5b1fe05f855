"""Helpers shared by the llm operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.durable import durable  # noqa: F401

U = np.uint64


BROADCAST_KEYS = 200_000  # small keys that may be broadcast


def few(df: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """``df`` for a join: broadcast if it has no more than ``most`` rows, else left to be shuffled."""
    return F.broadcast(df) if df.count() <= most else df


def spread(df: DataFrame, times: int = 3) -> DataFrame:
    """``df`` in at least ``times`` partitions a core, for dear work on few input splits; unchanged where the input has as many."""
    want = times * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """About ``n`` rows, at most ``2 * n``, by a hash of ``key``; all rows if there are no more than ``n``.

    The share is taken by a threshold where the rows lie, so no task sends the driver more than its part of the sample.
    """
    share = min(1.0, n / max(1, df.count()))
    return df.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * n)


def current(df: DataFrame, *cols: str) -> DataFrame:
    """The current row of every id: the greatest ``indexed_at``, nulls first, and among equals the greatest values.

    Combined before the shuffle, so an id that is repeated very often is no hot key.
    """
    return (
        df.filter("id is not null")
        .groupBy("id")
        .agg(F.max(F.struct("indexed_at", *cols)).alias("r"))
        .select("id", *[F.col("r")[c].alias(c) for c in cols])
    )


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U(33))
