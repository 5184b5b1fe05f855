"""Processing only new or changed records (problem 4).

``IncrementalReader`` runs one step at a time against a durable ledger. A step rereads the feed from the oldest
transaction that was open when the last successful run read, and anti-joins the key-and-version pairs it finds against the
ledger, so overlap is removed and nothing is skipped. ``replay_ledger`` takes a whole table of runs through it.
``replay_runs`` gives the same rows in one plan without a ledger; the tests compare the two.

Defined results
---------------
* A delivery without a hash, path, ``arrived_at`` or ``indexed_at`` carries no state and is ignored.
* Hashes are compared trimmed and in lower case, paths with ``/``.
* Among the deliveries of a file that had arrived, the greatest ``(indexed_at, delivery_id)`` wins; rows equal in both
  but with other hashes resolve to the greatest hash; repeated rows count once.
* A failed, crashed or running run leaves nothing behind: its deliveries go to the next successful run.
* A file that goes back to an earlier hash has changed again.
* Empty tables give an empty result; extra columns are ignored.

Scale: the deliveries are reduced to one row per file and run before anything is sorted, with map-side combination,
so a hot file or repository never meets in one task with more rows than there are runs. Runs are matched to
deliveries by an equi-join on the day, never by comparing every pair.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from quern.operators.durable import durable
from quern.operators.folders import shared_folder
from quern.operators.maintenance import SnapshotStore

_STRIP = r"^[\s ﻿]+|[\s ﻿]+$"


def clean_hash(c: Column) -> Column:
    """Trimmed, lower case; empty becomes null."""
    h = F.lower(F.regexp_replace(c, _STRIP, ""))
    return F.when(h != "", h)


def clean_path(c: Column) -> Column:
    return F.translate(c, "\\", "/")


def clean_feed(feed: DataFrame) -> DataFrame:
    """(file_path, content_hash, indexed_at, delivery_id, arrived_at) of the deliveries that carry a state."""
    return feed.select(
        clean_path(F.col("file_path")).alias("file_path"),
        clean_hash(F.col("content_hash")).alias("content_hash"),
        "indexed_at",
        "delivery_id",
        "arrived_at",
    ).filter(
        "file_path is not null and content_hash is not null and indexed_at is not null and arrived_at is not null"
    )


def _stamp() -> Column:
    return F.struct("indexed_at", "delivery_id", "content_hash")


def _succeeded(runs: DataFrame) -> DataFrame:
    """(run_id, lo, hi]: what of the feed is new to each successful run."""
    w = Window.orderBy("read_upto", "run_id")  # one row per run: a control table
    return (
        runs.filter((F.col("status") == "succeeded") & F.col("read_upto").isNotNull() & F.col("run_id").isNotNull())
        .select("run_id", "read_upto")
        .distinct()
        .select("run_id", F.lag("read_upto").over(w).alias("lo"), F.col("read_upto").alias("hi"))
    )


def replay_runs(feed: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, file_path): for each successful run the files that are new or changed since the one before it."""
    f = clean_feed(feed)
    first = f.agg(F.min("arrived_at").alias("first"))
    days = (
        _succeeded(runs)
        .crossJoin(first)  # one row
        .withColumn("lo_day", F.to_date(F.coalesce(F.greatest("lo", "first"), "first")))
        .filter(F.col("lo_day") <= F.to_date("hi"))
        .select("run_id", "lo", "hi", F.explode(F.sequence("lo_day", F.to_date("hi"))).alias("day"))
    )
    placed = f.withColumn("day", F.to_date("arrived_at")).join(days, "day").filter(
        (F.col("arrived_at") <= F.col("hi")) & (F.col("lo").isNull() | (F.col("arrived_at") > F.col("lo")))
    )
    news = placed.groupBy("file_path", "hi", "run_id").agg(F.max(_stamp()).alias("top"))
    w = Window.partitionBy("file_path").orderBy("hi", "run_id")
    state = news.withColumn("top", F.max("top").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ledger = F.lag("top.content_hash").over(w)  # the version that the ledger holds for the key
    return (
        state.withColumn("held", ledger)
        .filter(~F.col("top.content_hash").eqNullSafe(F.col("held")))
        .select("run_id", "file_path")
    )


def reread_positions(runs: DataFrame) -> list[tuple]:
    """(run_id, read_upto, open_from) of the successful runs in order of ``read_upto`` (a control table, one row per run),
    times as text in the session's zone.

    ``open_from`` is the start of the oldest run that was open when the run read, itself included: started no later and not
    finished by then. A run that never ended is open until the successful run after it has finished, which rereads what it
    may have left behind. It is never later than ``read_upto``.
    """
    text = [F.col(c).cast("string").alias(c) for c in ("started_at", "finished_at", "read_upto")]
    all_runs = runs.filter("started_at is not null").select("run_id", "status", *text).distinct().collect()
    good = sorted({(r.read_upto, r.run_id, r.started_at, r.finished_at or "") for r in all_runs if r.status == "succeeded" and r.read_upto is not None and r.run_id is not None})
    out, done = [], None
    for upto, run, started, finished in good:
        still = [x.started_at for x in all_runs if x.started_at <= started and (x.finished_at > started if x.finished_at else done is None or x.started_at > done)]
        out.append((run, upto, min([upto, *still])))
        done = finished or started
    return out


_PAIR = ("file_path", "indexed_at", "delivery_id", "content_hash", "arrived")


def _micros(value) -> Column:
    """A time (a datetime, or a text or a column in the session's zone) in microseconds: a number reaches the row groups of a
    Parquet file as a filter, a time without zone does not."""
    return F.unix_micros((value if isinstance(value, Column) else F.lit(value)).cast("timestamp"))


def arrivals(feed: DataFrame) -> DataFrame:
    """The cleaned feed as (file_path, indexed_at, delivery_id, content_hash, arrived)."""
    return clean_feed(feed).withColumn("arrived", _micros(F.col("arrived_at"))).select(*_PAIR)


class IncrementalReader:
    """One run at a time against a ledger in ``path`` (a folder that all executors share).

    The ledger is append-only: ``pairs`` has every key-and-version pair (file, stamp) that a run has processed, ``state`` the
    rows that each run gave the files, and the manifest the position to reread from. A run reads the feed from there, removes
    the pairs of the ledger by an anti-join, and publishes its rows and its position in one manifest as its last act. A run
    that dies earlier leaves only folders that nothing names; a run that is started again under the same id and has been
    published gives the rows that it gave.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, SnapshotStore(spark, path)

    def pairs(self) -> DataFrame:
        return self.store.read("pairs")

    def state(self) -> DataFrame:
        return self.store.read("state")

    def ledger(self) -> DataFrame:
        """(file_path, indexed_at, delivery_id, content_hash): the state of every file."""
        return self.state().groupBy("file_path").agg(F.max(_stamp()).alias("t")).select("file_path", "t.*")

    def changes(self) -> DataFrame:
        """(run_id, file_path, content_hash) of all runs."""
        return self.state().filter("changed").select("run_id", "file_path", "content_hash")

    def run(self, run_id: int, feed: DataFrame, read_upto, open_from=None, clean: bool = False) -> DataFrame:
        """Process what has arrived up to ``read_upto``; the rows (run_id, file_path, content_hash) that are new or changed.

        ``open_from``: start of the oldest transaction that is open now; the next run rereads from there (see
        :func:`reread_positions`). Without it the next run rereads from ``read_upto``. ``clean``: the feed is one of
        :func:`arrivals` already.
        """
        self.process(run_id, feed, read_upto, open_from, clean)
        return self.changes().filter(F.col("run_id") == run_id)

    def process(self, run_id: int, feed: DataFrame, read_upto, open_from=None, clean: bool = False) -> None:
        """As :meth:`run`, without reading the result back. The states come from the pairs that were just written, so the feed
        is read and joined with the ledger once."""
        view = self.store.snapshot()
        if run_id in view.meta("runs", []):
            return
        f = (feed if clean else arrivals(feed)).filter(F.col("arrived") <= _micros(read_upto))
        pair, kept = f.schema, StructType([StructField("run_id", IntegerType()), *f.schema.fields[:4], StructField("changed", BooleanType())])
        since, held = view.meta("reread_from"), view.read("pairs", pair)
        if since is not None:
            late = F.col("arrived") >= _micros(since)
            f, held = f.filter(late), held.filter(late)
        key = list(_PAIR[:4])
        new = f.groupBy(*key).agg(F.max("arrived").alias("arrived")).join(held, key, "left_anti")
        pairs = self.store._write("pairs", new, None)
        tops = self.spark.read.schema(pair).parquet(*map(self.store.folder.at, pairs.values())).groupBy("file_path").agg(F.max(_stamp()).alias("t"))
        old = view.read("state", kept).groupBy("file_path").agg(F.max(_stamp()).alias("h"))
        rows = (
            tops.join(old, "file_path", "left")
            .filter(F.col("h").isNull() | (F.col("t") > F.col("h")))
            .select(F.lit(run_id).cast("int").alias("run_id"), "file_path", "t.*", (~F.col("t.content_hash").eqNullSafe(F.col("h.content_hash"))).alias("changed"))
        )
        state = self.store._write("state", rows, None)
        position = min(str(read_upto), str(open_from)) if open_from is not None else str(read_upto)
        self.store.publish_folders({"pairs": pairs, "state": state}, {"reread_from": position, "read_upto": str(read_upto), "runs": [*view.meta("runs", []), run_id]})


def replay_ledger(feed: DataFrame, runs: DataFrame, path: str | None = None) -> DataFrame:
    """(run_id, file_path): every successful run of the control table in turn through :class:`IncrementalReader`.

    The cleaned feed is written once in order of arrival, so a run reads only the row groups of its own stretch. Without
    ``path`` the ledger lies in the shared folder and is removed once the result is kept.
    """
    spark = feed.sparkSession
    at = path or f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    reader = IncrementalReader(spark, at)
    stretch = f"{at}/feed-{uuid.uuid4().hex}"
    arrivals(feed).repartitionByRange("arrived").sortWithinPartitions("arrived").write.option("parquet.block.size", 8 << 20).parquet(stretch)
    clean = spark.read.parquet(stretch)
    for run, upto, open_from in reread_positions(runs):
        reader.process(run, clean, upto, open_from, clean=True)
    if not reader.store.exists("state"):
        return feed.select(F.lit(0).alias("run_id"), clean_path(F.col("file_path")).alias("file_path")).filter("false")
    out = durable(reader.changes().select("run_id", "file_path"))
    reader.store.folder.delete("" if path is None else stretch.rsplit("/", 1)[1])
    return out
