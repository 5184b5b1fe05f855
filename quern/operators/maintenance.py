"""Incremental maintenance of an index: hash differences, upserts, deletes and versioned snapshots."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.errors import Conflict
from quern.operators.folders import Folder
from quern.operators.graph import last_wins


def indexed_hashes(records: DataFrame) -> DataFrame:
    """(file_path, content_hash): of each file the hash of its least id."""
    return records.filter("file_path is not null").groupBy("file_path").agg(F.min_by("content_hash", F.struct("id", "content_hash")).alias("content_hash"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_path, status) of both sides' (file_path, content_hash): new, changed, same or deleted."""
    o = old.select("file_path", F.col("content_hash").alias("was"), F.lit(True).alias("o"))
    n = new.select("file_path", F.col("content_hash").alias("now"), F.lit(True).alias("n"))
    status = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "deleted").when(F.col("was").eqNullSafe(F.col("now")), "same").otherwise("changed")
    return o.join(n, "file_path", "full_outer").select("file_path", status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, order: str = "indexed_at") -> DataFrame:
    """Records by id, the last wins; within one batch the latest."""
    return last_wins(old, new, ["id"], [order])


def delete_files(records: DataFrame, paths: DataFrame) -> DataFrame:
    return records.join(paths.select("file_path").distinct(), "file_path", "left_anti").select(*records.columns)


class Snapshot:
    """One manifest of a store."""

    def __init__(self, store: SnapshotStore, version: int, manifest: dict):
        self.store, self.version, self.manifest = store, version, manifest

    def read(self, table: str, schema=None, buckets: list[str] | None = None) -> DataFrame:
        held = self.manifest["tables"].get(table, {})
        at = [self.store.folder.at(x) for b, xs in held.items() if buckets is None or b in buckets for x in xs]
        spark = self.store.spark
        if not at:
            return spark.createDataFrame([], schema or "none int")
        return (spark.read.schema(schema) if schema else spark.read).parquet(*at)

    def meta(self, key: str, default=None):
        return self.manifest["meta"].get(key, default)


class SnapshotStore:
    """Named tables as immutable Parquet folders under numbered manifests.

    A manifest lists, for each table, the folders of each bucket (rows by the hash of a key; bucket "" for tables without
    one), and holds the meta values. A commit writes its folders first and then the next manifest, which fails if another
    writer has taken the number: appends are then added to that writer's manifest, other commits raise ``Conflict``.
    Commits of several tables become visible at once, readers keep the manifest that they opened, and a commit that dies
    leaves only folders that no manifest names, which ``vacuum`` removes.
    """

    KEEP_MS = 3_600_000
    SORTED = {"postings": ["term"]}  # order of a table's rows within its files

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, Folder(spark, path), buckets

    # -- manifests
    def _current(self) -> tuple[int, dict]:
        names = [n for n, _ in self.folder.names("manifests")]
        return (int(names[-1]), json.loads(self.folder.read(f"manifests/{names[-1]}"))) if names else (0, {"tables": {}, "meta": {}})

    def _publish(self, seen: int, change, again: bool = False) -> None:
        """Apply ``change`` to the manifest ``seen`` and publish the next; ``again``: to whatever is current then."""
        while True:
            at, now = self._current()
            if at != seen and not again:
                raise Conflict("the store has changed since this commit began", seen=seen, current=at)
            change(now)
            if self.folder.put_new(f"manifests/{at + 1:012d}", json.dumps(now, sort_keys=True)):
                return

    def version(self) -> int:
        """Number of the current manifest."""
        return self._current()[0]

    # -- reading
    def snapshot(self) -> Snapshot:
        """The current manifest, for several reads of one state."""
        return Snapshot(self, *self._current())

    def exists(self, table: str) -> bool:
        return table in self._current()[1]["tables"]

    def read(self, table: str, schema=None, buckets: list[str] | None = None) -> DataFrame:
        """The table, or those of its buckets, or an empty one of ``schema``."""
        return self.snapshot().read(table, schema, buckets)

    def meta(self, key: str, default=None):
        return self.snapshot().meta(key, default)

    def put_meta(self, **values) -> None:
        """Set meta values; None removes one."""

        def change(m):
            m["meta"] = {k: v for k, v in (m["meta"] | values).items() if v is not None}

        self._publish(0, change, again=True)

    # -- writing
    def _bucket(self, key: str | Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("string")

    def bucket_of(self, value: str) -> str:
        """The bucket of one key."""
        return self.spark.range(1).select(self._bucket(F.lit(value)).alias("b")).first().b

    def _write(self, table: str, df: DataFrame, key: str | None) -> dict[str, str]:
        """Folders of the written rows by bucket."""
        name = f"{table}-{uuid.uuid4().hex}"
        w = df if key is None else df.withColumn("__bucket", self._bucket(key)).repartition("__bucket").sortWithinPartitions("__bucket", *self.SORTED.get(table, []))
        w = w.write.option("maxRecordsPerFile", 5_000_000)
        if key is None:
            w.parquet(self.folder.at(name))
            return {"": name}
        w.partitionBy("__bucket").parquet(self.folder.at(name))
        return {n.split("=")[1]: f"{name}/{n}" for n, _ in self.folder.names(name) if "=" in n}

    def commit(self, tables: dict[str, DataFrame], keys: dict[str, str] | None = None, meta: dict | None = None, seen: int | None = None) -> None:
        """Replace whole tables; those with a key in ``keys`` are stored in buckets. ``seen``: the version they were made from."""
        seen = self.version() if seen is None else seen
        new = {t: self._write(t, df, (keys or {}).get(t)) for t, df in tables.items()}

        def change(m):
            for t, at in new.items():
                m["tables"][t] = {b: [x] for b, x in at.items()} or {"": []}
            m["meta"] |= meta or {}

        self._publish(seen, change)

    def touched(self, paths: DataFrame, key: str = "file_path") -> list[str]:
        """The buckets that hold the keys; as many as there are buckets at most."""
        return [r.b for r in paths.select(self._bucket(key).alias("b")).distinct().collect()]

    def replace(self, tables: dict[str, tuple[DataFrame, str, list[str]]], whole: dict[str, DataFrame] | None = None, meta: dict | None = None, seen: int | None = None) -> None:
        """Replace the named buckets of tables, {table: (rows, key, buckets)}; others stay. ``whole`` tables are replaced too."""
        seen = self.version() if seen is None else seen
        new = {t: (self._write(t, df, key), gone) for t, (df, key, gone) in tables.items()}
        full = {t: self._write(t, df, None) for t, df in (whole or {}).items()}

        def change(m):
            for t, (at, gone) in new.items():
                left = {b: x for b, x in m["tables"].get(t, {}).items() if b not in gone}
                m["tables"][t] = left | {b: [x] for b, x in at.items()} or {"": []}
            for t, at in full.items():
                m["tables"][t] = {b: [x] for b, x in at.items()}
            m["meta"] = {k: v for k, v in (m["meta"] | (meta or {})).items() if v is not None}

        self._publish(seen, change)

    def append(self, tables: dict[str, DataFrame], keys: dict[str, str] | None = None, meta: dict | None = None) -> None:
        """Add rows; concurrent appends all last."""
        self.publish_folders({t: self._write(t, df, (keys or {}).get(t)) for t, df in tables.items()}, meta)

    def publish_folders(self, new: dict[str, dict[str, str]], meta: dict | None = None) -> None:
        """Add folders that have been written, {table: {bucket: folder}}."""

        def change(m):
            for t, at in new.items():
                held = m["tables"].setdefault(t, {})
                for b, x in at.items():
                    held.setdefault(b, []).append(x)
            m["meta"] |= meta or {}

        self._publish(0, change, again=True)

    def compact(self, table: str, key: str | None = None, least: int = 16) -> int:
        """Rewrite the buckets of a table that have ``least`` or more folders as one each; returns their number."""
        seen, now = self._current()
        many = [b for b, xs in now["tables"].get(table, {}).items() if len(xs) >= least]
        if not many:
            return 0
        new = self._write(table, self.read(table, buckets=many), key)

        def change(m):
            for b in many:
                m["tables"][table].pop(b)
            m["tables"][table] |= {b: [x] for b, x in new.items()}

        self._publish(seen, change)
        return len(many)

    def clear(self, *tables: str) -> None:
        """Drop tables, all if none is named."""

        def change(m):
            m["tables"] = {k: v for k, v in m["tables"].items() if tables and k not in tables}

        self._publish(0, change, again=True)

    def vacuum(self, keep_ms: int | None = None) -> int:
        """Remove folders and manifests that the current manifest does not name and that are older than ``keep_ms``, so that
        commits and readers under way keep theirs; returns the number of folders."""
        at, now = self._current()
        named = {x.split("/")[0] for t in now["tables"].values() for xs in t.values() for x in xs} | {"manifests"}
        before = time.time() * 1000 - (self.KEEP_MS if keep_ms is None else keep_ms)
        gone = [n for n, t in self.folder.names() if n not in named and t <= before]
        for n in gone:
            self.folder.delete(n)
        for n, t in self.folder.names("manifests"):
            if int(n) < at and t <= before:
                self.folder.delete(f"manifests/{n}")
        return len(gone)
