"""File changes below a folder as a stream source: additions, changes and removals.

Spark's file source never reports removals. This one compares the listing of each micro-batch with the listing that
the last offset stands for. Files that changed less than ``settle_ms`` ago are left for the next batch, so that files
that are still being written are not read. A file that is empty or too large gives a row of the kind ``skip`` with the reason
as its content, once for each of its states: what was indexed of it is out of date. The listing travels in the offset and in the driver, so the source suits
one repository's working copy; for a corpus, compare snapshots with :func:`quern.operators.maintenance.diff`.

    spark.dataSource.register(FileChanges)
    spark.readStream.format("quern_changes").option("path", root).load()
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from quern.operators.languages import BY_EXTENSION
from quern.sources.files import IGNORED, MAX_BYTES


def listing(root: str, settle_ms: int, now: float | None = None) -> dict[str, str]:
    """Path -> stamp of size and time of the files that may be indexed and have settled."""
    now = time.time() if now is None else now
    out = {}
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in IGNORED)
        for n in names:
            if os.path.splitext(n)[1].lower() not in BY_EXTENSION:
                continue
            p = os.path.join(folder, n)
            try:
                s = os.stat(p)
            except OSError:
                continue
            if now - s.st_mtime >= settle_ms / 1000:
                why = "empty" if s.st_size == 0 else "too large" if s.st_size > MAX_BYTES else ""
                out[p] = f"{s.st_mtime_ns}:{s.st_size}:{why}"
    return out


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.settle = options["path"], int(options.get("settle_ms", 500))
        self.initial = options.get("ignore_initial", "false").lower() == "true"

    def initialOffset(self) -> dict:
        return {"files": listing(self.root, self.settle) if self.initial else {}}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        was, now = start["files"], listing(self.root, self.settle)
        # A file that is being written keeps its old stamp: it is neither changed nor gone.
        now |= {p: v for p, v in was.items() if p not in now and os.path.exists(p)}
        return iter(self._rows(was, now)), {"files": now}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._rows(start["files"], end["files"]))

    @staticmethod
    def _rows(was: dict, now: dict) -> list[tuple]:
        stamp = datetime.now(timezone.utc)
        rows = [(p, stamp, "unlink", None) for p in sorted(set(was) - set(now))]
        for p in sorted(now):
            if was.get(p) != now[p]:
                if why := now[p].split(":")[2]:
                    rows.append((p, stamp, "skip", why))
                    continue
                try:
                    text = Path(p).read_text(encoding="utf-8", errors="replace")
                except OSError:
                    continue  # the next listing reports its removal
                rows.append((p, stamp, "change" if p in was and not was[p].split(":")[2] else "add", text))
        return rows


class FileChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quern_changes"

    def schema(self) -> str:
        return "file_path string, ts timestamp, kind string, content string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(dict(self.options))
