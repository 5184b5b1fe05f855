"""Exploration sessions as keyed state of a stream; the batch form is :mod:`quern.operators.sessions`.

A micro-batch reads and writes the entries of a session that its events touch, never the whole session. Visited nodes and
log are bounded by their caps. A session that nobody touches for its lifetime is dropped by a timer on processing time; every
event starts the lifetime anew. :class:`Session` is the same fold in memory, against which the tests hold both forms.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quern.operators.sessions import LOG_CAP, TTL_S, VISITED_CAP

OUTPUT = "session_id string, visited_count bigint, frontier_count bigint, log_count bigint, annotation_count bigint, last_seq bigint"


class Session:
    """State of one session; ``apply`` takes its events in the order of ``seq``."""

    def __init__(self, data: str | None = None, visited_cap: int = VISITED_CAP, log_cap: int = LOG_CAP):
        d = json.loads(data) if data else {}
        self.visited: dict[str, None] = dict.fromkeys(d.get("visited", ()))
        self.frontier: dict[str, float] = d.get("frontier", {})
        self.log: list = d.get("log", [])
        self.notes: dict[str, str] = d.get("notes", {})
        self.last_seq: int = d.get("last_seq", -1)
        self.visited_cap, self.log_cap = visited_cap, log_cap

    def apply(self, seq: int, action: str, node_id: str | None, priority: float | None, text: str | None) -> None:
        self.last_seq = max(self.last_seq, seq)
        if action == "visit" and node_id is not None:
            self.frontier.pop(node_id, None)
            if len(self.visited) < self.visited_cap:
                self.visited.setdefault(node_id)
        elif action == "frontier" and node_id is not None and node_id not in self.visited:
            p = 1.0 if priority is None or priority != priority else float(priority)
            self.frontier[node_id] = max(p, self.frontier.get(node_id, p))
        elif action == "reason":
            self.log = [*self.log, [seq, text]][-self.log_cap :]
        elif action == "annotate" and node_id is not None:
            self.notes[node_id] = text

    def dump(self) -> str:
        return json.dumps({"visited": list(self.visited), "frontier": self.frontier, "log": self.log, "notes": self.notes, "last_seq": self.last_seq})

    def counts(self) -> tuple[int, int, int, int, int]:
        return len(self.visited), len(self.frontier), len(self.log), len(self.notes), self.last_seq


class Sessions(StatefulProcessor):
    """Sessions in keyed state: visited nodes, frontier, notes and log are maps whose touched entries alone are read and
    written, each once per micro-batch; sizes are counted beside them. The log keeps its last ``log_cap`` entries."""

    def __init__(self, visited_cap: int = VISITED_CAP, log_cap: int = LOG_CAP, ttl_s: int | None = TTL_S):
        self.visited_cap, self.log_cap, self.ttl = visited_cap, log_cap, ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "visited bigint, frontier bigint, log bigint, notes bigint, last_seq bigint")
        self.visited = handle.getMapState("visited", "node string", "seq bigint")
        self.frontier = handle.getMapState("frontier", "node string", "priority double")
        self.notes = handle.getMapState("notes", "node string", "text string")
        self.log = handle.getMapState("log", "at bigint", "text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        visited_n, frontier_n, log_n, notes_n, last = self.counts.get() if self.counts.exists() else (0, 0, 0, 0, -1)
        seen: dict[str, bool] = {}
        front: dict[str, float | None] = {}
        was: dict[str, float | None] = {}
        fresh: dict[str, int] = {}
        notes: dict[str, str | None] = {}
        lines: list[str | None] = []

        def is_visited(n: str) -> bool:
            if n not in seen:
                seen[n] = self.visited.containsKey((n,))
            return seen[n]

        def priority(n: str) -> float | None:
            if n not in front:
                v = self.frontier.getValue((n,))
                front[n] = was[n] = v[0] if v is not None else None
            return front[n]

        for e in pd.concat(list(rows)).sort_values("seq").itertuples():
            seq, action = int(e.seq), e.action
            node = e.node_id if isinstance(e.node_id, str) else None
            text = e.text if isinstance(e.text, str) else None
            last = max(last, seq)
            if action == "visit" and node is not None:
                if priority(node) is not None:
                    front[node] = None
                    frontier_n -= 1
                if not is_visited(node) and visited_n < self.visited_cap:
                    seen[node], fresh[node] = True, seq
                    visited_n += 1
            elif action == "frontier" and node is not None and not is_visited(node):
                p = 1.0 if e.priority is None or e.priority != e.priority else float(e.priority)
                held = priority(node)
                frontier_n += held is None
                front[node] = p if held is None else max(p, held)
            elif action == "reason":
                lines.append(text)
            elif action == "annotate" and node is not None:
                notes[node] = text
        for n, seq in fresh.items():
            self.visited.updateValue((n,), (seq,))
        for n, p in front.items():
            if p is None and was[n] is not None:
                self.frontier.removeKey((n,))
            elif p is not None and p != was[n]:
                self.frontier.updateValue((n,), (p,))
        for n, text in notes.items():
            notes_n += not self.notes.containsKey((n,))
            self.notes.updateValue((n,), (text,))
        for k, text in list(enumerate(lines, log_n))[-self.log_cap :]:
            self.log.updateValue((k,), (text,))
        for k in range(max(0, log_n - self.log_cap), min(log_n, log_n + len(lines) - self.log_cap)):
            self.log.removeKey((k,))
        log_n += len(lines)
        self.counts.update((visited_n, frontier_n, log_n, notes_n, last))
        if self.ttl is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl * 1000)
        yield pd.DataFrame([(key[0], visited_n, frontier_n, min(log_n, self.log_cap), notes_n, last)], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for state in (self.counts, self.visited, self.frontier, self.notes, self.log):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session_stream(events: DataFrame, visited_cap: int = VISITED_CAP, log_cap: int = LOG_CAP, ttl_s: int | None = TTL_S) -> DataFrame:
    """Counts of every session that a micro-batch touched. Without ``ttl_s`` nothing expires; a run over what is
    available now needs that, because timers keep a query running. State of this kind needs the RocksDB store, which is set."""
    events.sparkSession.conf.set(PROVIDER, ROCKS)
    mode = "none" if ttl_s is None else "processingTime"
    return events.groupBy("session_id").transformWithStateInPandas(Sessions(visited_cap, log_cap, ttl_s), OUTPUT, "update", mode)
