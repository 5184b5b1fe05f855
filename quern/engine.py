"""The engine: builds an index of a corpus in a snapshot store and answers the four kinds of requests.

Ingest is one batch plan: scan, difference of hashes against the index, chunk, embed, and one commit of records, nodes
and edges. Raw references are stored, so edges into files that changed are resolved again instead of being lost.
Search degrades: without an embedder it is a keyword search, without a graph it has no neighbours. A graph that fails while
an index is built leaves the records in place and the graph marked as degraded until the next build that succeeds.

Records, nodes and raw references lie in buckets by path, edges by source; a commit rewrites the buckets that it touches and
resolves again only references to symbols that changed. Session events are only ever appended.
"""

from __future__ import annotations

import logging
import re
import threading
import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import schemas
from quern.config import IndexConfig, ignore_hint
from quern.errors import Closed, Conflict, EmbedderError, InvalidFilter, InvalidId
from quern.functions.text import content_hash, is_valid_id, round2
from quern.operators import graph as G
from quern.operators import maintenance as M
from quern.operators import predicates as P
from quern.operators import search as S
from quern.operators import sessions as SE
from quern.operators import syntax
from quern.operators import textindex as TI
from quern.operators.durable import durable
from quern.operators.embed import HashEmbedder, QueryEmbedder, embed_documents
from quern.operators.metrics import Recorder
from quern.operators.metrics import summary as metrics_summary
from quern.sources.files import scan

log = logging.getLogger("quern")
_SESSION = re.compile(r"[A-Za-z0-9_-]{1,100}")


def _within(name: str, v: int, low: int, high: int) -> int:
    if not isinstance(v, int) or not low <= v <= high:
        raise ValueError(f"{name} must be between {low} and {high}")
    return v


class Engine:
    def __init__(self, spark: SparkSession, store: str, config: IndexConfig | None = None, embedder: Callable | None = None, make_embedder: Callable | None = None):
        self.spark, self.config = spark, config or IndexConfig.load()
        self.store = M.SnapshotStore(spark, store)
        self.make_embedder = make_embedder
        self.embed_query = QueryEmbedder(embedder or HashEmbedder(self.config.dimension))
        self._lock = threading.Lock()
        self._idle = threading.Condition()
        self._pending, self._closing = 0, False
        self.recorder = Recorder()

    # -- life -----------------------------------------------------------------------------------------------------
    @contextmanager
    def _operation(self):
        """Counts an operation under way; none begins once the engine closes."""
        with self._idle:
            if self._closing:
                raise Closed("the engine is closing")
            self._pending += 1
        try:
            yield
        finally:
            with self._idle:
                self._pending -= 1
                self._idle.notify_all()

    @property
    def pending(self) -> int:
        """Operations under way."""
        return self._pending

    def close(self, timeout_s: float = 30.0) -> bool:
        """Let operations under way end, for at most ``timeout_s``, and take no more; whether all have ended."""
        with self._idle:
            self._closing = True
            return self._idle.wait_for(lambda: self._pending == 0, timeout_s)

    def get_meta(self, key: str) -> str | None:
        """A meta value of the index."""
        return self.store.meta(f"user:{key}")

    def put_meta(self, key: str, value: str | None) -> None:
        """Set a meta value; None removes it."""
        self.store.put_meta(**{f"user:{key}": value})

    @property
    def graph_available(self) -> bool:
        return self.config.graph.enabled and self.store.exists("nodes") and not self.store.meta("graph_error")

    # -- tables ---------------------------------------------------------------------------------------------------
    def records(self) -> DataFrame:
        return self.store.read("records", schemas.VECTOR_RECORD)

    def nodes(self) -> DataFrame:
        return self.store.read("nodes", schemas.GRAPH_NODE)

    def edges(self) -> DataFrame:
        return self.store.read("edges", schemas.GRAPH_EDGE)

    def raw_edges(self) -> DataFrame:
        return self.store.read("raw_edges", schemas.RAW_EDGE)

    def events(self) -> DataFrame:
        return self.store.read("events", schemas.SESSION_EVENT)

    # -- ingest ---------------------------------------------------------------------------------------------------
    def build(self, force: bool = False) -> dict:
        """Index the configured root; only one build runs at a time. ``force`` starts from nothing."""
        with self._operation(), self._lock:
            if hint := ignore_hint(self.config.root, self.store.folder.path):
                log.warning("the index lies in the working copy; add %s to .gitignore", hint)
            if force:
                self.store.clear("records", "postings", "lengths", "nodes", "edges", "raw_edges")
            return self.index(scan(self.spark, self.config.root, limit=self.config.max_file_bytes))

    def ensure(self) -> None:
        if not self.store.exists("records"):
            self.build()

    def index(self, files: DataFrame, remove_missing: bool = True) -> dict:
        """Bring the index to the state of ``files`` (file_path, content, content_hash, skip); counts of what was done.

        Paths and hashes are kept once; contents are read again for the files that are new or changed only, and a record has
        the hash of the content that it was made from.
        """
        began = time.time()
        files = files if "skip" in files.columns else files.withColumn("skip", F.lit(None).cast("string"))
        seen = durable(files.select("file_path", "content_hash", "skip"))
        status = M.diff(M.indexed_hashes(self.records()), seen.filter("skip is null"))
        if not remove_missing:
            status = status.filter("status <> 'deleted'")
        status = durable(status)
        todo = files.filter("skip is null").join(status.filter("status in ('new', 'changed')"), "file_path", "left_semi")
        gone = status.filter("status in ('changed', 'deleted')")
        counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
        skipped = seen.filter("skip is not null").count()
        new = counts.get("new", 0) + counts.get("changed", 0)
        try:
            chunks = self._replace(todo, gone) if new or counts.get("deleted") or not self.store.exists("records") else 0
        except Exception:
            self.recorder.count(index_errors=1)
            raise
        out = {
            "total_files": sum(v for k, v in counts.items() if k != "deleted") + skipped,
            "indexed_files": new,
            "skipped_files": counts.get("same", 0) + skipped,
            "deleted_files": counts.get("deleted", 0),
            "total_chunks": chunks,
            "duration_ms": int((time.time() - began) * 1000),
        }
        self.recorder.count(files_indexed=new, chunks_created=chunks, embeddings_generated=chunks, index_ms=out["duration_ms"])
        return out

    def _replace(self, files: DataFrame, gone: DataFrame) -> int:
        """One commit: rows of ``gone`` out, rows of ``files`` in. Returns the new chunks."""
        seen = self.store.version()
        gone = durable(gone.select("file_path"))
        parsed = durable(syntax.parse_files(files))
        columns = [f.name for f in schemas.VECTOR_RECORD.fields]
        vectors = durable(
            embed_documents(syntax.chunk_files(parsed).drop("part_no"), make=self.make_embedder, dimension=self.config.dimension)
            .withColumn("indexed_at", F.current_timestamp())
            .select(*columns)
        )
        paths = durable(gone.unionByName(parsed.select("file_path")).distinct())
        at = self.store.touched(paths)
        old = self.store.read("records", schemas.VECTOR_RECORD, at)
        records = durable(M.upsert(M.delete_files(old, gone), vectors).select(*columns))
        tables = {
            "records": (records, "file_path", at),
            "postings": (TI.postings(records, more=("name", "signature"), path="file_path"), "file_path", at),
            "lengths": (TI.lengths(records, path="file_path"), "file_path", at),
        }
        meta = {"graph_error": None}
        if self.config.graph.enabled:
            try:
                tables |= self._graph_tables(parsed, vectors, gone, paths, at)
            except Exception as e:  # noqa: BLE001
                log.warning("graph failed, records are kept without it: %s", e)
                meta = {"graph_error": f"{type(e).__name__}: {e}"[:500]}
        self.store.replace(tables, meta=meta, seen=seen)
        return vectors.count()

    def _graph_tables(self, parsed: DataFrame, vectors: DataFrame, gone: DataFrame, paths: DataFrame, at: list[str]) -> dict:
        """The rewritten buckets of nodes, raw references and edges; only references to symbols of the changed files, and those
        from these files, are resolved again."""
        names, raws = ([f.name for f in t.fields] for t in (schemas.GRAPH_NODE, schemas.RAW_EDGE))
        fresh = G.nodes_of(vectors).withColumn("updated_at", F.current_timestamp()).withColumn("stale", F.lit(False))
        before = durable(self.store.read("nodes", schemas.GRAPH_NODE, at).join(paths, "file_path", "left_semi"))
        nodes = durable(G.upsert_nodes(M.delete_files(self.store.read("nodes", schemas.GRAPH_NODE, at), gone).select(*names), fresh.select(*names)))
        rest = [str(k) for k in range(self.store.buckets) if str(k) not in at]
        all_nodes = nodes.unionByName(self.store.read("nodes", schemas.GRAPH_NODE, rest).select(*names))
        out = gone.withColumnRenamed("file_path", "source_path")
        kept = self.store.read("raw_edges", schemas.RAW_EDGE, at)
        raw = durable(kept.join(out, "source_path", "left_anti").select(*raws).unionByName(syntax.raw_edges(parsed).select(*raws)).distinct())
        all_raw = raw.unionByName(self.store.read("raw_edges", schemas.RAW_EDGE, rest).select(*raws))
        symbols = before.select("symbol_name").unionByName(fresh.select("symbol_name")).filter("symbol_name is not null").distinct()
        symbols = symbols.withColumnRenamed("symbol_name", "target_symbol")
        lost = durable(before.select("id").join(nodes.select("id"), "id", "left_anti"))
        sources = durable(
            all_raw.join(symbols, "target_symbol", "left_semi").select("source_id")
            .unionByName(all_raw.join(paths.withColumnRenamed("file_path", "source_path"), "source_path", "left_semi").select("source_id"))
            .unionByName(lost.withColumnRenamed("id", "source_id"))
            .unionByName(self.edges().join(lost.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("source_id"))
            .distinct()
        )
        edge_at = self.store.touched(sources, "source_id")
        refs = durable(all_raw.join(sources, "source_id", "left_semi"))
        wanted = refs.select(F.col("target_symbol").alias("symbol_name")).distinct()
        fields = [f.name for f in schemas.GRAPH_EDGE.fields]
        there = self.store.read("edges", schemas.GRAPH_EDGE, edge_at)
        linked = G.cascade(there.filter("edge_type = 'agent_linked'").join(sources, "source_id", "left_semi").select(*fields), all_nodes)
        found = G.upsert_edges(linked, G.resolve_edges(refs, all_nodes.join(wanted, "symbol_name", "left_semi")).select(*fields))
        edges = there.join(sources, "source_id", "left_anti").select(*fields).unionByName(found)
        return {"nodes": (nodes, "file_path", at), "raw_edges": (raw, "source_path", at), "edges": (edges, "source_id", edge_at)}

    def apply_changes(self, changes: DataFrame) -> None:
        """A batch of file changes (file_path, kind, content): add and change replace a file, unlink and skip remove it."""
        with self._operation(), self._lock:
            put = changes.filter("kind in ('add', 'change')").select("file_path", F.coalesce("content", F.lit("")).alias("content")).withColumn("content_hash", content_hash(F.col("content")))
            self._replace(put, changes.select("file_path").distinct())

    # -- search ---------------------------------------------------------------------------------------------------
    def search(self, query: str, path: str | None = None, limit: int = 10, file_pattern: str | None = None, use_reranking: bool = True, multiplier: int = 5, scorer=S.overlap_score) -> DataFrame:
        """Hybrid search as a DataFrame."""
        if not query.strip():
            raise ValueError("query must not be empty")
        _within("limit", limit, 1, 50)
        _within("candidate_multiplier", multiplier, 1, 20)
        if path:
            path = P.within_root(self.config.root, path)
        try:
            vector = self.embed_query(query)
        except EmbedderError as e:
            log.warning("embedder failed, falling back to keywords: %s", e)
            vector = None
        where = P.search_filter(path, file_pattern, self.config.compat)
        if vector is None and self.store.exists("postings"):
            return TI.keyword_search(self.records(), self.store.read("postings", TI.FIELDS), query, limit, where)
        return S.hybrid_search(self.records(), query, vector, limit, where, use_reranking, multiplier, scorer)

    def text_search(self, query: str, limit: int = 10) -> DataFrame:
        """(id, score) by BM25 over the contents, from the stored text index alone."""
        _within("limit", limit, 1, 50)
        self.ensure()
        return TI.bm25(self.store.read("postings", TI.FIELDS), self.store.read("lengths", "id string, file_path string, doc_len int"), query, limit)

    def semantic_search(self, query: str, **options) -> dict:
        with self._operation():
            began = time.perf_counter()
            self.ensure()
            try:
                rows = [r.asDict() for r in self._output(self.search(query, **options)).collect()]  # limit rows
            except Exception:
                self.recorder.search((time.perf_counter() - began) * 1000, 0, False, True)
                raise
            fallback = any([r.pop("from_fallback") for r in rows])
            for r in rows:
                r.pop("id")
            self.recorder.search((time.perf_counter() - began) * 1000, len(rows), fallback, False)
            total = self.records().count()
            return {"results": rows, "total_results": len(rows), "query": query, "index_stats": {"total_chunks": total, "indexed": total > 0}}

    @staticmethod
    def _output(hits: DataFrame) -> DataFrame:
        return hits.select("id", F.col("file_path").alias("file"), "start_line", "end_line", "name", "node_type", round2(F.col("combined_score")).alias("score"), "content", "signature", "from_fallback")

    def context_query(self, query: str, depth: int = 1, edge_kinds=None, session_id: str | None = None, **options) -> dict:
        """Search results with their graph neighbours; visits and frontier go to the session."""
        _within("depth", depth, 1, 3)
        self._session_id(session_id)
        if unknown := sorted(set(edge_kinds or ()) - set(schemas.EDGE_TYPES)):
            raise InvalidFilter("unknown kinds of edges", kinds=unknown)
        self.ensure()
        hits = [r.asDict() for r in self._output(self.search(query, **options)).collect()]  # limit rows
        kinds = edge_kinds or self.config.graph.edge_kinds
        found: dict[str, list] = {}
        available = self.graph_available
        if available and hits:
            roots = self.spark.createDataFrame([(h["id"],) for h in hits], "root_id string")
            for r in G.neighbors(self.edges(), self.nodes(), roots, depth, kinds).orderBy("root_id", "depth", "node_id").collect():  # neighbours of a result page
                found.setdefault(r.root_id, []).append(
                    {"id": r.node_id, "file": r.file_path, "symbol_name": r.symbol_name, "kind": r.kind, "edge_type": r.edge_type, "direction": r.direction, "hop_direction": r.hop_direction, "depth": r.depth, "weight": r.weight}
                )
        out = {"query": query, "total_results": len(hits), "graph_stats": {"total_neighbors": sum(map(len, found.values())), "graph_available": available}}
        out["results"] = [{k: v for k, v in h.items() if k != "from_fallback"} | {"neighbors": found.get(h["id"], [])} for h in hits]
        if session_id:
            steps = []
            for h in hits:
                steps.append(("visit", h["id"], None, None))
                steps += [("frontier", n["id"], SE.frontier_priority(n["weight"], n["depth"]), None) for n in found.get(h["id"], [])]
            self._record(session_id, steps)
            s = self._session_row(session_id)
            out["session"] = {"visited_count": s["visited_count"], "frontier_count": s["frontier_count"]}
        return out

    # -- sessions -------------------------------------------------------------------------------------------------
    @staticmethod
    def _session_id(session_id: str | None) -> None:
        if session_id is not None and not _SESSION.fullmatch(session_id):
            raise InvalidId("session ids have up to 100 letters, digits, _ and -", session_id=session_id[:120])

    COMPACT = 64  # folders of a bucket of events, then they become one

    def _record(self, session_id: str, steps: list[tuple]) -> None:
        """Append (action, node_id, priority, text) to the session's log; concurrent writers all last."""
        now = time.time_ns()
        rows = [(session_id, now + i, action, node, priority, text) for i, (action, node, priority, text) in enumerate(steps)]
        new = self.spark.createDataFrame(rows, "session_id string, seq bigint, action string, node_id string, priority double, text string")
        new = new.withColumn("ts", F.timestamp_micros((F.col("seq") / 1000).cast("bigint")))
        self.store.append({"events": new.select(*[f.name for f in schemas.SESSION_EVENT.fields])}, {"events": "session_id"})
        try:
            self.store.compact("events", "session_id", self.COMPACT)
        except Conflict:
            pass  # the next append tries again

    def session_events(self, session_id: str) -> DataFrame:
        """The events of one session, from its bucket."""
        at = self.store.bucket_of(session_id)
        return self.store.read("events", schemas.SESSION_EVENT, [at]).filter(F.col("session_id") == session_id)

    def _session_row(self, session_id: str) -> dict:
        r = SE.summary(self.session_events(session_id)).first()
        return r.asDict() if r else {"visited_count": 0, "frontier_count": 0, "log_count": 0, "annotation_count": 0, "created_at": None}

    def sessions(self) -> list[str]:
        """Ids of the sessions that have not expired."""
        last = self.events().groupBy("session_id").agg(F.max("ts").alias("last"))
        live = last.filter(F.unix_millis(F.current_timestamp()) - F.unix_millis("last") <= self.config.graph.session_ttl_s * 1000)
        return [r.session_id for r in live.orderBy("session_id").collect()]  # a listing for people

    def delete_session(self, session_id: str) -> bool:
        """Drop a session's events; whether there were any."""
        self._session_id(session_id)
        with self._operation(), self._lock:
            seen = self.store.version()
            at = self.store.bucket_of(session_id)
            e = self.store.read("events", schemas.SESSION_EVENT, [at])
            if e.filter(F.col("session_id") == session_id).isEmpty():
                return False
            self.store.replace({"events": (e.filter(F.col("session_id") != session_id), "session_id", [at])}, seen=seen)
            return True

    def close_sessions(self) -> None:
        """Drop the events of all sessions."""
        with self._operation(), self._lock:
            self.store.clear("events")

    def graph_annotate(self, session_id: str, node_id: str, note: str | None = None, links: list[str] | None = None, reasoning: str | None = None) -> dict:
        """Visit a node, note and reason about it, and link it. Links are checked before anything is recorded."""
        self._session_id(session_id)
        for i in (node_id, *(links or [])):
            if not is_valid_id(i):
                raise InvalidId("not an id", id=i[:120])
        rows = G.link(node_id, links, note, self.nodes()) if links else []
        steps = [("visit", node_id, None, None)]
        steps += [("annotate", node_id, None, note)] if note else []
        steps += [("reason", node_id, None, reasoning)] if reasoning else []
        self._record(session_id, steps)
        if rows:
            new = self.spark.createDataFrame(rows, "source_id string, target_id string, edge_type string, weight double, metadata string")
            with self._lock:
                seen = self.store.version()
                at = [self.store.bucket_of(node_id)]
                there = self.store.read("edges", schemas.GRAPH_EDGE, at)
                self.store.replace({"edges": (G.upsert_edges(there, new), "source_id", at)}, seen=seen)
        return {"annotated": True, "node_id": node_id, "note": note, "links_created": len(links or []), "session_visited_count": self._session_row(session_id)["visited_count"]}

    def session_summary(self, session_id: str) -> dict:
        self._session_id(session_id)
        self._record(session_id, [("touch", None, None, None)])
        e = self.session_events(session_id)
        s = self._session_row(session_id)
        top = [{"node_id": r.node_id, "priority": r.priority} for r in SE.frontier_top(e).orderBy("rank").collect()]  # ten rows
        recent = [{"ts": r.seq / 1e9, "text": r.text} for r in SE.recent_log(e).orderBy(F.desc("rank")).collect()]  # ten rows
        available = self.graph_available
        g = G.counts(self.nodes(), self.edges()).first()
        return {
            "session": {
                "session_id": session_id, "visited_count": s["visited_count"], "frontier_count": s["frontier_count"], "annotation_count": s["annotation_count"],
                "reasoning_count": s["log_count"], "top_frontier": top, "recent_reasoning": recent,
                "age_ms": int(time.time() * 1000 - s["created_at"].timestamp() * 1000) if s["created_at"] else 0,
            },
            "stale_node_count": g.stale_nodes,
            "graph_stats": {"total_nodes": g.total_nodes, "total_edges": g.total_edges, "graph_available": available},
        }

    def expire_sessions(self) -> int:
        """Drop the events of sessions whose last access is too long ago; returns their number."""
        with self._operation(), self._lock:
            seen = self.store.version()
            e = self.events()
            old = durable(e.groupBy("session_id").agg(F.max("ts").alias("last")).filter(F.unix_millis(F.current_timestamp()) - F.unix_millis("last") > self.config.graph.session_ttl_s * 1000).select("session_id"))
            n = old.count()
            if n:
                at = self.store.touched(old, "session_id")
                left = self.store.read("events", schemas.SESSION_EVENT, at).join(old, "session_id", "left_anti").select(*e.columns)
                self.store.replace({"events": (left, "session_id", at)}, seen=seen)
            return n

    def vacuum(self, keep_ms: int | None = None) -> int:
        """Remove folders of the store that nothing names any more."""
        return self.store.vacuum(keep_ms)

    # -- observability --------------------------------------------------------------------------------------------
    def metrics(self) -> dict:
        """Percentiles over the last searches, totals over all, and what was indexed."""
        df = self.spark.createDataFrame(list(self.recorder.samples), "seq bigint, latency_ms double, results int, used_fallback boolean, failed boolean")
        return metrics_summary(df).first().asDict() | self.recorder.totals() | {"query_cache": self.embed_query.cache.stats()}
