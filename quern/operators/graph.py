"""Symbol graph: edge resolution, bounded breadth-first search, upserts and deletes. All joins are equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.errors import GraphError
from quern.operators.durable import durable
from quern.operators.predicates import edge_kinds

SAME_FILE, CROSS_FILE, LINKED = 1.0, 0.8, 1.0


def node_kind(c: Column) -> Column:
    """Kind of a node type; the order of the cases matters."""
    has = lambda *words: F.expr("false") if not words else _any([c.contains(w) for w in words])
    return (
        F.when((has("function") | c.isin("method_definition", "method_declaration")) & has("method"), "method")
        .when(has("function"), "function")
        .when(has("class"), "class")
        .when(has("interface"), "interface")
        .when(has("type_alias", "type_declaration"), "type")
        .when(has("enum"), "enum")
        .when(has("module", "namespace", "mod_item"), "module")
        .when(has("variable", "lexical", "declaration"), "variable")
        .otherwise("unknown")
    )


BROADCAST = 50_000  # pairs of ids


def _any(cs: list[Column]) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out = out | c
    return out


def nodes_of(chunks: DataFrame) -> DataFrame:
    """Graph nodes of chunks: one per id, the first row by start line and content."""
    part = chunks.select(
        "id", "file_path", F.regexp_replace("name", r" \(part \d+\)$", "").alias("symbol_name"), node_kind(F.col("node_type")).alias("kind"), "start_line", "end_line"
    )
    return part.groupBy("id").agg(F.min(F.struct("start_line", "end_line", "file_path", "symbol_name", "kind")).alias("r")).select("id", "r.*")


def node(nodes: DataFrame, node_id: str) -> DataFrame:
    """The node of an id; the filter reaches the scan."""
    return nodes.filter(F.col("id") == node_id)


def nodes_of_file(nodes: DataFrame, path: str) -> DataFrame:
    """The nodes of a file in the order of their lines."""
    return nodes.filter(F.col("file_path") == path).orderBy("start_line", "id")


def stale(nodes: DataFrame) -> DataFrame:
    """The nodes whose file has changed since they were made."""
    return nodes.filter("stale")


def symbol_index(nodes: DataFrame) -> DataFrame:
    """(symbol, id): one row per node with a symbol; no symbol's ids are ever gathered in one row."""
    return nodes.filter("symbol_name is not null").select(F.col("symbol_name").alias("symbol"), "id").distinct()


def resolve_edges(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of raw references (source_id, source_path, target_symbol, edge_type, module_path).

    A symbol of the same file wins with weight 1.0, else the first by (file_path, start_line, id) of all files with
    0.8. References without a target and references of a chunk to itself are dropped; a same-file candidate that is
    the source itself is not replaced by another file's. Candidates are reduced to one per symbol, and one per symbol
    and file, before they are joined, so a symbol defined everywhere multiplies nothing.
    """
    first = F.min(F.struct("file_path", "start_line", "id"))
    named = nodes.filter("symbol_name is not null")
    local = named.groupBy(F.col("symbol_name").alias("target_symbol"), F.col("file_path").alias("source_path")).agg(first["id"].alias("local_id"))
    anywhere = named.groupBy(F.col("symbol_name").alias("target_symbol")).agg(first["id"].alias("any_id"))
    hit = raw.join(local, ["target_symbol", "source_path"], "left").join(anywhere, "target_symbol")
    same = F.col("local_id").isNotNull()
    return (
        hit.select(
            "source_id",
            F.coalesce("local_id", "any_id").alias("target_id"),
            "edge_type",
            F.when(same, SAME_FILE).otherwise(CROSS_FILE).alias("weight"),
            F.when(same, F.col("module_path")).otherwise(F.coalesce("module_path", "target_symbol")).alias("metadata"),
        )
        .filter("source_id <> target_id")
    )


def bfs(edges: DataFrame, roots: DataFrame, depth: int = 2, kinds=None) -> DataFrame:
    """(root_id, node_id, depth, via, edge_type, weight, outgoing): nodes within ``depth`` undirected hops of each root.

    A node counts once per root, at its least depth and with the edge that found it: outgoing first, then by the
    parent, edge type and greatest weight. ``depth`` is held between 1 and 5. Each level is one equi-join of the
    frontier with the adjacency, an aggregation and an anti-join; a level that feeds another is kept, and a frontier of up to
    ``BROADCAST`` rows is broadcast, so the edges of a hub are not shuffled for it. ``roots`` has a column root_id.
    """
    depth = min(5, max(1, depth))
    e = edges.filter(edge_kinds(kinds))
    adjacent = e.select(F.col("source_id").alias("at"), F.col("target_id").alias("node_id"), "edge_type", "weight", F.lit(True).alias("outgoing")).unionByName(
        e.select(F.col("target_id").alias("at"), F.col("source_id").alias("node_id"), "edge_type", "weight", F.lit(False).alias("outgoing"))
    )
    root = roots.select("root_id").distinct()
    if depth > 1:
        adjacent, root = durable(adjacent), durable(root)
    seen = root.select("root_id", F.col("root_id").alias("node_id"))
    frontier, found = seen, None
    for d in range(1, depth + 1):
        small = depth > 1 and frontier.count() <= BROADCAST
        step = (
            (F.broadcast(frontier) if small else frontier).withColumnRenamed("node_id", "at").join(adjacent, "at")
            .groupBy("root_id", "node_id")
            .agg(F.min(F.struct((~F.col("outgoing")).alias("rank"), F.col("at").alias("via"), "edge_type", (-F.col("weight")).alias("w"))).alias("r"))
            .join(seen, ["root_id", "node_id"], "left_anti")
            .select("root_id", "node_id", F.lit(d).alias("depth"), F.col("r.via").alias("via"), F.col("r.edge_type").alias("edge_type"), (-F.col("r.w")).alias("weight"), (~F.col("r.rank")).alias("outgoing"))
        )
        if d < depth:  # it feeds the next level three times
            step = durable(step)
        found = step if found is None else found.unionByName(step)
        frontier = step.select("root_id", "node_id")
        seen = seen.unionByName(frontier)
    return found


def neighbors(edges: DataFrame, nodes: DataFrame, roots: DataFrame, depth: int = 1, kinds=None) -> DataFrame:
    """Neighbours with their node's columns, ``direction`` as seen from the root and ``hop_direction`` from the parent."""
    f = bfs(edges, roots, depth, kinds)
    n = nodes.select(F.col("id").alias("node_id"), "file_path", "symbol_name", "kind")
    direct = (F.col("via") == F.col("root_id")) & F.col("outgoing")
    return f.join(n, "node_id").select(
        "root_id", "node_id", "file_path", "symbol_name", "kind", "edge_type", "depth", "weight",
        F.when(direct, "outgoing").otherwise("incoming").alias("direction"),
        F.when(F.col("outgoing"), "outgoing").otherwise("incoming").alias("hop_direction"),
    )


def collect_neighbors(neighbours: DataFrame, shown: int = 5) -> DataFrame:
    """(root_id, total, shown): the number of neighbours of each root and its first ones by depth and id."""
    w = Window.partitionBy("root_id").orderBy("depth", "node_id")
    top = neighbours.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= shown)
    lists = top.groupBy("root_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "node_id"))), lambda x: x["node_id"]).alias("shown"))
    return neighbours.groupBy("root_id").agg(F.count("*").alias("total")).join(lists, "root_id")


def last_wins(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of both, for each key the newest; within ``new`` the greatest by ``order`` (all other columns without it).

    One aggregation with map-side combination instead of a sort, so a key that is repeated very often stays cheap.
    """
    rest = [c for c in new.columns if c not in keys]
    first = [*(order or []), *[c for c in rest if c not in (order or [])]]
    both = old.select(*new.columns).withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return both.groupBy(*keys).agg(F.max(F.struct("_v", *first)).alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in rest]).select(*new.columns)


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    return last_wins(old, new, ["id"], ["updated_at"] if "updated_at" in new.columns else None)


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    return last_wins(old, new, ["source_id", "target_id", "edge_type"])


def delete_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those of the files in ``paths`` (column file_path)."""
    gone = nodes.join(paths.select("file_path").distinct(), "file_path", "left_semi").select("id").distinct()
    kept = nodes.join(paths.select("file_path").distinct(), "file_path", "left_anti")
    e = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return kept, e.select(*edges.columns)


def cascade(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are among the nodes."""
    ids = nodes.select("id").distinct()
    e = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return e.select(*edges.columns)


def mark_stale(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    p = paths.select("file_path").distinct().withColumn("_s", F.lit(True))
    return nodes.join(p, "file_path", "left").withColumn("stale", F.col("stale") | F.coalesce("_s", F.lit(False))).select(*nodes.columns)


def link(source_id: str, targets: list[str], note: str | None, nodes: DataFrame) -> list[tuple]:
    """Rows of agent-made edges; links to itself are removed, a target that is no node is an error."""
    want = sorted({t for t in targets if t != source_id})
    ids = [source_id, *want]
    have = {r.id for r in nodes.filter(F.col("id").isin(ids)).select("id").distinct().collect()}  # ids asked for
    if missing := sorted(set(ids) - have):
        raise GraphError("no such node", ids=missing)
    return [(source_id, t, "agent_linked", LINKED, note) for t in want]


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, stale nodes."""
    n = nodes.agg(F.count("*").alias("total_nodes"), F.count_if("stale").alias("stale_nodes"))
    return n.crossJoin(edges.agg(F.count("*").alias("total_edges")))  # one row each
