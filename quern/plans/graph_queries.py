"""Graph queries over graph_nodes and graph_edges."""

from pyspark.sql import functions as F

from quern.operators import graph as G
from quern.operators.sessions import frontier_priority
from quern.queries import query, table


def _nodes(spark, sf):
    return table(spark, sf, "graph_nodes").distinct()


def _edges(spark, sf):
    return G.upsert_edges(table(spark, sf, "graph_edges").filter("false"), table(spark, sf, "graph_edges"))


_E = "e AS (SELECT source_id, target_id, edge_type, max((weight, coalesce(metadata, ''))) AS t FROM graph_edges GROUP BY ALL)"


@query("SELECT source_id, target_id, edge_type, arg_max(weight, (weight, coalesce(metadata, ''))) AS weight, nullif(arg_max(coalesce(metadata, ''), (weight, coalesce(metadata, ''))), '') AS metadata FROM graph_edges GROUP BY ALL")
def edge_upsert(spark, sf):
    return _edges(spark, sf)


@query("SELECT DISTINCT symbol_name AS symbol, id FROM graph_nodes WHERE symbol_name IS NOT NULL")
def symbol_index(spark, sf):
    return G.symbol_index(_nodes(spark, sf))


def _raw(spark, sf):
    n = _nodes(spark, sf)
    e = _edges(spark, sf)
    return (
        e.join(n.select(F.col("id").alias("source_id"), F.col("file_path").alias("source_path")), "source_id")
        .join(n.select(F.col("id").alias("target_id"), F.col("symbol_name").alias("target_symbol")), "target_id")
        .filter("target_symbol is not null")
        .select("source_id", "source_path", "target_symbol", "edge_type", F.col("metadata").alias("module_path"))
    )


@query(f"""
WITH n AS (SELECT DISTINCT * FROM graph_nodes), {_E}, raw AS (
  SELECT e.source_id, s.file_path AS source_path, t.symbol_name AS target_symbol, e.edge_type, nullif((e.t)[2], '') AS module_path
  FROM e JOIN n s ON s.id = e.source_id JOIN n t ON t.id = e.target_id WHERE t.symbol_name IS NOT NULL
), l AS (SELECT symbol_name, file_path, arg_min(id, (file_path, start_line, id)) AS local_id FROM n WHERE symbol_name IS NOT NULL GROUP BY ALL),
a AS (SELECT symbol_name, arg_min(id, (file_path, start_line, id)) AS any_id FROM n WHERE symbol_name IS NOT NULL GROUP BY ALL)
SELECT source_id, coalesce(local_id, any_id) AS target_id, edge_type, CASE WHEN local_id IS NULL THEN 0.8 ELSE 1.0 END::DOUBLE AS weight,
  CASE WHEN local_id IS NULL THEN coalesce(module_path, target_symbol) ELSE module_path END AS metadata
FROM raw LEFT JOIN l ON l.symbol_name = target_symbol AND l.file_path = source_path JOIN a ON a.symbol_name = target_symbol WHERE source_id <> coalesce(local_id, any_id)""")
def resolve_edges(spark, sf):
    return G.resolve_edges(_raw(spark, sf), _nodes(spark, sf))


_ADJ = """adj AS (SELECT source_id AS a, target_id AS b, edge_type FROM graph_edges UNION SELECT target_id, source_id, edge_type FROM graph_edges)"""


@query(f"WITH {_ADJ} SELECT a AS root_id, b AS node_id, 1 AS depth FROM adj WHERE a <> b AND a IN (SELECT id FROM graph_nodes) GROUP BY ALL")
def bfs_k1(spark, sf):
    return G.bfs(_edges(spark, sf), _nodes(spark, sf).select(F.col("id").alias("root_id")), 1).select("root_id", "node_id", "depth")


def _roots(spark, sf):
    """Start nodes: those whose hash is divisible by 50, a set that grows with the table, and the most referenced node."""
    e = table(spark, sf, "graph_edges").groupBy(F.col("target_id").alias("root_id")).agg(F.count("*").alias("n"))
    hub = e.orderBy(F.desc("n"), "root_id").limit(1).select("root_id")
    some = table(spark, sf, "graph_nodes").filter(F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("bigint") % 50 == 0).select(F.col("id").alias("root_id"))
    return hub.unionByName(some)


_DIGITS = " + ".join(f"(strpos('0123456789abcdef', substr(md5(id), {6 - k}, 1)) - 1) * {16 ** k}" for k in range(6))
_ROOTS = f"""roots AS (SELECT target_id AS r FROM (SELECT target_id, count(*) AS n FROM graph_edges GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1) UNION SELECT id FROM graph_nodes WHERE ({_DIGITS}) % 50 = 0)"""


def _bfs_sql(k, kinds=""):
    return f"""WITH RECURSIVE {_ADJ}, {_ROOTS}, walk(r, n, d) AS (
  SELECT r, r, 0 FROM roots UNION SELECT walk.r, adj.b, walk.d + 1 FROM walk JOIN adj ON adj.a = walk.n WHERE walk.d < {k} {kinds}
) SELECT r AS root_id, n AS node_id, min(d) AS depth FROM walk GROUP BY ALL HAVING min(d) > 0"""


for _k in (2, 3):
    query(_bfs_sql(_k), f"bfs_k{_k}")(lambda spark, sf, k=_k: G.bfs(_edges(spark, sf), _roots(spark, sf), k).select("root_id", "node_id", "depth"))


@query(_bfs_sql(2, "AND edge_type IN ('calls', 'extends')"))
def bfs_kinds(spark, sf):
    return G.bfs(_edges(spark, sf), _roots(spark, sf), 2, ["calls", "extends"]).select("root_id", "node_id", "depth")


@query(f"""WITH {_ADJ}, p AS (SELECT DISTINCT a AS root_id, b AS node_id FROM adj WHERE a <> b AND b IN (SELECT id FROM graph_nodes) AND a IN (SELECT id FROM graph_nodes)),
r AS (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY node_id) AS n FROM p)
SELECT root_id, count(*) AS total, list(node_id ORDER BY n) FILTER (n <= 5) AS shown FROM r GROUP BY 1""")
def neighbors_collect(spark, sf):
    n = _nodes(spark, sf)
    return G.collect_neighbors(G.neighbors(_edges(spark, sf), n, n.select(F.col("id").alias("root_id")), 1))


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT * FROM graph_nodes)) AS total_nodes, (SELECT count(*) FROM (SELECT DISTINCT * FROM graph_nodes) WHERE stale) AS stale_nodes, (SELECT count(*) FROM (SELECT DISTINCT source_id, target_id, edge_type FROM graph_edges)) AS total_edges")
def graph_counts(spark, sf):
    return G.counts(_nodes(spark, sf), _edges(spark, sf))


@query("SELECT DISTINCT source_id, target_id, edge_type FROM graph_edges WHERE source_id IN (SELECT id FROM graph_nodes WHERE NOT stale) AND target_id IN (SELECT id FROM graph_nodes WHERE NOT stale)")
def cascade_delete(spark, sf):
    return G.cascade(_edges(spark, sf), _nodes(spark, sf).filter("not stale")).select("source_id", "target_id", "edge_type")


@query("""WITH f AS (SELECT DISTINCT file_path FROM graph_nodes WHERE stale), g AS (SELECT id FROM graph_nodes WHERE file_path IN (SELECT file_path FROM f))
SELECT DISTINCT source_id, target_id, edge_type FROM graph_edges WHERE source_id NOT IN (SELECT id FROM g) AND target_id NOT IN (SELECT id FROM g)""")
def graph_delete_files(spark, sf):
    n = _nodes(spark, sf)
    return G.delete_files(n, _edges(spark, sf), n.filter("stale"))[1].select("source_id", "target_id", "edge_type")


@query("SELECT DISTINCT id, file_path, stale OR file_path IN (SELECT file_path FROM graph_nodes WHERE stale) AS stale FROM graph_nodes")
def mark_stale(spark, sf):
    n = _nodes(spark, sf)
    return G.mark_stale(n, n.filter("stale")).select("id", "file_path", "stale")


@query("SELECT DISTINCT id, symbol_name, kind FROM graph_nodes WHERE file_path = (SELECT min(file_path) FROM graph_nodes)")
def nodes_by_file(spark, sf):
    n = _nodes(spark, sf)
    return n.join(n.agg(F.min("file_path").alias("file_path")), "file_path", "left_semi").select("id", "symbol_name", "kind")


@query("SELECT DISTINCT id, file_path, updated_at FROM graph_nodes WHERE stale")
def stale_nodes(spark, sf):
    return _nodes(spark, sf).filter("stale").select("id", "file_path", "updated_at")


@query("SELECT DISTINCT id, file_path, symbol_name, kind, false AS stale FROM graph_nodes")
def node_upsert(spark, sf):
    """Stale nodes taken up anew: the last write of an id wins."""
    n = _nodes(spark, sf)
    fresh = n.filter("stale").withColumn("stale", F.lit(False)).withColumn("updated_at", F.col("updated_at") + F.expr("interval 1 day"))
    return G.upsert_nodes(n, fresh).select("id", "file_path", "symbol_name", "kind", "stale")


@query("SELECT DISTINCT id, file_path, symbol_name, kind FROM graph_nodes WHERE id = (SELECT max(id) FROM graph_nodes)")
def node_by_id(spark, sf):
    n = _nodes(spark, sf)
    return G.node(n, n.agg(F.max("id")).first()[0]).select("id", "file_path", "symbol_name", "kind")


@query("""WITH e AS (SELECT source_id, target_id, edge_type, arg_max(weight, (weight, coalesce(metadata, ''))) AS weight FROM graph_edges GROUP BY ALL),
adj AS (SELECT source_id AS a, target_id AS b, edge_type, weight, true AS o FROM e UNION ALL SELECT target_id, source_id, edge_type, weight, false FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY NOT o, edge_type, weight DESC) AS n FROM adj WHERE a <> b AND a IN (SELECT id FROM graph_nodes) AND b IN (SELECT id FROM graph_nodes))
SELECT a AS root_id, b AS node_id, edge_type, weight, CASE WHEN o THEN 'outgoing' ELSE 'incoming' END AS direction, CASE WHEN o THEN 'outgoing' ELSE 'incoming' END AS hop_direction, weight / 1 AS priority FROM r WHERE n = 1""")
def neighbors_directions(spark, sf):
    """Direct neighbours of every node with their directions, and the priority that they get on a frontier."""
    n = _nodes(spark, sf)
    g = G.neighbors(_edges(spark, sf), n, n.select(F.col("id").alias("root_id")), 1)
    return g.select("root_id", "node_id", "edge_type", "weight", "direction", "hop_direction", frontier_priority(F.col("weight"), F.col("depth")).alias("priority"))
