"""Chunking and maintenance queries."""

import uuid

from pyspark.sql import functions as F

from quern.functions import text as TX
from quern.operators import chunking as C
from quern.operators import maintenance as M
from quern.operators.durable import durable
from quern.operators.folders import shared_folder
from quern.operators.graph import node_kind
from quern.operators.languages import BY_EXTENSION, language_column
from quern.operators.metrics import index_stats as stats_of
from quern.queries import query, table

_PATH = "'/corpus/' || coalesce(source, 'none') || '/doc_' || doc_id || '.txt'"


def corpus(spark, sf):
    """documents as files."""
    return table(spark, sf, "documents").select(F.concat(F.lit("/corpus/"), F.coalesce("source", F.lit("none")), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), F.col("text").alias("content"), "doc_id")


@query("SELECT file_path, start_line, regexp_replace(file_path, '[^a-zA-Z0-9_-]', '_', 'g') || '_L' || start_line AS chunk_id FROM code_chunks")
def chunk_ids(spark, sf):
    return table(spark, sf, "code_chunks").select("file_path", "start_line", TX.chunk_id(F.col("file_path"), F.col("start_line")).alias("chunk_id"))


@query("SELECT id, regexp_matches(id, '^[A-Za-z0-9_-]+$') AND length(id) <= 500 AS ok FROM graph_nodes")
def valid_ids(spark, sf):
    return table(spark, sf, "graph_nodes").select("id", TX.valid_id(F.col("id")).alias("ok"))


@query(r"""SELECT file_path, '.' || lower(regexp_extract(file_path, '\.([^./]*)$', 1)) AS ext, regexp_extract(file_path, '([^/]*)$', 1) AS base,
  CASE WHEN starts_with(file_path, '/srv/code/') THEN substr(file_path, 11) ELSE file_path END AS rel FROM (SELECT DISTINCT file_path FROM code_chunks)""")
def path_functions(spark, sf):
    p = F.col("file_path")
    return table(spark, sf, "code_chunks").select("file_path").distinct().select("file_path", TX.extension(p).alias("ext"), TX.basename(p).alias("base"), TX.relative_to(p, "/srv/code").alias("rel"))


_WINDOWS = rf"""
WITH d AS (SELECT {_PATH} AS p, string_split(text, E'\n') AS l FROM documents WHERE text IS NOT NULL),
k AS (SELECT p, l, unnest(range(0, CASE WHEN len(l) <= 50 THEN 1 ELSE ceil((len(l) - 5) / 45.0)::INT END)) AS k FROM d),
w AS (SELECT p, k, list_slice(l, k * 45 + 1, least(k * 45 + 50, len(l))) AS s FROM k),
t AS (SELECT p, k, len(s) AS n, array_to_string(s, E'\n') AS c FROM w),
b AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY k) - 1 AS i FROM t WHERE regexp_replace(c, '[\s\x0b\x1c-\x1f]+', '', 'g') <> '')
SELECT regexp_replace(p, '[^a-zA-Z0-9_-]', '_', 'g') || '_L' || (k * 45 + 1) || '_fallback' || i AS id, p AS file_path, md5(c) AS digest, (k * 45 + 1)::INT AS start_line, (k * 45 + n)::INT AS end_line FROM b"""


@query(_WINDOWS)
def line_windows(spark, sf):
    return C.line_windows(corpus(spark, sf)).select("id", "file_path", F.md5("content").alias("digest"), "start_line", "end_line")


@query(r"""
WITH d AS (SELECT doc_id::VARCHAR AS id, text, string_split(text, E'\n') AS l FROM documents WHERE length(text) > 2000),
p AS (SELECT *, greatest(1, ceil(1500 / (length(text) / len(l)::DOUBLE)))::INT AS w FROM d),
o AS (SELECT *, floor(0.15 * w)::INT AS o FROM p),
k AS (SELECT *, unnest(range(0, CASE WHEN len(l) <= w THEN 1 ELSE ceil((len(l) - o) / (w - o)::DOUBLE)::INT END)) AS k FROM o),
s AS (SELECT id, k, w, o, list_slice(l, k * (w - o) + 1, least(k * (w - o) + w, len(l))) AS s FROM k)
SELECT id || '_p' || k AS id, md5(array_to_string(s, E'\n')) AS digest, (1 + k * (w - o))::INT AS start_line, (k * (w - o) + len(s))::INT AS end_line, k::INT AS part_no FROM s
UNION ALL SELECT doc_id::VARCHAR, md5(text), 1, len(string_split(text, E'\n'))::INT, NULL FROM documents WHERE length(text) <= 2000""")
def large_split(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"))
    return C.split_large(d).select("id", F.md5("content").alias("digest"), "start_line", "end_line", "part_no")


@query(r"""SELECT id, length(content) < 50 OR len(list_filter(string_split(content, E'\n'), lambda x: regexp_replace(x, '[\s\x0b\x1c-\x1f]+', '', 'g') <> '')) < 2 AS small, length(content) > 2000 AS large FROM code_chunks""")
def size_gates(spark, sf):
    c = F.col("content")
    return table(spark, sf, "code_chunks").select("id", C.too_small(c).alias("small"), C.too_large(c).alias("large"))


@query(r"""
WITH l AS (SELECT id, content, list_transform(string_split(content, chr(10))[1:5], lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS ls FROM code_chunks),
j AS (SELECT *, list_reduce(ls, lambda s, x: CASE WHEN contains(s, '{') OR contains(s, ':') OR x = '' THEN s ELSE s || ' ' || x END) AS t FROM l)
SELECT id, CASE WHEN content IS NULL OR ls[1] = '' THEN NULL WHEN instr(t, '{') > 1 THEN rtrim(split_part(t, '{', 1)) ELSE t END AS signature FROM j""")
def signature_extract(spark, sf):
    return table(spark, sf, "code_chunks").select("id", C.signature(F.col("content")).alias("signature"))


@query("SELECT md5(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_hash_groups(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null")
    return d.groupBy(TX.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


_IDX = "SELECT file_path, arg_min(content_hash, (id, content_hash)) AS content_hash FROM vector_records WHERE file_path IS NOT NULL GROUP BY 1"


@query(_IDX)
def indexed_files(spark, sf):
    return M.indexed_hashes(table(spark, sf, "vector_records"))


def _delivered(spark, sf):
    from quern.operators.incremental import clean_feed

    return clean_feed(table(spark, sf, "change_feed")).groupBy("file_path").agg(F.max(F.struct("indexed_at", "delivery_id", "content_hash"))["content_hash"].alias("content_hash"))


_DIFF = rf"""
WITH o AS ({_IDX}), n AS (
  SELECT replace(file_path, '\', '/') AS file_path, arg_max(lower(trim(content_hash, E' \t\r\n')), (indexed_at, delivery_id)) AS content_hash
  FROM change_feed WHERE trim(content_hash, E' \t\r\n') <> '' GROUP BY 1)
SELECT coalesce(o.file_path, n.file_path) AS file_path, CASE WHEN o.file_path IS NULL THEN 'new' WHEN n.file_path IS NULL THEN 'deleted' WHEN o.content_hash = n.content_hash THEN 'same' ELSE 'changed' END AS status
FROM o FULL JOIN n ON o.file_path = n.file_path"""


def _diff(spark, sf):
    return M.diff(M.indexed_hashes(table(spark, sf, "vector_records")), _delivered(spark, sf))


@query(_DIFF)
def incremental_diff(spark, sf):
    return _diff(spark, sf)


@query(f"""WITH d AS ({_DIFF}), c AS (SELECT file_path, count(*) AS chunks FROM vector_records GROUP BY 1)
SELECT count(*) FILTER (status <> 'deleted') AS total_files, count(*) FILTER (status IN ('new', 'changed')) AS indexed_files, count(*) FILTER (status IN ('same', 'skipped')) AS skipped_files,
coalesce(sum(chunks) FILTER (status IN ('new', 'changed')), 0)::BIGINT AS total_chunks FROM d LEFT JOIN c USING (file_path)""")
def index_stats(spark, sf):
    chunks = table(spark, sf, "vector_records").groupBy("file_path").agg(F.count("*").alias("chunks"))
    return stats_of(_diff(spark, sf).join(chunks, "file_path", "left"))


@query("""SELECT id, max(indexed_at) AS indexed_at, arg_max(content_hash, (indexed_at, content_hash)) AS content_hash FROM vector_records GROUP BY id""")
def upsert_last_wins(spark, sf):
    r = table(spark, sf, "vector_records").select("id", "indexed_at", "content_hash")
    return M.upsert(r.filter("false"), r)


@query("""SELECT id, file_path FROM vector_records WHERE file_path NOT IN (SELECT replace(file_path, '\\', '/') FROM change_feed WHERE content_hash IS NULL)""".replace("\\\\", "\\"))
def delete_by_file(spark, sf):
    gone = table(spark, sf, "change_feed").filter("content_hash is null").select(F.translate("file_path", "\\", "/").alias("file_path"))
    return M.delete_files(table(spark, sf, "vector_records").select("id", "file_path"), gone)


@query("""
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN (contains(node_type, 'function') OR node_type IN ('method_definition', 'method_declaration')) AND contains(node_type, 'method') THEN 'method'
  WHEN contains(node_type, 'function') THEN 'function' WHEN contains(node_type, 'class') THEN 'class' WHEN contains(node_type, 'interface') THEN 'interface'
  WHEN contains(node_type, 'type_alias') OR contains(node_type, 'type_declaration') THEN 'type' WHEN contains(node_type, 'enum') THEN 'enum'
  WHEN contains(node_type, 'module') OR contains(node_type, 'namespace') OR contains(node_type, 'mod_item') THEN 'module'
  WHEN contains(node_type, 'variable') OR contains(node_type, 'lexical') OR contains(node_type, 'declaration') THEN 'variable' ELSE 'unknown' END AS kind FROM code_chunks) GROUP BY 1""")
def node_kind_counts(spark, sf):
    return table(spark, sf, "code_chunks").groupBy(node_kind(F.col("node_type")).alias("kind")).agg(F.count("*").alias("n"))


_LANGUAGE = "CASE lower(regexp_extract(file_path, '(\\.[^./]+)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{k}'" for e, k in sorted(BY_EXTENSION.items())) + " END"


@query(f"SELECT DISTINCT file_path, {_LANGUAGE} AS language FROM code_chunks")
def file_languages(spark, sf):
    return table(spark, sf, "code_chunks").select("file_path", language_column(F.col("file_path")).alias("language")).distinct()


@query("SELECT id, file_path, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, content_hash DESC, file_path DESC) AS n FROM vector_records WHERE id IS NOT NULL) WHERE n = 1")
def store_upsert(spark, sf):
    """The first rows of all ids committed to a bucketed store, then the last ones of the ids that have others put over them."""
    r = table(spark, sf, "vector_records").filter("id is not null").select("id", "indexed_at", "content_hash", "file_path").distinct()
    key = F.struct("indexed_at", "content_hash", "file_path")
    ends = r.groupBy("id").agg(F.min(key).alias("a"), F.max(key).alias("z"))
    store = M.SnapshotStore(spark, f"{shared_folder(spark)}/records-{uuid.uuid4().hex}", buckets=16)
    store.commit({"r": ends.select("id", "a.*")}, {"r": "id"})
    new = durable(ends.filter("a <> z").select("id", "z.*"))
    at = store.touched(new, "id")
    store.replace({"r": (M.upsert(store.read("r", new.schema, at), new), "id", at)}, seen=store.version())
    out = durable(store.read("r", new.schema).select("id", "file_path", "content_hash"))
    store.folder.delete()
    return out


@query(f"SELECT id, file_path, start_line, end_line FROM ({_WINDOWS})")
def engine_index(spark, sf):
    """All documents as files through the engine's index in two builds: the first with other texts of every second source and
    with files that are gone in the second."""
    from quern.config import IndexConfig
    from quern.engine import Engine

    files = corpus(spark, sf).filter("content is not null").withColumn("content_hash", TX.content_hash(F.col("content")))
    odd = F.pmod(F.crc32(F.col("file_path")), F.lit(2)) == 1
    older = files.withColumn("content", F.when(odd, F.concat(F.col("content"), F.lit("\nmore"))).otherwise(F.col("content")))
    gone = files.filter(odd).withColumn("file_path", F.concat("file_path", F.lit(".old.txt")))
    at = f"{shared_folder(spark)}/engine-{uuid.uuid4().hex}"
    e = Engine(spark, at, IndexConfig("/corpus"))
    e.index(older.unionByName(gone).withColumn("content_hash", TX.content_hash(F.col("content"))))
    e.index(files)
    out = durable(e.records().select("id", "file_path", "start_line", "end_line"))
    e.store.folder.delete()
    return out
