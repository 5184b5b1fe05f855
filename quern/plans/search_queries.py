"""Search queries over the current vector records and the embeddings."""

import uuid

from pyspark.sql import functions as F

from quern.functions import text as TX
from quern.functions.vectors import usable
from quern.operators import predicates as P
from quern.operators import search as S
from quern.operators import textindex as TI
from quern.operators.durable import durable
from quern.operators.folders import shared_folder
from quern.operators.maintenance import SnapshotStore
from quern.queries import query, table

QUERY = "filter index row cache"  # keywords of the sample searches
_COLS = ("content_hash", "content", "file_path", "name", "signature", "language", "node_type", "start_line", "end_line", "vector")


def current_records(spark, sf):
    """The current row of every id of vector_records."""
    r = table(spark, sf, "vector_records").groupBy("id").agg(F.max(F.struct("indexed_at", *_COLS)).alias("r"))
    return r.select("id", *[F.col("r")[c].alias(c) for c in _COLS])


CURRENT = """cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, content_hash DESC, content DESC) AS rn FROM vector_records) WHERE rn = 1)"""
USABLE = "vec AS (SELECT * FROM cur WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: NOT isfinite(x))) = 0)"
_COS = "list_cosine_similarity({}::DOUBLE[], {}::DOUBLE[])"


def _vec(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _query_vector(spark, sf):
    return table(spark, sf, "embeddings").filter("vec_id = 0").first()["embedding"]


def _scores(df, *more):
    return df.select("id", *more, F.round("vector_score", 6).alias("vector_score"))


_TOP = f"""SELECT e.vec_id AS id, e.label, round({_COS.format('e.embedding', 'q.embedding')}, 6) AS vector_score
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q {{where}} ORDER BY {_COS.format('e.embedding', 'q.embedding')} DESC, e.vec_id LIMIT 10"""


@query(_TOP.format(where=""))
def vector_topk(spark, sf):
    return _scores(S.vector_topk(_vec(spark, sf), _query_vector(spark, sf), 10), "label")


@query(_TOP.format(where="WHERE e.label = 3"))
def vector_topk_filtered(spark, sf):
    return _scores(S.vector_topk(_vec(spark, sf), _query_vector(spark, sf), 10, F.col("label") == 3), "label")


@query(f"""
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS.format('e.embedding', 'q.embedding')} AS s FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)
SELECT query_id, id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id)::INT AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) <= 10""")
def vector_topk_batch(spark, sf):
    v = _vec(spark, sf)
    q = v.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return S.vector_topk_batch(v, q, 10).withColumn("score", F.round("score", 6))


def _has(c, w):
    return f"contains(lower(coalesce({c}, '')), '{w}')"


_TEXT = "(" + " + ".join(f"(CASE WHEN {_has(c, w)} THEN {x} ELSE 0.0 END)::DOUBLE" for w in QUERY.split() for c, x in (("content", 1.0), ("name", 2.0), ("signature", 1.5))) + f") / {4.0 * len(QUERY.split())}"
_BOOST = "(" + " + ".join(
    f"(CASE WHEN {_has('content', w)} THEN 0.1 ELSE 0.0 END)::DOUBLE + (CASE WHEN {_has('name', w)} THEN 0.2 ELSE 0.0 END)::DOUBLE + (CASE WHEN {_has('signature', w)} THEN 0.15 ELSE 0.0 END)::DOUBLE"
    f" + (CASE WHEN list_contains(regexp_split_to_array(lower(coalesce(name, '')), '\\W+'), '{w}') THEN 0.25 ELSE 0.0 END)::DOUBLE"
    for w in QUERY.split()
) + ")"


@query(f"WITH {CURRENT} SELECT id, round({_TEXT}, 6) AS score FROM cur WHERE {_TEXT} > 0")
def keyword_score(spark, sf):
    return current_records(spark, sf).select("id", F.round(S.text_score(QUERY), 6).alias("score")).filter("score > 0")


@query(f"WITH {CURRENT} SELECT id, file_path, round({_TEXT}, 6) AS combined_score FROM cur WHERE {_TEXT} > 0 ORDER BY {_TEXT} DESC, id LIMIT 50")
def keyword_search(spark, sf):
    return S.keyword_search(current_records(spark, sf), QUERY, 50).select("id", "file_path", F.round("combined_score", 6).alias("combined_score"))


@query(f"WITH {CURRENT} SELECT id, round(least(0.3 + {_BOOST}, 1.0), 6) AS score FROM cur")
def keyword_boost(spark, sf):
    return current_records(spark, sf).select("id", F.round(S.boosted(F.lit(0.3), QUERY), 6).alias("score"))


def _searchable(spark, sf):
    return current_records(spark, sf).filter(usable(F.col("vector"), 64))


_HYBRID = f"""
WITH {CURRENT}, {USABLE}, q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), s AS (
  SELECT id, content, name, signature, coalesce(CASE WHEN list_sum(list_transform(vector, lambda x: x::DOUBLE * x)) = 0 THEN 0.0 ELSE {_COS.format('vector', 'embedding')} END, 0.0) AS v, {_BOOST} AS b FROM vec, q {{where}}
), t AS (SELECT * FROM s ORDER BY v DESC, id LIMIT {{n}})"""


@query(_HYBRID.format(where="", n=10) + " SELECT id, round(v, 6) AS vector_score, round(least(v + b, 1.0), 6) AS combined_score, round(least(v + b, 1.0) - v, 6) AS keyword_score FROM t")
def hybrid_no_rerank(spark, sf):
    h = S.hybrid_search(_searchable(spark, sf), QUERY, _query_vector(spark, sf), 10)
    return h.select("id", *[F.round(c, 6).alias(c) for c in ("vector_score", "combined_score", "keyword_score")])


@query(_HYBRID.format(where="WHERE language IN ('typescript', 'ts', 'tsx') AND (file_path = '/srv/code/bucketbase' OR starts_with(file_path, '/srv/code/bucketbase/'))", n=10)
       + " SELECT id, round(v, 6) AS vector_score, round(least(v + b, 1.0), 6) AS combined_score FROM t")
def hybrid_filtered(spark, sf):
    where = P.search_filter("/srv/code/bucketbase") & P.language_is("typescript")
    h = S.hybrid_search(_searchable(spark, sf), QUERY, _query_vector(spark, sf), 10, where)
    return h.select("id", *[F.round(c, 6).alias(c) for c in ("vector_score", "combined_score")])


_WORDS = ", ".join(f"'{w}'" for w in QUERY.split())


@query(_HYBRID.format(where="", n=50) + f""", w AS (
  SELECT id, v, list_filter(regexp_split_to_array(lower(left(content, 512)), '\\s+'), lambda x: x <> '') AS ws FROM t
), r AS (
  SELECT id, v, len(list_filter([{_WORDS}], lambda x: list_contains(ws, x))) / {float(len(QUERY.split()))} + 0.001 * least(50, len(list_filter(ws, lambda x: list_contains([{_WORDS}], x)))) AS score FROM w
) SELECT id, round(v, 6) AS vector_score, round(score, 6) AS combined_score FROM r ORDER BY score DESC, v DESC, id LIMIT 10""")
def hybrid_rerank(spark, sf):
    h = S.hybrid_search(_searchable(spark, sf), QUERY, _query_vector(spark, sf), 10, use_rerank=True)
    return h.select("id", F.round("vector_score", 6).alias("vector_score"), F.round("combined_score", 6).alias("combined_score"))


_BM25 = r"""
WITH d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL),
f AS (SELECT id, len(t) AS dl, """ + ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(["cache", "index", "rows"])) + r""" FROM d),
s AS (SELECT count(*) AS n, avg(dl) AS a, """ + ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(3)) + r""" FROM f)
SELECT id, round(score, 6) AS score FROM (SELECT id, """ + " + ".join(
    f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / a))" for i in range(3)
) + """ AS score FROM f, s WHERE f0 + f1 + f2 > 0) ORDER BY score DESC, id LIMIT 20"""


@query(_BM25)
def bm25_topk(spark, sf):
    d = table(spark, sf, "documents")
    return S.bm25_topk(d, "index rows cache", 20, "doc_id", "text").select("id", F.round("score", 6).alias("score"))


def _stored(spark, sf, **tables):
    """Tables written to a store in the shared folder and read back from it."""
    store = SnapshotStore(spark, f"{shared_folder(spark)}/text-{uuid.uuid4().hex}", buckets=8)
    store.commit(tables, dict.fromkeys(tables, "id"))
    return store


@query(_BM25.replace("SELECT id, round(score", "SELECT id::VARCHAR AS id, round(score").replace("ORDER BY score DESC, id LIMIT", "ORDER BY score DESC, id::VARCHAR LIMIT"))
def bm25_indexed(spark, sf):
    d = table(spark, sf, "documents")
    store = _stored(spark, sf, postings=TI.postings(d, "doc_id", "text"), lengths=TI.lengths(d, "doc_id", "text"))
    out = durable(TI.bm25(store.read("postings"), store.read("lengths"), "index rows cache", 20).select("id", F.round("score", 6).alias("score")))
    store.folder.delete()
    return out


@query(f"WITH {CURRENT} SELECT id, file_path, round({_TEXT}, 6) AS combined_score FROM cur WHERE {_TEXT} > 0 ORDER BY {_TEXT} DESC, id LIMIT 50")
def keyword_indexed(spark, sf):
    r = current_records(spark, sf)
    store = _stored(spark, sf, postings=TI.postings(r, more=("name", "signature"), path="file_path"))
    out = durable(TI.keyword_search(r, store.read("postings"), QUERY, 50).select("id", "file_path", F.round("combined_score", 6).alias("combined_score")))
    store.folder.delete()
    return out


@query(r"""
SELECT term, count(*) AS docs, sum(tf)::BIGINT AS occurrences FROM (
  SELECT doc_id, term, count(*) AS tf FROM (
    SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM documents) GROUP BY ALL) GROUP BY term""")
def inverted_index(spark, sf):
    i = S.inverted_index(table(spark, sf, "documents"), "doc_id", "text")
    return i.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("occurrences"))


def _filtered(where):
    return lambda spark, sf: table(spark, sf, "code_chunks").filter(where()).select("id", "file_path", "language")


for _name, _where, _sql in (
    ("filter_path_prefix", lambda: P.under_path("/srv/code/bucketbase"), "file_path = '/srv/code/bucketbase' OR starts_with(file_path, '/srv/code/bucketbase/')"),
    ("filter_path_compat", lambda: P.under_path("/srv/code/bucketbase", compat=True), "id LIKE '_srv_code_bucketbase%'"),
    ("filter_language", lambda: P.language_is("python"), "language IN ('python', 'py', 'pyw')"),
    ("filter_glob", lambda: P.matches_glob("**/auth/**/*.ts"), r"regexp_matches(file_path, '^(?:.*/)?auth/(?:.*/)?[^/]*\.ts$')"),
    ("filter_glob_compat", lambda: P.matches_glob("**/auth/*_L*", compat=True), "id LIKE '%%_auth_%_L%'"),
    ("filter_extension", lambda: P.matches_glob("*.c"), "file_path LIKE '%.c'"),
    ("filter_combined", lambda: P.search_filter("/srv/code/ledgerflow-docs", "*.ts"), "(file_path = '/srv/code/ledgerflow-docs' OR starts_with(file_path, '/srv/code/ledgerflow-docs/')) AND file_path LIKE '%.ts'"),
):
    query(f"SELECT id, file_path, language FROM code_chunks WHERE {_sql}", _name)(_filtered(_where))


@query(f"WITH {CURRENT} SELECT id, (len(vector) > 0 AND len(list_filter(vector, lambda x: NOT isfinite(x))) = 0 AND len(vector) = 64) AS ok FROM cur")
def embedding_validate(spark, sf):
    return current_records(spark, sf).select("id", usable(F.col("vector"), 64).alias("ok"))


@query("SELECT doc_id, ceil(length(left(text, 32768)) / 4)::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", TX.token_estimate(F.col("text")).alias("tokens"))


@query(f"""WITH {CURRENT}, {USABLE}, q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), s AS (
  SELECT *, coalesce(CASE WHEN list_sum(list_transform(vector, lambda x: x::DOUBLE * x)) = 0 THEN 0.0 ELSE {_COS.format('vector', 'embedding')} END, 0.0) AS v FROM vec, q ORDER BY v DESC, id LIMIT 10)
SELECT file_path AS file, start_line, end_line, name, node_type, floor(v * 100 + 0.5) / 100 AS score, signature FROM s""")
def search_output(spark, sf):
    t = S.vector_topk(_searchable(spark, sf), _query_vector(spark, sf), 10)
    return t.select(F.col("file_path").alias("file"), "start_line", "end_line", "name", "node_type", TX.round2(F.col("vector_score")).alias("score"), "signature")
