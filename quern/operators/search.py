"""Retrieval: exact vector top-k, keyword scores and boosts, BM25, hybrid search and reranking.

A search is one plan: filter, score, ``TakeOrderedAndProject``. Filters are Columns in front of the limit and reach
the scan; every order ends in the id. Batches of queries run block by block against all rows, with the best ``k`` of
each block kept where the rows lie, so that only ``k`` rows per query and block are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import keywords
from quern.functions.vectors import cosine, literal

# What a keyword adds where it is found.
BOOST_CONTENT, BOOST_NAME, BOOST_SIGNATURE, BOOST_NAME_TOKEN = 0.10, 0.20, 0.15, 0.25
TEXT_CONTENT, TEXT_NAME, TEXT_SIGNATURE, TEXT_DIVISOR = 1.0, 2.0, 1.5, 4.0
RERANK_CHARS = 512


def vector_topk(df: DataFrame, query: Sequence[float], k: int = 50, where: Column | None = None, vector: str = "vector", id_col: str = "id") -> DataFrame:
    """The ``k`` rows with the greatest cosine, as ``vector_score``."""
    rows = df if where is None else df.filter(where)
    return rows.withColumn("vector_score", cosine(F.col(vector), literal(query))).orderBy(F.desc("vector_score"), id_col).limit(k)


def _best(ids: list, q: np.ndarray, v: np.ndarray, k: int):
    """(query ids, row numbers, scores) of the ``k`` best rows of each query, with ties at the edge; rows with a zero norm score 0."""
    n = np.linalg.norm(v, axis=1, keepdims=True)
    v = np.where(n > 0, v / np.where(n > 0, n, 1), 0)
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    m = min(k, len(v))
    step = max(1, 8_000_000 // max(1, len(v)))
    for lo in range(0, len(q), step):
        s = q[lo : lo + step] @ v.T
        j, i = np.nonzero(s >= np.partition(s, len(v) - m, axis=1)[:, len(v) - m, None])
        yield [ids[lo + x] for x in j], i, s[j, i]


def _matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors as rows; zeros for those that are null or of another length."""
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    out = np.zeros((len(a), dim))
    good = pc.fill_null(pc.equal(pc.list_value_length(a), dim), False).to_numpy(zero_copy_only=False)
    flat = a.filter(pa.array(good)).flatten()
    out[good] = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).reshape(-1, dim)
    return out


QUERIES, ROWS = 4096, 65_536  # in a block
BROADCAST_QUERIES = 4096  # queries that may be sent to all tasks


def vector_topk_batch(df: DataFrame, queries: DataFrame, k: int = 10, vector: str = "vector", id_col: str = "id", dim: int | None = None) -> DataFrame:
    """(query_id, id, score, rank) for every row (query_id, query_vector) of ``queries`` against all rows of ``df``.

    Rows with another dimension, without a vector or with a zero norm score 0, as in the single search. Up to
    ``BROADCAST_QUERIES`` queries go to all tasks and each partition keeps its best; more are cut into blocks, as are the
    rows, and pairs of blocks meet by an equi-join on the numbers of both, so the driver holds no queries and a task one pair.
    """
    kind = df.schema[id_col].dataType.simpleString()
    qkind = queries.schema["query_id"].dataType.simpleString()
    queries = queries.select("query_id", "query_vector").filter("query_id is not null and query_vector is not null")
    if dim is None:
        first = queries.select(F.size("query_vector").alias("n")).first()
        dim = first.n if first else 0
    schema = f"query_id {qkind}, {id_col} {kind}, score double"
    nq = queries.count()
    if not nq:
        return df.sparkSession.createDataFrame([], f"{schema}, rank int")

    def batch(ids, rows, q, v):
        for x, i, s in _best(ids, q, v, k):
            yield pa.RecordBatch.from_arrays([pa.array(x).cast(_arrow(qkind)), rows.take(pa.array(i)), pa.array(s)], ["query_id", id_col, "score"])

    if nq <= BROADCAST_QUERIES:
        held = queries.collect()  # BROADCAST_QUERIES rows at most
        ids = [r.query_id for r in held]
        q = np.array([r.query_vector if len(r.query_vector) == dim else [0.0] * dim for r in held], dtype=np.float64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _tables(batches, ROWS):
                yield from batch(ids, t.column(0).combine_chunks(), q, _matrix(t.column(1), dim))

        parts = df.select(id_col, vector).mapInArrow(run, schema)
    else:
        cuts = lambda n, width: max(1, -(-n // width))
        nr = cuts(df.count(), ROWS)
        nb = cuts(nq, QUERIES)
        left = df.select(id_col, vector, F.pmod(F.xxhash64(id_col, vector), F.lit(nr)).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("j"))
        right = queries.select("*", F.explode(F.sequence(F.lit(0), F.lit(nr - 1))).alias("i"), F.pmod(F.xxhash64("query_id"), F.lit(nb)).alias("j"))

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            out = [pa.RecordBatch.from_pylist([], schema=pa.schema([("query_id", _arrow(qkind)), (id_col, _arrow(kind)), ("score", pa.float64())]))]
            if len(a) and len(b):
                out += batch(b.column("query_id").to_pylist(), a.column(id_col).combine_chunks(), _matrix(b.column("query_vector"), dim), _matrix(a.column(vector), dim))
            return pa.Table.from_batches(out)

        parts = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), id_col)
    return parts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _tables(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches joined to tables of about ``rows`` rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def _has(c: str, kw: str) -> Column:
    return F.coalesce(F.lower(c), F.lit("")).contains(kw)


def _weight(hit: Column, w: float) -> Column:
    return F.when(hit, F.lit(w)).otherwise(F.lit(0.0))


def _sum(parts: list[Column]) -> Column:
    out = F.lit(0.0)
    for p in parts:
        out = out + p
    return out


def text_score(query: str) -> Column:
    """Share of the query's keywords found in content, name and signature; may exceed 1."""
    kws = keywords(query)
    if not kws:
        return F.lit(0.0)
    parts = [
        _weight(_has("content", kw), TEXT_CONTENT) + _weight(_has("name", kw), TEXT_NAME) + _weight(_has("signature", kw), TEXT_SIGNATURE)
        for kw in kws
    ]
    return _sum(parts) / F.lit(TEXT_DIVISOR * len(kws))


def keyword_boost(query: str) -> Column:
    """What the keywords of a query add to a score."""
    tokens = F.split(F.coalesce(F.lower("name"), F.lit("")), r"\W+")
    return _sum(
        [
            _weight(_has("content", kw), BOOST_CONTENT)
            + _weight(_has("name", kw), BOOST_NAME)
            + _weight(_has("signature", kw), BOOST_SIGNATURE)
            + _weight(F.array_contains(tokens, kw), BOOST_NAME_TOKEN)
            for kw in keywords(query)
        ]
    )


def boosted(score: Column, query: str) -> Column:
    return F.least(score + keyword_boost(query), F.lit(1.0))


def keyword_search(df: DataFrame, query: str, k: int = 50, where: Column | None = None) -> DataFrame:
    """Rows by text score, greatest first; rows without any keyword are dropped. Filters apply before the limit."""
    rows = df if where is None else df.filter(where)
    return (
        rows.withColumn("combined_score", text_score(query))
        .filter(F.col("combined_score") > 0)
        .withColumn("vector_score", F.lit(0.0))
        .withColumn("keyword_score", F.col("combined_score"))
        .withColumn("from_fallback", F.lit(True))
        .orderBy(F.desc("combined_score"), "id")
        .limit(k)
    )


def overlap_score(query: str, text: str) -> float:
    """Default scorer: share of the query's distinct words that the text has, with a little for repetition."""
    q = set(query.lower().split())
    words = text.lower().split()
    have = set(words)
    return sum(w in have for w in q) / len(q) + 0.001 * min(50, sum(w in q for w in words)) if q else 0.0


def rerank(candidates: DataFrame, query: str, k: int, scorer: Callable[[str, str], float] = overlap_score) -> DataFrame:
    """The best ``k`` by ``scorer(query, start of content)``; a row whose scoring fails keeps its boosted score.

    The scorer runs in ``mapInPandas`` over the few candidates: a scalar UDF would be moved below the limit.
    """
    schema = T.StructType([*candidates.schema.fields, T.StructField("rerank_score", T.DoubleType())])

    def run(frames):
        for f in frames:
            out = []
            for text in f["content"]:
                try:
                    out.append(float(scorer(query, (text or "")[:RERANK_CHARS])))
                except Exception:  # noqa: BLE001
                    out.append(None)
            yield f.assign(rerank_score=out)

    done = candidates.mapInPandas(run, schema)
    return (
        done.withColumn("combined_score", F.coalesce("rerank_score", "combined_score"))
        .orderBy(F.desc("combined_score"), F.desc("vector_score"), "id")
        .limit(k)
        .drop("rerank_score")
    )


def hybrid_search(
    df: DataFrame,
    query: str,
    query_vector: Sequence[float] | None,
    k: int = 10,
    where: Column | None = None,
    use_rerank: bool = False,
    multiplier: int = 5,
    scorer: Callable[[str, str], float] = overlap_score,
) -> DataFrame:
    """Vector candidates, boosted by keywords and, if asked for, reranked.

    Without reranking the order stays that of the vector score. Without a query vector (the embedder failed) it is a
    keyword search. Candidates that are no more than ``k`` are not reranked.
    """
    if query_vector is None:
        return keyword_search(df, query, k, where)
    n = k * multiplier if use_rerank else k
    c = vector_topk(df, query_vector, n, where).withColumn("combined_score", boosted(F.col("vector_score"), query))
    c = c.withColumn("keyword_score", F.col("combined_score") - F.col("vector_score")).withColumn("from_fallback", F.lit(False))
    if not use_rerank:
        return c.orderBy(F.desc("vector_score"), "id")
    c = c.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))  # n rows at most
    few = c.filter(F.col("_n") <= k).drop("_n")
    many = rerank(c.filter(F.col("_n") > k).drop("_n"), query, k, scorer)
    return few.unionByName(many)


def _equals(word: str) -> Callable[[Column], Column]:
    return lambda x: x == word


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda x: x != "")


def inverted_index(df: DataFrame, id_col: str = "id", text: str = "content") -> DataFrame:
    """(term, id, tf, doc_len): one row per term and document."""
    d = df.select(F.col(id_col).alias("id"), tokens(F.col(text)).alias("t"))
    return d.select("id", F.size("t").alias("doc_len"), F.explode("t").alias("term")).groupBy("term", "id", "doc_len").agg(F.count("*").alias("tf"))


def query_terms(query: str) -> list[str]:
    return sorted(set("".join(ch if ch.isalnum() and ch.isascii() else " " for ch in query.lower()).split()))


def bm25_score(n: Column, df: Column, tf: Column, dl: Column, avgdl: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """What one term adds to a document's score."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def bm25_topk(df: DataFrame, query: str, k: int = 10, id_col: str = "id", text: str = "content", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) by BM25 without an index. Only the query's terms leave the scan, and of every document its length; see
    :mod:`quern.operators.textindex` for the stored form."""
    terms = query_terms(query)
    d = df.select(F.col(id_col).alias("id"), tokens(F.col(text)).alias("t")).filter("t is not null")
    tf = [F.size(F.filter("t", _equals(w))).alias(f"tf{i}") for i, w in enumerate(terms)]
    d = d.select("id", F.size("t").alias("dl"), *tf)
    stats = d.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    hit = d.filter(" or ".join(f"tf{i} > 0" for i in range(len(terms))) if terms else "false").crossJoin(stats)  # one row
    score = _sum([bm25_score(F.col("n"), F.col(f"df{i}"), F.col(f"tf{i}"), F.col("dl"), F.col("avgdl"), k1, b) for i in range(len(terms))])
    return hit.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)
