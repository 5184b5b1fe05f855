"""A stored text index: postings that searches read instead of the texts.

``postings`` has one row per term and row of the indexed table; ``doc_len`` is the number of terms of the content and ``tf``
how often it has the term (0 for terms of name and signature only). Written in buckets and sorted by term, so a filter on
terms reaches the row groups. Terms are runs of ASCII letters and digits in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import keywords
from quern.operators.search import bm25_score, query_terms, tokens

FIELDS = "term string, id string, file_path string, tf int, doc_len int"


def postings(rows: DataFrame, id_col: str = "id", content: str = "content", more: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """(term, id, file_path, tf, doc_len) of content and the columns ``more``; null counts as empty. A row's terms never leave
    its task."""
    t = F.coalesce(tokens(F.col(content)), F.array().cast("array<string>"))
    rest = F.array_distinct(F.concat(*[F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")) for c in more])) if more else F.array().cast("array<string>")
    d = rows.select(F.col(id_col).cast("string").alias("id"), (F.col(path) if path else F.lit(None).cast("string")).alias("file_path"), F.array_sort(t).alias("t"), rest.alias("r"))
    n = F.size("t")
    # Of a sorted list, where each term begins: its count is the distance to the next beginning.
    begins = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at("t", i) != F.element_at("t", F.greatest(i - 1, F.lit(1)))))
    d = d.withColumn("b", F.when(n > 0, begins).otherwise(F.array().cast("array<int>")))
    own = F.transform("b", lambda i, k: F.struct(F.element_at("t", i).alias("term"), (F.coalesce(F.get("b", k + 1), n + 1) - i).cast("int").alias("tf")))
    other = F.transform(F.array_except("r", "t"), lambda x: F.struct(x.alias("term"), F.lit(0).alias("tf")))
    return d.select("id", "file_path", n.alias("doc_len"), F.explode(F.concat(own, other)).alias("p")).select("p.term", "id", "file_path", "p.tf", "doc_len")


def lengths(rows: DataFrame, id_col: str = "id", content: str = "content", path: str | None = None) -> DataFrame:
    """(id, file_path, doc_len) of the rows with content."""
    return rows.filter(F.col(content).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), (F.col(path) if path else F.lit(None).cast("string")).alias("file_path"), F.size(tokens(F.col(content))).alias("doc_len")
    )


def bm25(index: DataFrame, sizes: DataFrame, query: str, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) by BM25 from postings and lengths; only the postings of the query's terms are read."""
    terms = query_terms(query)
    hit = index.filter(F.col("term").isin(terms) & (F.col("tf") > 0)) if terms else index.filter("false")
    stats = sizes.agg(F.count("*").alias("n"), F.avg("doc_len").alias("avgdl"))
    found = hit.groupBy("term").agg(F.count("*").alias("df"))  # one row per term of the query
    part = hit.join(F.broadcast(found), "term").crossJoin(stats)  # one row
    score = bm25_score(F.col("n"), F.col("df"), F.col("tf"), F.col("doc_len"), F.col("avgdl"), k1, b)
    return part.groupBy("id").agg(F.sum(score).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def candidates(index: DataFrame, query: str) -> DataFrame | None:
    """(id) of the rows that have a keyword of the query in content, name or signature; None if a keyword is no run of letters
    and digits, which can lie across terms."""
    kws = sorted(set(keywords(query)))
    if not all(w.isascii() and w.isalnum() for w in kws):
        return None
    has: Column = F.lit(False)
    for w in kws:
        has = has | F.col("term").contains(w)
    return index.filter(has).select("id").distinct()


def keyword_search(rows: DataFrame, index: DataFrame, query: str, k: int = 50, where: Column | None = None) -> DataFrame:
    """As :func:`quern.operators.search.keyword_search`, with the candidates from the index."""
    from quern.operators.search import keyword_search as scan

    found = candidates(index, query)
    return scan(rows if found is None else rows.join(found, "id", "left_semi").select(*rows.columns), query, k, where)


__all__ = ["bm25", "candidates", "keyword_search", "lengths", "postings"]
