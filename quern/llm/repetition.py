"""Repetition inside a single document (problem 10).

The named method, line frequency across documents (:func:`line_frequency`, :func:`without_common_lines`), finds and removes
boilerplate that many documents of a repository share. It cannot see a text that repeats itself without line ends, nor tell words that came before from
words that did not, so the required share is measured by :func:`repeated_share`: every start of ``n`` successive words
is hashed, and a start whose hash has come before in the same document marks its ``n`` words as repeated.

Defined results: null, empty and blank texts have no words and a share of 0; words are lower-cased runs of letters and
digits, and each character of U+3040-30FF, U+3400-4DBF and U+4E00-9FFF is a word of its own. Whole texts are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.blocks import per_block
from quern.llm.common import BROADCAST_KEYS, durable

_CJK = "぀-ヿ㐀-䶿一-鿿"
_WORD = re.compile(f"[{_CJK}]|[^\\W_{_CJK}]+")


def _numbers(n: int) -> np.ndarray:
    """A fixed pseudo-random 64-bit value for each word number."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_words(texts: list[str | None], n: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Number of words, and of repeated words, of each text."""
    number: dict[str, int] = {}
    count = number.setdefault
    flat: list[int] = []
    lens = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            words = _WORD.findall(t.lower())
            lens[i] = len(words)
            flat += [count(w, len(number)) for w in words]
    total = len(flat)
    if total < n:
        return lens, np.zeros(len(texts), np.int64)
    w = _numbers(len(number))[np.array(flat, np.int64)]
    del flat
    with np.errstate(over="ignore"):
        h = np.zeros(total - n + 1, np.uint64)
        for k in range(n):
            h = h * np.uint64(0xD6E8FEB86659FD93) + w[k : total - n + 1 + k]
    doc = np.repeat(np.arange(len(texts)), lens)
    start = np.flatnonzero(doc[: total - n + 1] == doc[n - 1 :])
    with np.errstate(over="ignore"):
        key = h[start] ^ (_numbers(len(texts))[doc[start]])
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(start), bool)
    ko, so = key[order], doc[start][order]
    same[order[1:]] = (ko[1:] == ko[:-1]) & (so[1:] == so[:-1])
    edge = np.zeros(total + 1, np.int64)
    edge[start[same]] += 1
    np.subtract.at(edge, start[same] + n, 1)
    marked = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
    ends = np.cumsum(lens)
    return lens, marked[ends] - marked[ends - lens]


def repeated_share(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 8) -> DataFrame:
    """(id, n_words, n_repeated, share) of every row."""

    def run(t: pa.Table) -> pa.Table:
        words, rep = repeated_words(t.column(1).to_pylist(), n)
        return pa.table({"k": t.column(0), "n_words": words, "n_repeated": rep, "share": rep / np.maximum(words, 1)})

    kind = df.schema[id_col].dataType.simpleString()
    return (
        df.select(id_col, text_col)
        .mapInArrow(per_block(run, 24 << 20), f"k {kind}, n_words bigint, n_repeated bigint, share double")
        .withColumnRenamed("k", id_col)
    )


SALTS = 32


def _lines(df: DataFrame, id_col: str, host_col: str, text_col: str) -> DataFrame:
    """(__d, __h, k, g, c): of every document its distinct normalised lines as 128 bits, with their number."""
    line = _norm(F.col("line"))
    return (
        df.select(F.col(id_col).alias("__d"), F.col(host_col).alias("__h"), F.explode(F.split(text_col, _END)).alias("line"))
        .select("__d", "__h", line.alias("n"))
        .filter(F.col("n") != "")
        .select("__d", "__h", F.xxhash64("n").alias("k"), F.xxhash64(F.lit("second"), "n").alias("g"))
        .groupBy("__d", "__h", "k", "g")
        .agg(F.count("*").alias("c"))
    )


_END = "\r\n|\r|\n"


def _norm(line):
    return F.regexp_replace(F.lower(F.trim(line)), "[0-9]", "0")


def line_frequency(
    df: DataFrame,
    id_col: str = "doc_id",
    host_col: str = "repo_id",
    text_col: str = "text",
    max_docs: int = 20,
    least_left: float = 0.5,
) -> DataFrame:
    """The named method: (id, n_lines, n_common, kept, common) of every document with a line.

    A line is normalised (trimmed, lower case, digits as 0) and hashed; it is common if more than ``max_docs``
    documents of the host have it. A document is kept if at least ``least_left`` of its lines are not common; ``common`` has
    the hashes of its common lines (as many as its own lines at most), by which :func:`without_common_lines` removes them.
    A null host is a host of its own.

    Counts are combined before the shuffle, so a line that all documents share is no hot key there. Common lines are joined
    back by broadcast up to ``BROADCAST_KEYS``; beyond that each is sent to ``SALTS`` parts and the lines of a host to one
    of these by their document, so no task holds all occurrences of a line.
    """
    lines = durable(_lines(df, id_col, host_col, text_col))
    hot = lines.groupBy("__h", "k", "g").agg(F.count("*").alias("docs")).filter(F.col("docs") > max_docs).select(F.col("__h").alias("__h2"), "k", "g", F.lit(1).alias("hot"))
    hot = durable(hot)
    same = lines["__h"].eqNullSafe(hot["__h2"])
    if hot.count() <= BROADCAST_KEYS:
        met = lines.join(F.broadcast(hot), (lines["k"] == hot["k"]) & (lines["g"] == hot["g"]) & same, "left").drop(hot["k"]).drop(hot["g"])
    else:
        left = lines.withColumn("salt", F.pmod(F.xxhash64("__d"), F.lit(SALTS)).cast("int"))
        right = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = left.join(right, (left["k"] == right["k"]) & (left["g"] == right["g"]) & (left["salt"] == right["salt"]) & left["__h"].eqNullSafe(right["__h2"]), "left").drop(right["k"]).drop(right["g"])
    return (
        met.groupBy("__d")
        .agg(
            F.sum("c").alias("n_lines"),
            F.sum(F.when(F.col("hot") == 1, F.col("c")).otherwise(0)).alias("n_common"),
            F.collect_set(F.when(F.col("hot") == 1, F.struct("k", "g"))).alias("common"),
        )
        .select(
            F.col("__d").alias(id_col),
            "n_lines",
            "n_common",
            (F.col("n_common") <= (1 - least_left) * F.col("n_lines")).alias("kept"),
            "common",
        )
    )


def without_common_lines(df: DataFrame, id_col: str = "doc_id", host_col: str = "repo_id", text_col: str = "text", **limits) -> DataFrame:
    """(id, text): the kept documents without their common lines, joined by line feeds; depleted documents and those without
    a line are left out."""
    common = line_frequency(df, id_col, host_col, text_col, **limits).filter("kept").select(F.col(id_col).alias("__d"), "common")
    own = df.select(F.col(id_col).alias("__d"), F.split(text_col, _END).alias("parts"))
    key = lambda x: F.struct(F.xxhash64(_norm(x)).alias("k"), F.xxhash64(F.lit("second"), _norm(x)).alias("g"))
    return own.join(common, "__d").select(F.col("__d").alias(id_col), F.array_join(F.filter("parts", lambda x: ~F.array_contains("common", key(x))), "\n").alias(text_col))
