"""Embedding of documents and queries with an injected embedder.

An embedder maps a list of texts to a list of vectors. The default hashes tokens into a fixed number of dimensions; it
is deterministic and makes no claim to the quality of a trained model. A text that fails gets a zero vector and
``ok = false``; the others of its batch are not affected.
"""

from __future__ import annotations

import logging
import math
import re
import zlib
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame

from quern.cache import LruCache
from quern.errors import EmbedderUnavailable, EmbeddingFailed

log = logging.getLogger("quern")

MAX_CHARS, BATCH = 32_768, 32
DOCUMENT, QUERY = "search_document: ", "search_query: "
Embedder = Callable[[Sequence[str]], list[list[float]]]
_WORD = re.compile(r"[A-Za-z]+|\d+|[^\W\dA-Za-z_]+")


class HashEmbedder:
    """Signed token hashing, length one. The distinct words of a batch are hashed once and added up in numpy."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        number: dict[str, int] = {}
        found = [[number.setdefault(w, len(number)) for w in _WORD.findall(t.lower())] for t in texts]
        h = np.fromiter((zlib.crc32(w.encode()) for w in number), np.int64, len(number))
        flat = np.array([i for f in found for i in f], np.int64)
        row = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        v = np.zeros((len(texts), self.dimension))
        if len(flat):
            h = h[flat]
            v = np.bincount(row * self.dimension + h % self.dimension, np.where(h >> 31, 1.0, -1.0), v.size).reshape(v.shape)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return (v / np.where(n > 0, n, 1)).tolist()


def embed_batch(embedder: Embedder, texts: Sequence[str | None], dimension: int) -> list[tuple[list[float], int, bool, str | None]]:
    """(vector, token estimate, ok, error) of each text. A batch that fails is tried text by text."""
    cut = [(t or "")[:MAX_CHARS] for t in texts]
    out: list = [([0.0] * dimension, 0, False, "empty text")] * len(cut)
    live = [i for i, t in enumerate(cut) if t.strip()]

    def put(i: int, v) -> None:
        if len(v) != dimension or not all(math.isfinite(x) for x in v):
            raise EmbeddingFailed("embedder gave an unusable vector", length=len(v))
        out[i] = ([float(x) for x in v], math.ceil(len(cut[i]) / 4), True, None)

    for at in range(0, len(live), BATCH):
        part = live[at : at + BATCH]
        try:
            for i, v in zip(part, embedder([DOCUMENT + cut[i] for i in part]), strict=True):
                put(i, v)
        except Exception:  # noqa: BLE001
            for i in part:
                try:
                    put(i, embedder([DOCUMENT + cut[i]])[0])
                except Exception as e:  # noqa: BLE001
                    out[i] = ([0.0] * dimension, 0, False, f"{type(e).__name__}: {e}"[:200])
    return out


_made: dict[str, Embedder] = {}


def _once(make: Callable[[], Embedder], key: str | None) -> Embedder:
    if key is None:
        return make()
    if key not in _made:
        _made[key] = make()
    return _made[key]


def embed_documents(df: DataFrame, text: str = "content", make: Callable[[], Embedder] | None = None, dimension: int = 64, key: str | None = None) -> DataFrame:
    """``df`` with vector, token_count, embed_ok and embed_error. ``make`` builds the embedder once per task, or, with a
    ``key`` that names it, once per Python worker, which serves many tasks."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL("vector array<float>, token_count int, embed_ok boolean, embed_error string").fields])

    def run(frames):
        e = _once(make, key) if make else HashEmbedder(dimension)
        for f in frames:
            r = embed_batch(e, f[text].tolist(), dimension)
            yield f.assign(vector=[x[0] for x in r], token_count=[x[1] for x in r], embed_ok=[x[2] for x in r], embed_error=[x[3] for x in r])

    return df.mapInPandas(run, schema)


def on_device(make: Callable[[str], Embedder], devices: Sequence[str] = ("gpu", "cpu")) -> tuple[Embedder, str]:
    """The embedder on the first of ``devices`` on which it can be made and gives a vector, and that device."""
    why = []
    for d in devices:
        try:
            e = make(d)
            e([QUERY + "ready"])
            return e, d
        except Exception as x:  # noqa: BLE001
            why.append(f"{d}: {type(x).__name__}: {x}"[:200])
            log.warning("no embedder on %s: %s", d, x)
    raise EmbedderUnavailable("no device takes the embedder", devices=why)


class QueryEmbedder:
    """Embeds queries on the driver; remembers the last hundred."""

    def __init__(self, embedder: Embedder, model: str = "hash", cache: int = 100):
        self.embedder, self.model, self.cache = embedder, model, LruCache(cache)
        self._dimension: int | None = getattr(embedder, "dimension", None)

    @property
    def dimension(self) -> int:
        """Length of the vectors; an embedder that does not tell is asked once."""
        if self._dimension is None:
            self.preload()
        return self._dimension

    def preload(self) -> int:
        """Make the embedder ready before the first query, and return its dimension."""
        try:
            self._dimension = len(self.embedder([QUERY + "ready"])[0])
        except Exception as e:
            raise EmbedderUnavailable("the embedder could not be loaded") from e
        return self._dimension

    def clear(self) -> None:
        """Forget the remembered queries."""
        self.cache.clear()

    def stats(self) -> dict:
        return self.cache.stats() | {"model": self.model, "dimension": self._dimension}

    def __call__(self, query: str) -> list[float]:
        key = f"{self.model}:{query}"
        hit = self.cache.get(key)
        if hit is None:
            try:
                hit = self.embedder([QUERY + query[:MAX_CHARS]])[0]
            except Exception as e:
                raise EmbeddingFailed("query could not be embedded", query=query[:100]) from e
            self.cache.set(key, hit)
        return hit
