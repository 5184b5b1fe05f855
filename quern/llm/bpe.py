"""Byte-level BPE of a whole corpus with a public vocabulary (problem 8).

A block of texts is split into pre-tokens; all *distinct* pre-tokens of the block are laid out in one array as a doubly
linked list and merged together. The queue has one bucket of list positions per merge rank and a hierarchical bitmap
over the ranks: find-first-set picks the lowest rank that has positions, all of its positions are merged at once,
entries that an earlier merge has made stale are skipped, and the pairs that arise go to their own (always higher)
ranks. The work is linear in the number of merges and does not depend on the length of a pre-token.

Defined results: null and empty texts give an empty list; blank texts are encoded as they are; text that looks like a
special token is plain text; lone surrogates become U+FFFD. Extra columns are ignored, repeated rows are kept.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quern.llm.blocks import per_block
from quern.llm.common import spread

TOKENIZERS = os.environ.get("QUERN_TOKENIZERS", "/opt/tokenizers")

# The Unicode white space characters, and the split pattern that belongs to the vocabulary.
WHITE = "\t-\r \x85\xa0  -     　"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Coarse pieces that never cut a pre-token: a run of non-blanks with at most one space before it, or blanks.
_PIECE = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_PRE = regex.compile(PATTERN)


class RankBitmap:
    """Set of small integers with find-first-set over 64-way levels."""

    def __init__(self, size: int):
        self.levels = []
        while True:
            size = (size + 63) // 64
            self.levels.append([0] * size)
            if size == 1:
                break

    def add(self, i: int) -> None:
        for level in self.levels:
            i, bit = divmod(i, 64)
            if level[i] >> bit & 1:
                return
            level[i] |= 1 << bit

    def pop_first(self) -> int:
        """Remove and return the least member, or -1."""
        if not self.levels[-1][0]:
            return -1
        i = 0
        for level in reversed(self.levels):
            i = i * 64 + ((level[i] & -level[i]).bit_length() - 1)
        at = i
        for level in self.levels:
            at, bit = divmod(at, 64)
            level[at] &= ~(1 << bit)
            if level[at]:
                break
        return i


def _byte_letters() -> dict[str, int]:
    """The vocabulary file's letter of each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Merge table of one vocabulary. Loaded once per worker by :func:`load`."""

    def __init__(self, text: str):
        """``text``: a vocabulary file."""
        model = json.loads(text)["model"]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.n = len(pairs)
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.byte_id = np.zeros(256, np.int64)
        for letter, b in _byte_letters().items():
            self.byte_id[b] = vocab[letter]
        keys = self.left << 32 | self.right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, or -1."""
        k = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, k), self.n - 1)
        return np.where(self.keys[at] == k, self.ranks[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and the offset of each piece (one more than pieces)."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes + 1)  # a separator after each piece
        total = int(ends[-1]) if len(pieces) else 0
        tok = np.full(total + 1, -1, np.int64)
        inside = np.ones(total, bool)
        inside[ends - 1] = False
        tok[:-1][inside] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        nxt = np.arange(1, total + 2)
        prv = np.arange(-1, total)
        buckets: dict[int, list[np.ndarray]] = {}
        queue = RankBitmap(self.n)

        def push(at: np.ndarray) -> None:
            rank = self.rank_of(tok[at], tok[nxt[at]])
            ok = rank >= 0
            at, rank = at[ok], rank[ok]
            if not len(at):
                return
            if len(at) == 1:
                r = int(rank[0])
                buckets.setdefault(r, []).append(at)
                queue.add(r)
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            lo = 0
            for hi, r in zip([*cuts.tolist(), len(at)], rank[np.concatenate(([0], cuts))].tolist()):
                buckets.setdefault(r, []).append(at[lo:hi])
                queue.add(r)
                lo = hi

        if total:
            starts = np.flatnonzero(tok[:total] >= 0)
            starts = starts[tok[starts + 1] >= 0]
            push(starts)
        while (r := queue.pop_first()) >= 0:
            held = buckets.pop(r)
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            a, b, new = self.left[r], self.right[r], self.made[r]
            at = at[(tok[at] == a) & (tok[nxt[at]] == b)]  # stale entries go
            if not len(at):
                continue
            if a == b and len(at) > 1:  # runs of the same token: left to right without overlap
                at = np.sort(at)
                linked = nxt[at[:-1]] == at[1:]
                first = np.concatenate(([True], ~linked))
                start = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            tok[at] = new
            tok[gone] = -2
            nxt[at] = after
            prv[after] = at
            before = prv[at]
            before = before[(before >= 0)]
            push(np.unique(np.concatenate((before[tok[before] >= 0], at[tok[after] >= 0]))))
        kept = tok[:total] >= 0
        seen = np.concatenate(([0], np.cumsum(kept)))
        return tok[:total][kept], np.concatenate(([0], seen[ends])) if len(pieces) else np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the offset of each text."""
        number: dict[str, int] = {}
        count = number.setdefault
        flat: list[int] = []
        lens = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                found = _PIECE.findall(t)
                lens[i] = len(found)
                flat += [count(p, len(number)) for p in found]
        pre: dict[str, int] = {}
        count = pre.setdefault
        inner: list[int] = []
        widths = np.zeros(len(number), np.int64)
        for i, p in enumerate(number):
            if p.isalpha():
                widths[i] = 1
                inner.append(count(p, len(pre)))
            else:
                found = _PRE.findall(p)
                widths[i] = len(found)
                inner += [count(q, len(pre)) for q in found]
        ids, off = self.encode_pieces([_bytes(p) for p in pre])
        ids, off = _gather(ids, off, np.array(inner, np.int64), widths)
        return _gather(ids, off, np.array(flat, np.int64), lens)


def _bytes(p: str) -> bytes:
    try:
        return p.encode()
    except UnicodeEncodeError:
        return re.sub("[\ud800-\udfff]", "\ufffd", p).encode()


def _gather(vals: np.ndarray, off: np.ndarray, flat: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a ragged array, picked by ``flat`` and joined into rows of ``lens`` picks."""
    size = (off[1:] - off[:-1])[flat] if len(flat) else np.zeros(0, np.int64)
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    index = np.arange(total) + np.repeat(off[flat] - (ends - size), size) if total else np.zeros(0, np.int64)
    cum = np.concatenate(([0], ends))
    return vals[index], cum[np.concatenate(([0], np.cumsum(lens)))]


_loaded: dict[str, Bpe] = {}
LARGEST = 64 << 20  # bytes of a vocabulary


def load(path: str) -> Bpe:
    """The encoder of a vocabulary file of this machine."""
    with open(path, encoding="utf-8") as f:
        return Bpe(f.read())


def shipped(df: DataFrame, path: str):
    """A function that gives the encoder on any executor: the driver reads the file, whose size is checked, and broadcasts it."""
    if os.path.getsize(path) > LARGEST:
        raise ValueError(f"{path} has more than {LARGEST} bytes")
    with open(path, encoding="utf-8") as f:
        text = df.sparkSession.sparkContext.broadcast(f.read())
    name = f"{path}:{os.path.getmtime(path)}"

    def get() -> Bpe:
        if name not in _loaded:
            _loaded[name] = Bpe(text.value)
        return _loaded[name]

    return get


def vocabulary(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZERS, f"{name}.json")


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every row; one narrow pass, in front of which an input of few splits is spread over the cores."""
    encoder = shipped(df, vocab or vocabulary())

    def run(t: pa.Table) -> pa.Table:
        ids, off = encoder().encode(t.column(1).to_pylist())
        lists = pa.LargeListArray.from_arrays(pa.array(off, pa.int64()), pa.array(ids.astype(np.int32)))
        return pa.table({"k": t.column(0), "ids": lists.cast(pa.list_(pa.int32()))})

    kind = df.schema[id_col].dataType.simpleString()
    out = spread(df.select(id_col, text_col)).mapInArrow(per_block(run, 24 << 20), f"k {kind}, ids array<int>")
    return out.withColumnRenamed("k", id_col)


def count_tokens(df: DataFrame, keys: list[str], text_col: str = "text", vocab: str | None = None) -> DataFrame:
    """``keys`` and ``n_tokens`` of every row."""
    encoder = shipped(df, vocab or vocabulary())

    def run(t: pa.Table) -> pa.Table:
        _, off = encoder().encode(t.column("__text").to_pylist())
        return t.drop_columns(["__text"]).append_column("n_tokens", pa.array(np.diff(off)))

    from pyspark.sql import functions as F

    part = df.select(*keys, F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{k}` {part.schema[k].dataType.simpleString()}" for k in keys)
    return spread(part).mapInArrow(per_block(run, 24 << 20), f"{schema}, n_tokens bigint")
