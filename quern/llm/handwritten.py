"""Generated, minified, vendored and data files (problem 1).

A random forest is trained on compression ratio, token entropy, identifier lengths, comment density and the shape of
lines and literals. Its labels are header notices of tools and of data tables (and the names that tools give to their
output), which the features do not see: the comment block at the head of a file is cut off before they are measured. The
forest alone decides generated, packed and data files without a notice, whatever their names.

Two kinds of case leave no trace in what the forest may see: copies of third parties, which look like any other code, and
generated files whose body does. They are known by their label, a notice in their own head, and copies by a folder for
third-party code; such files take no part as examples of hand-written ones. Mentions of such words inside code, in strings
or in a sentence about something else are no notices.

Defined results: only current rows count; the chunks of a file are put together by line, each line once; null content
counts as no lines and a file without text is hand-written; null paths are left out. The training sample is about
``SAMPLE`` files of each label (never more than twice as many), by a hash of the path; every file is scored by a forest
that has not seen it. If a fold lacks a label, one forest is trained on all folds; if there are no files with or none
without a label, there is nothing to learn and notices and folders decide alone. Either is logged.
"""

from __future__ import annotations

import logging
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.grammars import lexers
from quern.llm.blocks import per_block
from quern.llm.common import bounded_sample, current, durable
from quern.llm.parsing import assemble, language_of

log = logging.getLogger("quern")

SAMPLE = 3000
TREES, DEPTH, BINS = 40, 7, 64
LEAF, LEAF_SHARE = 5, 150  # a leaf holds at least LEAF rows and one in LEAF_SHARE of a tree's rows
FOLDS = 3  # a file is scored by the forest that has not seen it
LEAST = 0.55
ROUNDS = 2
DOUBT = 0.5  # unlabelled files above this score are no examples of hand-written ones

_LINE = r"^[ \t]*(?:/\*+!?|\*|//+!?|#+!?|--|<!--)"
# Notices of tools, in the comment block at the head of a file.
TOOL_NOTICE = re.compile(
    rf"{_LINE}\s*(?:<auto-generated>|@generated\b|auto-?generated\b|this (?:file|code) (?:was|is|has been) (?:automatically )?(?:produced|generated|created|written)\b.*|generated (?:automatically )?(?:by|from|with)\b.*|code generated by\b.*|"
    r"(?:this (?:file|code) )?.*\bdo not (?:edit|modify)\b[.!]?\s*(?:\*/)?$|diese datei (?:wurde|wird|ist)\b.*(?:maschinell|automatisch|generiert|erzeugt).*|(?:ce fichier|este (?:archivo|fichero|arquivo)|questo file)\b.*(?:g[eé]n[eé]r|gerad|genera).*|(?:этот файл|файл).*(?:создан|сгенерирован).*|.*(?:自动生成|自動生成).*)",
    re.I | re.M,
)
# Notices that a file was copied from another project's release.
COPY_NOTICE = re.compile(
    rf"{_LINE}\s*(?:\S+ v?\d+(?:\.\d+)+ - (?:bundled|vendored) copy\b.*|\S+ v?\d+(?:\.\d+)+ \| \(c\) .*|(?:imported|copied|vendored|taken) (?:verbatim |unchanged )?from\b.*\b(?:release|version|upstream|v?\d+\.\d+).*|(?:bundled|vendored) copy of\b.*)",
    re.I | re.M,
)
# Notices of data tables.
DATA_NOTICE = re.compile(rf"{_LINE}\s*(?:tables? of|data (?:for|of)|lookup tables? (?:for|of))\s+\S+\s*(?:\*/)?$", re.I | re.M)
# Folders and names.
VENDOR_PATH = re.compile(r"/(?:third[_-]?party|vendor|vendors|vendored|Godeps|node_modules|bower_components|site-packages|external|externals|deps|3rdparty|jspm_packages|Pods|Carthage)/")
TOOL_NAME = re.compile(r"/(?:gen|generated|__generated__|autogen)/|\.(?:gen|generated|g|pb|min|bundle)\.[a-z]+$|_(?:pb2|pb2_grpc|generated)\.py$|_pb\.(?:js|ts|py)$|-min\.js$")

_HEAD = re.compile(r"\A(?:\s*(?:/\*[\s\S]*?\*/|//[^\n]*|#(?!include|define|if|endif|pragma|!\[|\[)[^\n]*))+")
_TOKEN = re.compile(r"[^\W\d]\w*|\d[\w.]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|[^\w\s]")
_IDENT = re.compile(r"[^\W\d]\w*")
_TABLE = re.compile(r"(?:(?:-?(?:0[xX][0-9a-fA-F]+|\d[\d.eE_+-]*)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[\[\](){}])\s*[,:;]?\s*){12,}")
_MASK = re.compile(r"[^\W\d]\w*|\d[\w.]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
NAMES = ("ratio", "entropy", "ident", "short", "comments", "digits", "table", "mean_line", "max_line", "blanks", "shapes", "marks", "tokens_line", "shape_ratio", "top_shape")


_CLASS = np.array([1 if 48 <= c < 58 else 2 if c in (9, 10, 13, 32) else 0 if chr(c).isalnum() or c == 95 or c > 127 else 3 for c in range(256)])


def head(text: str) -> str:
    """The comment block at the head of a file."""
    m = _HEAD.match(text)
    return m[0] if m else ""


def table_share(text: str) -> float:
    """Share of the characters that lie in tables of twelve or more literals."""
    return sum(len(m[0]) for m in _TABLE.finditer(text)) / max(1, len(text))


def features(lang: str, text: str) -> list[float]:
    """The features of a text whose head is cut off, in the order of ``NAMES``."""
    body = text[len(head(text)) :].strip()  # not even the line after a notice may tell
    n = max(1, len(body))
    raw = body.encode("utf-8", "replace")
    tokens = _TOKEN.findall(body)
    count = Counter(tokens)
    total = max(1, len(tokens))
    entropy = -sum(c / total * math.log2(c / total) for c in count.values())
    idents = [t for t in tokens if t[0].isalpha() or t[0] == "_"]
    lines = [x for x in body.split("\n") if x.strip()]
    comment = sum(b - a for k, a, b in lexers.pieces(lang, body) if k == "c") if lang in lexers.GRAMMARS else 0
    masked = _MASK.sub("i", body)
    shapes = Counter(x.strip() for x in masked.split("\n") if x.strip())
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=4) / max(1, len(raw))
    return [
        len(zlib.compress(raw, 1)) / max(1, len(raw)),
        entropy / max(1.0, math.log2(total + 1)),
        sum(map(len, idents)) / max(1, len(idents)),
        sum(len(t) <= 2 for t in idents) / max(1, len(idents)),
        comment / n,
        kinds[1],
        table_share(body),
        n / max(1, len(lines)),
        max(map(len, lines), default=0),
        kinds[2],
        len(shapes) / max(1, len(lines)),
        kinds[3],
        total / max(1, len(lines)),
        len(zlib.compress(masked.encode("utf-8", "replace"), 1)) / max(1, len(masked)),
        max(shapes.values(), default=0) / max(1, len(lines)),
    ]


class Forest:
    """Random forest of binary trees over binned features; plain arrays, so that it travels in a closure."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, seed: int = 7):
        self.n, self.depth, self.seed = trees, depth, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T)], 1)
        # Both labels weigh the same in each tree.
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        self.trees = []
        for _ in range(self.n):
            at = rng.choice(len(y), min(len(y), 3000))
            self.trees.append(self._tree(b[at], y[at], weight[at], rng))
        return self

    def _tree(self, b, y, weight, rng):
        feature, cut, left, right, value = [], [], [], [], []
        leaf = max(LEAF, len(y) // LEAF_SHARE)
        todo = [(np.arange(len(y)), 0, None, 0)]
        while todo:
            rows, depth, parent, side = todo.pop()
            me = len(feature)
            if parent is not None:
                (left if side == 0 else right)[parent] = me
            w = weight[rows]
            total, ones = w.sum(), (w * y[rows]).sum()
            share = ones / total if len(rows) else 0.5
            for a, v in ((feature, -1), (cut, 0), (left, -1), (right, -1), (value, share)):
                a.append(v)
            if depth == self.depth or len(rows) < 2 * leaf or share in (0.0, 1.0):
                continue
            best = (1e-9, -1, 0)
            for f in rng.choice(b.shape[1], max(2, int(math.sqrt(b.shape[1])) + 1), replace=False):
                v = b[rows, f]
                count = np.cumsum(np.bincount(v, minlength=BINS + 1))[:-1]
                nl = np.cumsum(np.bincount(v, weights=w, minlength=BINS + 1))[:-1]
                pl = np.cumsum(np.bincount(v, weights=w * y[rows], minlength=BINS + 1))[:-1]
                nr, pr = total - nl, ones - pl
                with np.errstate(divide="ignore", invalid="ignore"):
                    gini = np.where((count >= leaf) & (len(rows) - count >= leaf), pl * (nl - pl) / nl + pr * (nr - pr) / nr, np.inf)
                k = int(gini.argmin())
                gain = share * (1 - share) * total - gini[k]
                if gain > best[0]:
                    best = (gain, int(f), k)
            if best[1] < 0:
                continue
            feature[me], cut[me] = best[1], best[2]
            go = b[rows, best[1]] <= best[2]
            todo += [(rows[go], depth + 1, me, 0), (rows[~go], depth + 1, me, 1)]
        return tuple(np.array(a) for a in (feature, cut, left, right, value))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean share of positives in the leaves that each row reaches."""
        if not len(x):
            return np.zeros(0)
        b = np.stack([np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T)], 1)
        out = np.zeros(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                go = b[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
                at = np.where(f < 0, at, np.where(go, left[at], right[at]))
            out += value[at]
        return out / len(self.trees)


_COLS = "file_path string, tool boolean, copied boolean, named boolean, data boolean, x array<double>"


def measured(records: DataFrame) -> DataFrame:
    """(file_path, tool, copied, named, data, x) of every file: its notices, its name and its features."""
    cur = current(records.select("id", "indexed_at", "file_path", "start_line", "content"), "file_path", "start_line", "content")
    files = (
        cur.filter("file_path is not null")
        .select("file_path", language_of(F.col("file_path")).alias("lang"), F.coalesce("start_line", F.lit(1)).alias("start"), F.coalesce("content", F.lit("")).alias("content"))
        .groupBy("file_path", "lang")
        .agg(F.collect_set(F.struct("start", "content")).alias("parts"))
    )

    def run(t: pa.Table) -> pa.Table:
        cols = {c: [] for c in ("file_path", "tool", "copied", "named", "data", "x")}
        for path, lang, parts in zip(*(t.column(c).to_pylist() for c in ("file_path", "lang", "parts"))):
            text = assemble([(p["start"], p["content"]) for p in parts])
            h = head(text)
            cols["file_path"].append(path)
            cols["tool"].append(bool(TOOL_NOTICE.search(h)))
            cols["copied"].append(bool(COPY_NOTICE.search(h) or VENDOR_PATH.search(path)))
            cols["named"].append(bool(TOOL_NAME.search(path)))
            cols["data"].append(bool(DATA_NOTICE.search(h)))
            cols["x"].append(features(lang or "", text))
        kinds = {"file_path": pa.string(), "x": pa.list_(pa.float64())}
        return pa.table({k: pa.array(v, kinds.get(k, pa.bool_())) for k, v in cols.items()})

    return durable(files.mapInArrow(per_block(run, 16 << 20), _COLS))


def fit_folds(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> list[Forest]:
    """One forest per fold, trained on the other folds. Unlabelled files that a round doubts are left out of the
    next: a missing notice does not make a file hand-written."""
    keep = np.ones(len(y), bool)
    for _ in range(ROUNDS):
        forests = [Forest(seed=7 + k).fit(x[keep & (fold != k)], y[keep & (fold != k)]) for k in range(FOLDS)]
        score = np.zeros(len(y))
        for k in range(FOLDS):
            score[fold == k] = forests[k].score(x[fold == k])
        keep = (y == 1) | (score < DOUBT)
    return forests


def train(m: DataFrame) -> list[Forest]:
    """A forest for each fold from about ``SAMPLE`` files with and without a label; none if either kind is missing."""
    label = F.col("tool") | F.col("named") | F.col("data")
    part = m.filter(~F.col("copied"))
    pos = bounded_sample(part.filter(label), "file_path", SAMPLE).select("fold", "x").collect()
    neg = bounded_sample(part.filter(~label), "file_path", SAMPLE).select("fold", "x").collect()
    if not pos or not neg:
        log.warning("no forest: %d files with a label, %d without", len(pos), len(neg))
        return []
    x, y = np.array([r.x for r in pos + neg]), np.array([1] * len(pos) + [0] * len(neg))
    if min(len({r.fold for r in rows}) for rows in (pos, neg)) < FOLDS:
        log.warning("one forest for all folds: %d files with a label, %d without", len(pos), len(neg))
        return [Forest().fit(x, y)] * FOLDS
    return fit_folds(x, y, np.array([r.fold for r in pos + neg]))


def scored(records: DataFrame) -> DataFrame:
    """(file_path, tool, copied, named, data, score, table_share) of every file of the current records."""
    m = measured(records).withColumn("fold", F.pmod(F.xxhash64("file_path", F.lit(1)), F.lit(FOLDS)).cast("int"))
    forests = train(m)

    def run(t: pa.Table) -> pa.Table:
        x = np.array(t.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(NAMES))
        fold = t.column("fold").to_numpy()
        score = np.zeros(len(x))
        for k, forest in enumerate(forests):
            score[fold == k] = forest.score(x[fold == k])
        out = t.drop_columns(["x", "fold"]).append_column("score", pa.array(score))
        return out.append_column("table_share", pa.array(x[:, NAMES.index("table")]))

    return m.mapInArrow(per_block(run, 16 << 20), "file_path string, tool boolean, copied boolean, named boolean, data boolean, score double, table_share double")


def not_handwritten(records: DataFrame, least: float = LEAST) -> DataFrame:
    """(file_path) of the files that nobody wrote by hand in their repository."""
    return scored(records).filter((F.col("score") >= least) | F.col("tool") | F.col("copied")).select("file_path")
