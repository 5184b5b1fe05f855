"""Near-duplicate records by a chosen-path join (problem 6).

Records with one text (in lower case) form one class, numbered once, and only classes are joined. Every class becomes the
set of its word shingles (64-bit hashes). In each of ``RUNS`` independent runs, a set goes to one bucket
for each of its shingles whose seeded hash lies under ``1 / (LAMBDA * size)``, and for the least one: about 1.7 buckets,
and two sets meet with a probability that grows with their overlap and is at least their similarity. A bucket of up to
``SMALL`` sets is compared pair by pair over 256-bit odd sketches; a larger one is split again by the shingles chosen with
the next level's seed, down to ``LEVELS``. What is still larger there (sets that share so many sampled shingles are mostly
near-duplicates) is compared exactly too, in pairs of blocks of ``BLOCK`` sets, so no bucket is capped. Pairs that pass the
sketch are checked against the full sets.

Runs come in rounds of ``RUNS``. Each checked pair knows in how many runs of its round it met; the number of pairs that met
in none is estimated from those that met in one or two (Chao's estimate), and rounds are added until the estimated recall
reaches ``TARGET``.

Defined results: null content or signature counts as empty; a record with fewer shingles than one is similar to none;
repeated rows count once and of superseded rows only the current one counts (the greatest indexed_at, nulls first; among
equals the greatest digest of its text); the pair is (smaller id, greater id). Extra columns are ignored; an empty table
gives no pairs.

What is stored: the sets of distinct classes once, rows of buckets that have to be split, and the candidate pairs. First
level rows are computed again where they are needed, which costs less than keeping them. Work in a bucket that no level
splits grows with the square of its sets, and each of its sets is sent once for every ``BLOCK`` sets of the bucket.
"""

from __future__ import annotations

import logging
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.blocks import per_block
from quern.llm.common import U, current, durable, few, mix64

RUNS = 10  # a round
ROUNDS = 5  # at most
TARGET = 0.999  # of the pairs
LEVELS = 4
LAMBDA = 0.7
SMALL = 64  # sets in a bucket that is compared without splitting
BLOCK = 8192  # sets in a block of a bucket that no level splits
COPIES = 4096  # rows of one class that are paired in one task
log = logging.getLogger("quern")
_WORD = re.compile("[a-z0-9_]+")


def shingle_sets(texts: list[str | None], n: int = 3) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of ``n`` successive words of each text in lower case."""
    number: dict[str, int] = {}
    count = number.setdefault
    words = _WORD.findall
    out = []
    rows = []
    for t in texts:
        rows.append([count(w, len(number)) for w in words(t or "")])
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
    with np.errstate(over="ignore"):
        for r in rows:
            if len(r) < n:
                out.append(np.zeros(0, np.uint64))
                continue
            w = h[np.array(r)]
            s = np.zeros(len(w) - n + 1, np.uint64)
            for k in range(n):
                s = mix64(s + w[k : len(w) - n + 1 + k] + U(k + 1))
            out.append(np.unique(s))
    return out


def _sets(t: pa.Table, n: int) -> pa.Table:
    found = shingle_sets(t.column("text").to_pylist(), n)
    at = [i for i, s in enumerate(found) if len(s)]
    return pa.table({"h": t.column("h").take(pa.array(at, pa.int64())), "shingles": pa.array([found[i].tobytes() for i in at], pa.binary())})


def _seed(run: int, level: int) -> np.uint64:
    return mix64(np.array([run * 64 + level + 1], np.uint64))[0]


_KEY = "key bigint"
_ROW = "key bigint, cls bigint, meta bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint"  # meta: run of the round, size in the low 32 bits
_PATH = f"{_ROW}, choices array<int>"


def _choose(what: str, start: int):
    """First-level bucket rows of sets: their keys alone, the rows to compare, or these with the choices of the further levels."""

    def run(t: pa.Table) -> pa.Table:
        sets = [np.frombuffer(b, np.uint64) for b in t.column("shingles").to_pylist()]
        n = len(sets)
        size = np.array([len(s) for s in sets])
        flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
        row = np.repeat(np.arange(n), size)
        first = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
        bound = (2.0**64 / (LAMBDA * size))[row]
        cls = t.column("cls").to_numpy()

        def chosen(r: int, level: int) -> np.ndarray:
            v = mix64(flat ^ _seed(r, level))
            # The least is always chosen: no set drops out of a path for want of a choice.
            return np.flatnonzero((v.astype(np.float64) < bound) | (v == np.minimum.reduceat(v, first)[row])) if n else np.zeros(0, np.int64)

        if what != _KEY and n:
            h = mix64(flat)
            word, bit = h & U(3), U(1) << ((h >> U(2)) & U(63))
            sketch = [np.bitwise_xor.reduceat(np.where(word == U(k), bit, U(0)), first).view(np.int64) for k in range(4)]
        else:
            sketch = [np.zeros(0, np.int64)] * 4
        parts = []
        for i in range(RUNS):
            at = chosen(start + i, 1)
            r = row[at]
            cols = {"key": mix64(flat[at] ^ _seed(start + i, 63)).view(np.int64)}
            if what != _KEY:
                cols |= {"cls": cls[r], "meta": size[r] | i << 32} | {f"s{k}": sketch[k][r] for k in range(4)}
            if what == _PATH:
                # Choices of the further levels: 28 bits of the token below the number of the level.
                ats = [chosen(start + i, level) for level in range(2, LEVELS + 1)]
                cr = np.concatenate([row[x] for x in ats])
                cv = np.concatenate([(flat[x] >> U(36)) | U(k << 28) for k, x in enumerate(ats, 2)])
                order = np.argsort(cr, kind="stable")
                off = np.searchsorted(cr[order], np.arange(n + 1))
                cols["choices"] = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(cv[order].astype(np.int32))).take(pa.array(r))
            parts.append(pa.table(cols))
        return pa.concat_tables(parts)

    return per_block(run, 4 << 20)


def _close(a: np.ndarray, b: np.ndarray, sk: list[np.ndarray], size: np.ndarray, least: float) -> np.ndarray:
    """Pairs (index arrays) whose sizes and sketches allow a similarity of ``least``."""
    sa, sb = size[a].astype(np.float64), size[b].astype(np.float64)
    keep = np.minimum(sa, sb) >= least * np.maximum(sa, sb)
    a, b, most = a[keep], b[keep], ((1 - least) / (1 + least) * (sa + sb))[keep]
    odd = sum(np.bitwise_count(s[a] ^ s[b]).astype(np.int64) for s in sk)
    mean = 128 * (1 - np.exp(-most / 128))
    return keep.nonzero()[0][odd <= mean + 4 * np.sqrt(mean * (1 - mean / 256) + 1)]


def _pairs_in_buckets(least: float, blocked: bool):
    """mapInArrow over rows sorted by key: close pairs within each bucket with a bit for their run, by shifting the sorted
    rows against themselves."""

    def batch(held: list) -> pa.RecordBatch:
        a, b, runs = (np.concatenate([h[k] for h in held]) for k in range(3))
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((runs, b, a))
        a, b, runs = a[order], b[order], runs[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        at = np.flatnonzero(new)
        seen = np.bitwise_or.reduceat(np.int64(1) << runs, at)
        return pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(seen)], ["a", "b", "runs"])

    def found(t: pa.Table):
        key = t.column("key").to_numpy()
        cls = t.column("cls").to_numpy()
        meta = t.column("meta").to_numpy()
        run, size = meta >> 32, meta & 0xFFFFFFFF
        sk = [t.column(f"s{k}").to_numpy().view(np.uint64) for k in range(4)]
        side = t.column("side").to_numpy() if blocked else None
        held, count = [], 0
        d = 1
        at = np.arange(len(key) - 1)
        while True:
            at = at[: np.searchsorted(at, len(key) - d)]
            at = at[key[at] == key[at + d]]
            if not len(at):
                break
            live = at[cls[at] != cls[at + d]]
            if side is not None:
                live = live[(side[live] == 0) | (side[live] != side[live + d])]
            ok = live[_close(live, live + d, sk, size, least)]
            if len(ok):
                held.append((cls[ok], cls[ok + d], run[ok]))
                count += len(ok)
            if count >= 2_000_000:
                yield batch(held)
                held, count = [], 0
            d += 1
        if held:
            yield batch(held)

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < 200_000:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            key = t.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
            if cut == 0:
                continue
            yield from found(t.slice(0, cut))
            held = t.slice(cut).to_batches()
            rows = t.num_rows - cut
        if held:
            yield from found(pa.Table.from_batches(held).combine_chunks())

    return run


def _compare(rows: DataFrame, least: float, blocked: bool = False) -> DataFrame:
    cols = ["key", "cls", "meta", "s0", "s1", "s2", "s3"] + ["side"] * blocked
    return (
        rows.select(*cols)
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_pairs_in_buckets(least, blocked), "a bigint, b bigint, runs bigint")
    )


def candidate_classes(sets: DataFrame, least: float, start: int = 0) -> DataFrame:
    """(a, b, runs), a < b, of the classes that share a bucket in a round and whose sketches are close."""
    keys, rows, paths = (sets.mapInArrow(_choose(w, start), w) for w in (_KEY, _ROW, _PATH))
    out = None
    for depth in range(1, LEVELS + 1):
        big = durable(keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > SMALL))  # keys only; combined first
        some = few(big)
        small = _compare(rows.join(some.select("key"), "key", "left_anti"), least)
        out = small if out is None else out.unionByName(small)
        if big.isEmpty():
            break
        large = paths.join(some, "key")
        if depth < LEVELS:
            here = F.expr(f"filter(choices, x -> shiftright(x, 28) = {depth + 1})")
            level = large.withColumn("token", F.explode(here)).withColumn("key", F.xxhash64("key", "token")).drop("n", "token")
            keys = rows = paths = durable(level)
            continue
        b = F.pmod(F.xxhash64("cls"), F.col("parts"))
        large = (
            large.withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
            .withColumn("b", b)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .withColumn("key", F.xxhash64("key", F.least("b", "other"), F.greatest("b", "other")))
            .withColumn("side", F.when(F.col("b") == F.col("other"), 0).when(F.col("b") < F.col("other"), 1).otherwise(2))
        )
        out = out.unionByName(_compare(large, least, blocked=True))
    return out.groupBy("a", "b").agg(F.bit_or("runs").alias("runs"))


def _exact(least: float):
    def run(t: pa.Table) -> pa.Table:
        keep = []
        for i, (x, y) in enumerate(zip(t.column("sa").to_pylist(), t.column("sb").to_pylist())):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both >= least * (len(x) + len(y) - both) - 1e-9:
                keep.append(i)
        return t.select(["a", "b", "runs"]).take(pa.array(keep, pa.int64()))

    return run


def _checked(sets: DataFrame, cand: DataFrame, least: float) -> DataFrame:
    """The candidates that have the similarity on their full sets; sets without a candidate are not shuffled."""
    cand = durable(cand)
    wanted = durable(cand.select(F.col("a").alias("cls")).unionAll(cand.select("b")).distinct())
    some = sets.join(few(wanted), "cls", "left_semi").select("cls", "shingles")
    pairs = (
        cand.join(some.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a")
        .join(some.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b")
        .select("a", "b", "runs", "sa", "sb")
    )
    return durable(pairs.mapInArrow(per_block(_exact(least), 8 << 20), "a bigint, b bigint, runs bigint"))


def estimated_recall(pairs: DataFrame) -> float:
    """Share of the pairs that a round has met, from the numbers of those that it met once and twice (Chao)."""
    n = F.bit_count("runs")
    r = pairs.agg(F.count("*").alias("all"), F.count_if(n == 1).alias("one"), F.count_if(n == 2).alias("two")).first()
    missed = r.one * (r.one - 1) / (2 * (r.two + 1))
    return r["all"] / (r["all"] + missed) if r["all"] else 1.0


def similar_classes(sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a < b) of classes whose sets have at least the similarity ``least``, checked on the full sets."""
    out, missed = None, 1.0
    for k in range(ROUNDS):
        pairs = _checked(sets, candidate_classes(sets, least, k * RUNS), least)
        out = pairs if out is None else out.unionByName(pairs)
        missed *= 1 - estimated_recall(pairs)
        if missed <= 1 - TARGET:
            break
    else:
        log.warning("near-duplicates: estimated recall %.5f after %d rounds", 1 - missed, ROUNDS)
    return out.select("a", "b") if k == 0 else out.select("a", "b").distinct()


def record_sets(records: DataFrame, n: int = 3) -> tuple[DataFrame, DataFrame]:
    """(id, cls) of the current rows that have a shingle, and (cls, shingles) of every class; both kept."""
    text = F.concat(F.coalesce("signature", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    rows = records.filter("id is not null").select("id", "indexed_at", F.lower(text).alias("text")).withColumn("h", F.unhex(F.md5("text")))
    now = durable(current(rows.select("id", "indexed_at", "h"), "h"))
    texts = rows.select("h", "text").dropDuplicates(["h"]).join(now.select("h").distinct(), "h", "left_semi")
    kept = durable(
        texts.mapInArrow(per_block(lambda t: _sets(t, n), 4 << 20), "h binary, shingles binary").select(F.monotonically_increasing_id().alias("cls"), "h", "shingles")
    )
    return durable(now.join(kept.select("h", "cls"), "h").select("id", "cls")), kept.select("cls", "shingles")


def _copies(member: DataFrame) -> DataFrame:
    """(id_a, id_b) of every two rows of one class; a class of many rows is paired in blocks of about ``COPIES``."""
    sizes = member.groupBy("cls").agg(F.count("*").alias("n")).filter("n > 1")
    rows = (
        member.join(sizes, "cls")
        .withColumn("parts", F.ceil(F.col("n") / COPIES).cast("int"))
        .select("cls", "id", "parts", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    )
    left = rows.select("cls", F.col("id").alias("id_a"), F.col("part").alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"))
    right = rows.select("cls", F.col("id").alias("id_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.col("part").alias("j"))
    return left.join(right, ["cls", "i", "j"]).filter("id_a < id_b").select("id_a", "id_b")


def near_pairs(records: DataFrame, least: float = 0.7, n: int = 3) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of current rows with a similarity of at least ``least``.

    Copies are expanded here because the query asks for pairs of rows; :func:`near_groups` gives classes instead.
    """
    member, sets = record_sets(records, n)
    across = (
        similar_classes(sets, least)
        .join(member.select(F.col("cls").alias("a"), F.col("id").alias("x")), "a")
        .join(member.select(F.col("cls").alias("b"), F.col("id").alias("y")), "b")
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    )
    return across.unionByName(_copies(member))


def near_groups(records: DataFrame, least: float = 0.7, n: int = 3) -> DataFrame:
    """One row per current record with a shingle: id, cls (the least id of its class), copies in the class and links of the
    class to others."""
    member, sets = record_sets(records, n)
    pairs = similar_classes(sets, least)
    links = pairs.select("a").unionAll(pairs.select("b")).groupBy(F.col("a").alias("n")).agg(F.count("*").alias("links"))
    classes = member.groupBy(F.col("cls").alias("n")).agg(F.min("id").alias("cls"), F.count("*").alias("copies"))
    whole = classes.join(links, "n", "left").fillna(0, ["links"])
    return member.withColumnRenamed("cls", "n").join(whole, "n").select("id", "cls", "copies", "links")
