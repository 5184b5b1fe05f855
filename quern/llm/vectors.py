"""Most similar vectors for every vector by shifted space-filling curves (problem 5).

Vectors are projected to ``DIMS`` random orthogonal directions, shifted and quantised, and each of ``CURVES`` such
projections gives a Hilbert key. Each curve's keys are range-partitioned by Spark and sorted; a row is compared with
the rows of its key window (its block of ``BLOCK`` successive rows and the ``HALO`` rows before it) over 8-bit copies
of the vectors. Windows go on over the borders of range partitions: the last rows of a partition and the first of the
next are brought together once more. Equal keys are parted by the point's number, so no partition follows the rows of
one key. The candidates of all curves are merged and reranked with the full vectors, and points with a common neighbour
are compared once more.

Windows keep every pair whose 8-bit cosine may belong to one of at least ``least``; they choose none by it. A row with more
than ``CROWD * k`` such partners in some window lies in a group that is dense or larger than windows: it is searched exactly.
Crowded rows are put into cells around centres of a sample; a cell meets every point that, by the triangle inequality,
may be close enough to one of its rows, in pairs of blocks. Work there grows with the square of a group, memory does not.

Defined results: of superseded rows only the current one counts, repeated rows count once; vectors that are null, of
another length, all zero or not finite are left out; ids with the same vector are one point of the index (numbered, so
that no two vectors share a number) and expand to the ``k + 1`` least ids; equal cosines rank by id. Of rows with one id
and one indexed_at the one with the greatest hash of its vector counts. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.blocks import per_block
from quern.llm.common import bounded_sample, current, durable

DIMS, BITS, CURVES = 8, 6, 16
BLOCK, HALO = 384, 128
RANGE_ROWS = 8192  # rows in a range partition, at least on average
CROWD = 4  # times k
SAMPLE, CENTRES = 8192, 1024  # of crowded rows; they decide about cost, not about results
LEAST_WIDTH, WIDTH = 4096, 65536  # rows in a block of a cell
SPREAD = 3.0  # standard deviations of a projected coordinate on either side


def hilbert_keys(x: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of unsigned coordinates below 2**bits."""
    x = x.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations from the highest bit down
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) > 0
            t = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] >> b) & 1)
    return key


def _curve(c: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1000 + c)
    q, _ = np.linalg.qr(rng.standard_normal((dim, min(DIMS, dim))))
    return q * np.sqrt(dim), rng.uniform(0, 1, q.shape[1])


def _flat(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    a = col.combine_chunks()
    return a.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _emit(dim: int):
    def run(batches):
        curves = [_curve(c, dim) for c in range(CURVES)]
        for b in batches:
            if not b.num_rows:
                continue
            v = _flat(pa.chunked_array([b.column("vector")]), dim).astype(np.float64)
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            small = np.rint(v * 127 / np.abs(v).max(axis=1, keepdims=True)).astype(np.int8)
            q = pa.array([r.tobytes() for r in small], pa.binary())
            for c, (m, shift) in enumerate(curves):
                y = ((v @ m) / SPREAD + 1) / 2 * ((1 << BITS) - 1) + shift
                key = hilbert_keys(np.clip(y, 0, (1 << BITS) - 1), BITS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key), c, np.int32)), pa.array(key), b.column("pt"), q], ["curve", "key", "pt", "q"]
                )

    return run


def _loosened(least: float, dim: int) -> float:
    """The least cosine of 8-bit copies whose vectors may have a cosine of ``least``.

    A copy differs by at most half a step in each number, the step being at most 1/127 of the vector's length.
    """
    off = 2 * np.arcsin(min(1.0, np.sqrt(dim) / 254))
    return float(np.cos(min(np.pi, np.arccos(least) + off))) - 1e-5  # single precision


def _met(s: np.ndarray, most: int, out: np.ndarray, into: np.ndarray, least: float):
    """Indexes of the pairs of a similarity matrix that reach ``least``; rows and columns with more than ``most`` are crowded."""
    hit = s >= least
    out |= hit.sum(1) > most
    into |= hit.sum(0) > most
    hit &= ~(out[:, None] & into)  # both are searched exactly
    return np.nonzero(hit)


def _unit8(q: pa.ChunkedArray) -> np.ndarray:
    x = np.frombuffer(b"".join(q.to_pylist()), np.int8).reshape(len(q), -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_FOUND = "a bigint, b bigint, border binary"


def _batch(a: np.ndarray, b: np.ndarray, crowd: np.ndarray, border: list[tuple[int, bytes]] = ()) -> pa.RecordBatch:
    """Distinct pairs, crowded points (``b`` is null) and rows of borders."""
    p = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    crowd = np.unique(crowd)
    none = len(p) + len(crowd)
    return pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays([pa.array(p[:, 0].copy()), pa.array(crowd), pa.array([x for x, _ in border], pa.int64())]),
            pa.concat_arrays([pa.array(p[:, 1].copy()), pa.nulls(len(crowd) + len(border), pa.int64())]),
            pa.concat_arrays([pa.nulls(none, pa.binary()), pa.array([x for _, x in border], pa.binary())]),
        ],
        ["a", "b", "border"],
    )


def _window(k: int, least: float):
    """Candidates of each row within its key window, over rows sorted by curve and key, and the rows at both ends of the partition.

    ``border`` holds the number of the partition that a row begins or that follows it, its curve, its side (1: first rows)
    and its 8-bit vector.
    """

    def pairs(q: np.ndarray, pt: np.ndarray, known: int):
        """``known``: rows in front whose pairs are known."""
        n = len(q)
        out_a, out_b = [], []
        crowded = np.zeros(n, bool)
        for lo in range(known, n, BLOCK):
            hi, back = min(n, lo + BLOCK), max(0, lo - HALO)
            s = q[lo:hi] @ q[back:hi].T
            s[np.arange(hi - lo), np.arange(lo - back, hi - back)] = -2
            out, into = np.zeros(hi - lo, bool), np.zeros(hi - back, bool)
            i, j = _met(s, CROWD * k, out, into, least)
            into[lo - back :] |= out
            crowded[back:hi] |= into
            out_a.append(pt[lo + i])
            out_b.append(pt[back + j])
        return np.concatenate(out_a or [pt[:0]]), np.concatenate(out_b or [pt[:0]]), pt[crowded]

    def run(batches):
        part = TaskContext.get().partitionId()
        tail_q, tail_pt, tail_c = None, None, None
        held, rows = [], 0
        head: list[tuple[int, bytes]] = []
        head_c = None

        def edge(c: int, side: int, pts, q8):
            mark = np.array([part + 1 - side, c, side], np.int32).tobytes()
            return [(int(p), mark + x) for p, x in zip(pts, q8)]

        def flush():
            nonlocal tail_q, tail_pt, tail_c, held, rows, head_c
            t = pa.Table.from_batches(held)
            held, rows = [], 0
            c = t.column("curve").to_numpy()
            pt = t.column("pt").to_numpy()
            q8 = np.array(t.column("q").to_pylist(), object)
            q = _unit8(t.column("q"))
            res = []
            for x in np.unique(c):
                at = c == x
                if head_c is None:
                    head_c = x
                if x == head_c and len(head) < BLOCK:
                    head.extend(edge(x, 1, pt[at][: BLOCK - len(head)], q8[at]))
                qq, pp, raw, known = q[at], pt[at], q8[at], 0
                if tail_c == x:
                    known = len(tail_pt)
                    qq, pp, raw = np.concatenate((tail_q, qq)), np.concatenate((tail_pt, pp)), np.concatenate((last, raw))
                res.append(pairs(qq, pp, known))
                tail_q, tail_pt, tail_c = qq[-HALO:], pp[-HALO:], x
                last[:] = []
                last.extend(raw[-HALO:])
            return _batch(*(np.concatenate([r[k] for r in res]) for k in range(3)))

        last: list[bytes] = []
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= 50_000:
                yield flush()
        if held and rows:
            yield flush()
        if head:
            none = np.empty(0, np.int64)
            yield _batch(none, none, none, head + edge(tail_c, 0, tail_pt, last))

    return run


def _over_border(k: int, least: float):
    """Candidates between the last rows of a range partition and the first of the next, of one border."""

    def run(t: pa.Table) -> pa.Table:
        raw = t.column("border").to_pylist()
        first = np.array([x[8] == 1 for x in raw])
        pt = t.column("a").to_numpy()
        q = _unit8(pa.chunked_array([pa.array([x[12:] for x in raw], pa.binary())]))
        x, y = pt[first], pt[~first]
        out, into = np.zeros(len(x), bool), np.zeros(len(y), bool)
        i, j = _met(q[first] @ q[~first].T, CROWD * k, out, into, least)
        return pa.Table.from_batches([_batch(x[i], y[j], np.concatenate([x[out], y[into]]))])

    return run


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))


def _cosines(dim: int):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _flat(pa.chunked_array([b.column("va")]), dim).astype(np.float64)
            y = _flat(pa.chunked_array([b.column("vb")]), dim).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(_cosine(x, y))], ["a", "b", "cos"])

    return run


def _units(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _centres(sample: np.ndarray) -> np.ndarray:
    """Means of the groups of a sample of unit vectors, each group being what is close to its first row."""
    out = []
    while len(sample) and len(out) < CENTRES:
        near = sample @ sample[0] >= 0.8
        near[0] = True
        out.append(sample[near].mean(0))
        sample = sample[~near]
    return _units(np.array(out))


def _angles(centres: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_units(v) @ centres.T, -1, 1))


def _nearest(k: int, least: float, dim: int):
    """The ``k`` best data rows of each query row of a pair of blocks; equal cosines rank by id."""

    def run(t: pa.Table) -> pa.Table:
        of = t.column("query").to_numpy(zero_copy_only=False)
        pt = t.column("pt").to_numpy()
        v = _flat(t.column("vector"), dim).astype(np.float64)
        x, y, qp, dp = v[of], v[~of], pt[of], pt[~of]
        out_a, out_b, out_c = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if len(x) and len(y):
            rank = np.argsort(np.argsort(np.array(t.column("id").filter(pa.array(~of)).to_pylist(), object)))
            xu, yu = _units(x), _units(y)
            order = np.argsort(dp)
            step = max(1, 4_000_000 // len(y))
            for lo in range(0, len(x), step):
                p = qp[lo : lo + step]
                s = xu[lo : lo + step] @ yu.T
                at = np.minimum(np.searchsorted(dp, p, sorter=order), len(dp) - 1)
                own = np.nonzero(dp[order[at]] == p)[0]
                s[own, order[at[own]]] = -2
                floor = np.full(len(p), least)
                if len(y) > k:
                    floor = np.maximum(floor, np.partition(s, len(y) - k, axis=1)[:, len(y) - k])
                i, j = np.nonzero(s >= floor[:, None] - 1e-13)  # more than the error of a sum in double precision
                cos = np.concatenate([_cosine(x[lo + i[n : n + 100_000]], y[j[n : n + 100_000]]) for n in range(0, max(1, len(i)), 100_000)])
                by = np.lexsort((rank[j], -cos, i))
                i, j, cos = i[by], j[by], cos[by]
                keep = (np.arange(len(i)) - np.searchsorted(i, i) < k) & (cos >= least)
                out_a.append(p[i[keep]])
                out_b.append(dp[j[keep]])
                out_c.append(cos[keep])
        return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b), "cos": np.concatenate(out_c)})

    return run


def crowded_points(one: DataFrame, crowd: DataFrame, k: int, least: float, dim: int) -> DataFrame:
    """(a, b, cos): for each point ``a`` of ``crowd`` its ``k`` best among all points with a cosine of at least ``least``, exactly."""
    rows = durable(one.join(crowd.select(F.col("a").alias("pt"), F.lit(True).alias("crowded")), "pt", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False))))
    sample = [r.vector for r in bounded_sample(rows.filter("crowded"), "pt", SAMPLE).select("vector").collect()]
    sample = sample or [rows.filter("crowded").first().vector]
    centres = _centres(_units(np.array(sample, np.float64)))

    def home(t: pa.Table) -> pa.Table:
        angle = _angles(centres, _flat(t.column("vector"), dim).astype(np.float64))
        cell = angle.argmin(1)
        return pa.table({"cell": pa.array(cell, pa.int32()), "angle": angle[np.arange(len(cell)), cell]})

    homes = rows.filter("crowded").select("vector").mapInArrow(per_block(home, 2 << 20), "cell int, angle double")
    size, reach = np.zeros(len(centres), np.int64), np.full(len(centres), -1.0)
    for r in homes.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect():  # one row a centre
        size[r.cell], reach[r.cell] = r.n, r.angle + np.arccos(least) + 1e-6

    def met(t: pa.Table) -> pa.Table:
        cell = np.nonzero(_angles(centres, _flat(t.column("vector"), dim).astype(np.float64)) <= reach)[1]
        return pa.table({"cell": pa.array(np.arange(len(centres)), pa.int32()), "n": np.bincount(cell, minlength=len(centres))})

    data = np.zeros(len(centres), np.int64)
    for r in rows.select("vector").mapInArrow(per_block(met, 2 << 20), "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        data[r.cell] = r.n
    cuts = lambda n: np.maximum(1, np.ceil(n / np.clip(n // 8, LEAST_WIDTH, WIDTH))).astype(np.int64)
    n_query, n_data = cuts(size), cuts(data)

    def deal(t: pa.Table) -> pa.Table:
        pt = t.column("pt").to_numpy()
        angle = _angles(centres, _flat(t.column("vector"), dim).astype(np.float64))
        part = pt * 0x9E3779B1 >> 20 & 0x7FFFFFFF
        of = np.nonzero(t.column("crowded").to_numpy(zero_copy_only=False))[0]
        own = angle[of].argmin(1)
        row, cell = np.nonzero(angle <= reach)
        out = []
        for query, r, c, mine, other in ((True, of, own, n_query, n_data), (False, row, cell, n_data, n_query)):
            times = other[c]
            turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            r, c = np.repeat(r, times), np.repeat(c, times)
            block = part[r] % mine[c]
            at = pa.array(r)
            out.append(
                pa.table({
                    "cell": pa.array(c, pa.int32()), "i": pa.array(block if query else turn, pa.int32()), "j": pa.array(turn if query else block, pa.int32()),
                    "query": np.full(len(r), query), "pt": pt[r], "id": t.column("id").take(at), "vector": t.column("vector").take(at),
                })
            )
        return pa.concat_tables(out)

    return (
        rows.mapInArrow(per_block(deal, 1 << 20), "cell int, i int, j int, query boolean, pt bigint, id string, vector array<float>")
        .groupBy("cell", "i", "j")
        .applyInArrow(_nearest(k, least, dim), "a bigint, b bigint, cos double")
    )


def points(records: DataFrame, dim: int = 64) -> tuple[DataFrame, DataFrame]:
    """(id, pt) of the current rows with a usable vector, and (pt, id, vector) of the distinct vectors with their least ids."""
    v = F.col("vector")
    good = (
        v.isNotNull()
        & (F.size(v) == dim)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    rows = records.filter("id is not null").select(
        "id", "indexed_at", F.coalesce(good, F.lit(False)).alias("good"), F.xxhash64("vector").alias("h"), F.xxhash64(F.lit("second"), "vector").alias("g"), v.cast("array<float>").alias("vector")
    )
    now = durable(current(rows.drop("vector"), "h", "g", "good").filter("good").drop("good"))
    heads = now.groupBy("h", "g").agg(F.min("id").alias("id"))
    one = durable(
        rows.filter("good").select("h", "g", "vector").dropDuplicates(["h", "g"]).join(heads, ["h", "g"])
        .select(F.monotonically_increasing_id().alias("pt"), "h", "g", "id", "vector")
    )
    return durable(now.join(one.select("h", "g", "pt"), ["h", "g"]).select("id", "pt")), one.select("pt", "id", "vector")


def similar_points(one: DataFrame, k: int, least: float, dim: int) -> DataFrame:
    """(a, b, cos) in both directions for the pairs of points that some curve brings together, reranked exactly; crowded points are searched."""
    spark = one.sparkSession
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), one.count() * CURVES // RANGE_ROWS))
    met = durable(
        one.select("pt", "vector").mapInArrow(_emit(dim), "curve int, key bigint, pt bigint, q binary")
        .repartitionByRange(parts, "curve", "key", "pt")
        .sortWithinPartitions("curve", "key", "pt")
        .mapInArrow(_window(k, _loosened(least, dim)), _FOUND)
    )
    over = met.filter("border is not null").groupBy(F.substring("border", 1, 8)).applyInArrow(_over_border(k, _loosened(least, dim)), _FOUND)
    found = durable(met.filter("border is null").unionByName(over).select("a", "b").distinct())
    crowd = found.filter("b is null").select("a")
    known = found.filter("b is not null")
    near = durable(_reranked(known, one, least, dim))
    # Neighbours of one point are mostly neighbours of each other: what no curve brought together meets here.
    sides = near.select(F.col("a").alias("mid"), F.col("b").alias("x")).unionByName(near.select(F.col("b").alias("mid"), F.col("a").alias("x")))
    if not crowd.isEmpty():
        sides = sides.join(crowd.withColumnRenamed("a", "mid"), "mid", "left_anti")
    more = sides.join(sides.select("mid", F.col("x").alias("y")), "mid").filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    exact = near.unionByName(_reranked(more.join(known, ["a", "b"], "left_anti"), one, least, dim))
    both = exact.select(F.explode(F.array(F.struct("a", "b", "cos"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "cos"))).alias("p")).select("p.*")
    return both if crowd.isEmpty() else both.join(crowd, "a", "left_anti").unionByName(crowded_points(one, crowd, k, least, dim))


def _reranked(pairs: DataFrame, one: DataFrame, least: float, dim: int) -> DataFrame:
    """(a, b, cos) of the pairs of points with a cosine of at least ``least``."""
    vec = one.select("pt", "vector")
    return (
        pairs.join(vec.select(F.col("pt").alias("a"), F.col("vector").alias("va")), "a")
        .join(vec.select(F.col("pt").alias("b"), F.col("vector").alias("vb")), "b")
        .select("a", "b", "va", "vb")
        .mapInArrow(_cosines(dim), "a bigint, b bigint, cos double")
        .filter(F.col("cos") >= least)
    )


def most_similar(records: DataFrame, k: int = 5, least: float = 0.9, dim: int = 64) -> DataFrame:
    """(id, other, cos, rank) of the ``k`` most similar other rows with a cosine of at least ``least``."""
    member, one = points(records, dim)
    by_id = Window.partitionBy("pt").orderBy("id")
    heads = (
        member.withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= k + 1)
        .groupBy("pt").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # k + 1 at most
    )
    near = similar_points(one, k, least, dim).filter(F.col("cos") >= least)
    best = Window.partitionBy("a").orderBy(F.desc("cos"), F.col("ids")[0])
    across = (
        near.join(heads.withColumnRenamed("pt", "b"), "b")
        .withColumn("n", F.row_number().over(best))
        .filter(F.col("n") <= k)
        .groupBy("a").agg(F.collect_list(F.struct("cos", "ids")).alias("near"))  # k at most
    )
    own = heads.select(F.col("pt").alias("a"), F.array(F.struct(F.lit(1.0).alias("cos"), "ids")).alias("own"))
    lists = own.join(across, "a", "left").select("a", F.concat("own", F.coalesce("near", F.array().cast("array<struct<cos:double,ids:array<string>>>"))).alias("near"))
    rows = (
        member.withColumnRenamed("pt", "a").join(lists, "a")
        .select("id", F.explode("near").alias("n"))
        .select("id", F.col("n.cos").alias("cos"), F.explode("n.ids").alias("other"))
        .filter("id <> other")
    )
    rank = Window.partitionBy("id").orderBy(F.desc("cos"), "other")
    return rows.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("id", "other", "cos", "rank")


def similar_pairs(records: DataFrame, k: int = 5, least: float = 0.9, dim: int = 64) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs with a cosine of at least ``least`` of which one is among the ``k`` best of the other."""
    m = most_similar(records, k, least, dim)
    return m.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
