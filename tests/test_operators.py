"""Operators over small tables."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from quern.errors import Conflict, GraphError
from quern.functions import vectors as V
from quern.operators import chunking as C
from quern.operators import graph as G
from quern.operators import maintenance as M
from quern.operators import metrics as ME
from quern.operators import search as S
from quern.operators import sessions as SE
from quern.operators.incremental import IncrementalReader, reread_positions, replay_ledger, replay_runs

EDGE = "source_id string, target_id string, edge_type string, weight double, metadata string"


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_window_count_equals_the_loop(spark):
    cases = [(n, w, int(o * w)) for n in (1, 2, 5, 49, 50, 51, 95, 96, 200) for w in (1, 2, 3, 10, 50) for o in (0.0, 0.1, 0.15)]

    def loop(n, w, o):
        at, k = 0, 0
        while at < n:
            end = min(at + w, n)
            k += 1
            at = end - o
            if at >= n - o:
                break
        return k

    df = spark.createDataFrame(cases, "n int, w int, o int").withColumn("k", C.window_count(F.col("n"), F.col("w"), F.col("o")))
    assert all(r.k == loop(r.n, r.w, r.o) for r in df.collect())


def test_split_large_covers_every_line(spark):
    text = "\n".join(f"line {i} " + "x" * 40 for i in range(200))
    df = spark.createDataFrame([("a_L5", "f", text, 5, 204, "foo", "sig", "doc"), ("b_L1", "f", "short", 1, 1, "bar", None, None)], "id string, file_path string, content string, start_line int, end_line int, name string, signature string, docstring string")
    rows = sorted(C.split_large(df).collect(), key=lambda r: (r.id[0], r.start_line))
    parts = [r for r in rows if r.id.startswith("a")]
    assert [r.id for r in parts] == [f"a_L5_p{i}" for i in range(len(parts))] and len(parts) > 3
    assert parts[0].start_line == 5 and parts[-1].end_line == 204
    assert all(b.start_line <= a.end_line + 1 for a, b in zip(parts, parts[1:]))
    assert [r.signature for r in parts] == ["sig"] + [None] * (len(parts) - 1) and all(r.name == "foo" for r in parts)
    assert rows[-1].id == "b_L1" and rows[-1].part_no is None


def test_signature(spark):
    cases = {
        "  def f(x):\n    pass": "def f(x):", "function f(\n  a,\n\n  b\n) {\n x": "function f( a, b )", "a\nb\nc\nd\ne\nf\n{": "a b c d e",
        "\nfoo {": None, "{ x": "{ x", "x: int\n{": "x: int",
    }
    df = spark.createDataFrame(list(cases.items()), "t string, s string")
    for r in df.withColumn("got", C.signature(F.col("t"))).collect():
        assert r.got == r.s, r.t


def test_line_windows_skip_blank_windows(spark):
    df = spark.createDataFrame([("a/b.x", "\n" * 49 + "tail"), ("n", None), ("e", ""), ("b", "\n" * 120 + "z")], "file_path string, content string")
    rows = C.line_windows(df).collect()
    assert {(r.id, r.start_line, r.end_line) for r in rows} == {("a_b_x_L1_fallback0", 1, 50), ("b_L91_fallback0", 91, 121)}


def test_cosine(spark):
    a, z = V.literal([1, 2, 3]), V.literal([0, 0, 0])
    assert one(spark, V.cosine(a, V.literal([2, 4, 6]))) == pytest.approx(1.0)
    assert one(spark, V.cosine(a, z)) == 0.0
    with pytest.raises(Exception, match="different lengths"):
        one(spark, V.cosine(a, V.literal([1, 2])))
    for v, ok in (([1.0], True), ([], False), ([float("nan")], False), ([float("inf")], False)):
        assert one(spark, V.usable(F.array(*[F.lit(x) for x in v]).cast("array<double>"))) is ok


def records(spark):
    rows = [
        ("a", "user auth login", "loginUser", "function loginUser()", [1.0, 0.0], 0.5), ("b", "auth only", None, None, [0.9, 0.1], 0.5),
        ("c", "nothing", "auth", None, [0.0, 1.0], 0.95), ("d", "a.*b [x]", "x", None, [0.5, 0.5], 0.0),
    ]
    return spark.createDataFrame(rows, "id string, content string, name string, signature string, vector array<double>, score double").withColumn("file_path", F.col("id")).withColumn("language", F.lit("go"))


def test_boost(spark):
    got = {r.id: r.b for r in records(spark).withColumn("b", S.boosted(F.col("score"), "AUTH")).collect()}
    assert got["a"] == pytest.approx(0.6) and got["b"] == pytest.approx(0.6) and got["c"] == 1.0 and got["d"] == 0.0
    same = {r.id: r.b for r in records(spark).withColumn("b", S.boosted(F.col("score"), "")).collect()}
    assert same == {"a": 0.5, "b": 0.5, "c": 0.95, "d": 0.0}
    assert {r.id for r in S.keyword_search(records(spark), ".* [x]").collect()} == {"d"}


def test_text_score_may_exceed_one(spark):
    df = spark.createDataFrame([("a", "k", "k", "k")], "id string, content string, name string, signature string")
    assert df.select(S.text_score("k")).first()[0] == pytest.approx(4.5 / 4)


def test_hybrid_keeps_vector_order(spark):
    r = S.hybrid_search(records(spark), "auth", [1.0, 0.0], 3).collect()
    assert [x.id for x in r] == ["a", "b", "d"] and r[0].combined_score == 1.0
    few = S.hybrid_search(records(spark), "auth", [1.0, 0.0], 4, use_rerank=True).collect()
    assert {x.id for x in few} == {"a", "b", "c", "d"} and all(x.combined_score >= x.vector_score for x in few)
    top = S.hybrid_search(records(spark), "auth", [1.0, 0.0], 1, use_rerank=True).collect()
    assert [x.id for x in top] == ["a"]  # equal overlap: the vector score decides


def test_rerank_failures_keep_the_boosted_score(spark):
    def scorer(q, t):
        if "only" in t:
            raise RuntimeError
        return 0.1

    r = S.hybrid_search(records(spark), "auth", [1.0, 0.0], 2, use_rerank=True, scorer=scorer).collect()
    assert r[0].id == "b" and r[0].combined_score == pytest.approx(0.9 / math.hypot(0.9, 0.1) + 0.1, abs=1e-6) or r[0].combined_score == 1.0


def test_no_query_vector_is_a_keyword_search(spark):
    r = S.hybrid_search(records(spark), "auth", None, 2).collect()
    assert [x.id for x in r] == ["c", "a"] and all(x.from_fallback for x in r)


def test_batch_topk_equals_single(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(300)] + [(900, [0.0] * 8), (901, None)]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>").repartition(5)
    q = df.filter("id % 60 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")).filter("query_id < 900")
    got = {}
    for r in S.vector_topk_batch(df, q, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    for qid, v in rows[:300:60]:
        want = [r.id for r in S.vector_topk(df.filter("vector is not null"), v, 4).collect()]
        assert got[qid] == want
    assert S.vector_topk_batch(df, q.filter("false"), 4).count() == 0


BFS = [("A", "B", "calls"), ("B", "C", "calls"), ("C", "D", "calls"), ("A", "E", "imports"), ("D", "A", "calls"), ("A", "A", "calls")]


@pytest.mark.parametrize(
    ("root", "depth", "kinds", "want"),
    [("A", 1, None, {"B", "D", "E"}), ("A", 0, None, {"B", "D", "E"}), ("A", 2, None, {"B", "D", "E", "C"}), ("A", 10, None, {"B", "C", "D", "E"}), ("A", 1, ["imports"], {"E"}), ("C", 1, ["calls"], {"B", "D"}), ("Z", 3, None, set())],
)
def test_bfs(spark, root, depth, kinds, want):
    e = spark.createDataFrame([(*x, 1.0, None) for x in BFS], EDGE)
    got = G.bfs(e, spark.createDataFrame([(root,)], "root_id string"), depth, kinds).collect()
    assert {r.node_id for r in got} == want and len(got) == len(want)


def test_directions(spark):
    e = spark.createDataFrame([("A", "B", "calls", 1.0, None), ("B", "C", "calls", 1.0, None)], EDGE)
    n = spark.createDataFrame([(x, "f", x, "function") for x in "ABC"], "id string, file_path string, symbol_name string, kind string")
    got = {r.node_id: (r.direction, r.hop_direction, r.depth) for r in G.neighbors(e, n, spark.createDataFrame([("A",)], "root_id string"), 2).collect()}
    assert got == {"B": ("outgoing", "outgoing", 1), "C": ("incoming", "outgoing", 2)}


def test_resolution(spark):
    nodes = spark.createDataFrame([("a1", "a", "foo", 1), ("b1", "b", "foo", 1), ("c1", "c", "bar", 1), ("d1", "d", None, 1), ("s", "a", "self", 9)], "id string, file_path string, symbol_name string, start_line int")
    raw = spark.createDataFrame(
        [("s", "a", "foo", "calls", None), ("s", "a", "bar", "imports", "./c"), ("s", "a", "bar", "calls", None), ("s", "a", "none", "calls", None), ("s", "a", "self", "calls", None), ("x", "z", "foo", "calls", None)],
        "source_id string, source_path string, target_symbol string, edge_type string, module_path string",
    )
    got = {(r.source_id, r.target_id, r.edge_type, r.weight, r.metadata) for r in G.resolve_edges(raw, nodes).collect()}
    assert got == {("s", "a1", "calls", 1.0, None), ("s", "c1", "imports", 0.8, "./c"), ("s", "c1", "calls", 0.8, "bar"), ("x", "a1", "calls", 0.8, "foo")}


def test_graph_mutations(spark):
    nodes = spark.createDataFrame([("a", "f", False), ("b", "g", False), ("c", "g", True)], "id string, file_path string, stale boolean")
    edges = spark.createDataFrame([("a", "b", "calls", 0.5, None), ("a", "b", "calls", 0.9, "x"), ("b", "a", "calls", 1.0, None), ("a", "z", "calls", 1.0, None)], EDGE)
    up = G.upsert_edges(edges.filter("weight = 0.5"), edges.filter("weight = 0.9"))
    assert [(r.weight, r.metadata) for r in up.collect()] == [(0.9, "x")]
    assert G.cascade(edges, nodes).count() == 3
    n, e = G.delete_files(nodes, edges, spark.createDataFrame([("g",)], "file_path string"))
    assert [r.id for r in n.collect()] == ["a"] and [r.target_id for r in e.collect()] == ["z"]
    assert {r.id for r in G.mark_stale(nodes, spark.createDataFrame([("f",)], "file_path string")).filter("stale").collect()} == {"a", "c"}
    assert G.link("a", ["a", "b"], "why", nodes) == [("a", "b", "agent_linked", 1.0, "why")]
    with pytest.raises(GraphError):
        G.link("a", ["zz"], None, nodes)
    c = G.counts(nodes, edges).first()
    assert (c.total_nodes, c.stale_nodes, c.total_edges) == (3, 1, 4)


def test_maintenance(spark, tmp_path):
    h = "file_path string, content_hash string"
    d = M.diff(spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], h), spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], h))
    assert {(r.file_path, r.status) for r in d.collect()} == {("a", "same"), ("b", "changed"), ("c", "deleted"), ("d", "new")}
    s = M.SnapshotStore(spark, str(tmp_path / "s"))
    assert s.read("t", "x int").count() == 0 and not s.exists("t")
    s.commit({"t": spark.range(3), "u": spark.range(1)})
    old = s.read("t")
    s.commit({"t": s.read("t").filter("id > 0")})
    assert s.read("t").count() == 2 and old.count() == 3 and s.read("u").count() == 1
    s.clear("t")
    assert not s.exists("t") and s.exists("u")


def test_sessions_batch_equals_state(spark):
    from quern.streaming.sessions import Session

    rng = random.Random(3)
    rows = []
    for seq in range(600):
        s, a, n = f"s{rng.randrange(3)}", rng.choice(["visit", "frontier", "reason", "annotate"]), f"n{rng.randrange(25)}"
        rows.append((s, seq, a, n if rng.random() > 0.05 else None, rng.choice([None, rng.random()]), f"t{seq}"))
    df = spark.createDataFrame(rows, "session_id string, seq bigint, action string, node_id string, priority double, text string").withColumn("ts", F.timestamp_seconds("seq"))
    cap = 12
    batch = {r.session_id: (r.visited_count, r.frontier_count, r.log_count, r.annotation_count) for r in SE.summary(df, cap, 50).collect()}
    for s in ("s0", "s1", "s2"):
        state = Session(visited_cap=cap, log_cap=50)
        for r in rows:
            if r[0] == s:
                state = Session(state.dump(), cap, 50)
                state.apply(*r[1:])
        assert state.counts()[:4] == batch[s]
        want = {(r.node_id, r.priority) for r in SE.frontier(df, cap).filter(F.col("session_id") == s).collect()}
        assert set(state.frontier.items()) == want


def test_session_expiry_is_strict(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1)], "session_id string, t int").withColumn("ts", F.timestamp_seconds("t"))
    now = spark.range(1).select(F.timestamp_seconds(F.lit(3600))).first()[0]
    assert SE.expired(df, now).count() == 0
    later = spark.range(1).select(F.timestamp_seconds(F.lit(3601))).first()[0]
    assert [r.session_id for r in SE.expired(df, later).collect()] == ["a"]


def test_metrics(spark):
    df = spark.createDataFrame([(i, float(i), 1, i % 4 == 0, False) for i in range(1, 2001)], "seq bigint, latency_ms double, results int, used_fallback boolean, failed boolean")
    m = ME.summary(df).first()
    assert (m.p50, m.p99, m.searches, m.fallback_rate, m.error_rate) == (1500.0, 1990.0, 2000, 0.25, 0.0)
    e = ME.summary(df.filter("false")).first()
    assert (e.p50, e.mean_ms, e.searches, e.fallback_rate) == (0.0, 0.0, 0, 0.0)


FEED = "delivery_id bigint, repo_id int, file_path string, content_hash string, indexed_at timestamp, arrived_at timestamp, n_chunks int"
RUNS = "run_id int, started_at timestamp, finished_at timestamp, status string, read_upto timestamp"


def feed(spark, rows):
    t = lambda m: None if m is None else __import__("datetime").datetime(2025, 3, 1) + __import__("datetime").timedelta(minutes=m)
    return spark.createDataFrame([(i, 1, p, h, t(x), t(a), None) for i, p, h, x, a in rows], FEED)


def runs(spark, rows):
    t = lambda m: __import__("datetime").datetime(2025, 3, 1) + __import__("datetime").timedelta(minutes=m)
    return spark.createDataFrame([(i, t(u), None, s, t(u)) for i, s, u in rows], RUNS)


def brute(rows, runs_):
    def state(upto):
        out = {}
        for i, p, h, x, a in rows:
            h = (h or "").strip().lower()
            if not h or p is None or a is None or x is None or a > upto:
                continue
            p = p.replace("\\", "/")
            if p not in out or (x, i, h) > out[p]:
                out[p] = (x, i, h)
        return {p: v[2] for p, v in out.items()}

    got, was = set(), {}
    for r, s, u in sorted(runs_, key=lambda r: (r[2], r[0])):
        if s == "succeeded":
            now = state(u)
            got |= {(r, p) for p, h in now.items() if was.get(p) != h}
            was = now
    return got


def test_incremental_against_brute_force(spark):
    rng = random.Random(5)
    rows = [
        (rng.randrange(400), rng.choice(["/a", "\\a", "/b", "/c/d", None] + ["/hot"] * 5), rng.choice(["aa", " AA", "bb\n", "", None, "cc"]), rng.choice([None] + list(range(0, 9000, 97))), rng.choice([None] + list(range(0, 9000, 61))))
        for _ in range(500)
    ]
    rs = [(k, rng.choice(["succeeded", "failed", "crashed"]), 300 * k + 7) for k in range(1, 30)]
    got = {(r.run_id, r.file_path) for r in replay_runs(feed(spark, rows + rows[:50]), runs(spark, rs)).collect()}
    assert got == brute(rows, rs)


def test_incremental_empty(spark):
    assert replay_runs(feed(spark, []), runs(spark, [(1, "succeeded", 5)])).count() == 0
    assert replay_runs(feed(spark, [(1, "/a", "x", 1, 1)]), runs(spark, [])).count() == 0
    extra = feed(spark, [(1, "/a", "x", 1, 1)]).withColumn("day", F.lit(1)).withColumn("hi", F.lit(2)).withColumn("run_id", F.lit(3))
    assert [(r.run_id, r.file_path) for r in replay_runs(extra, runs(spark, [(1, "succeeded", 5)])).collect()] == [(1, "/a")]


def run_table(spark, rs):
    """(run_id, status, read_upto, started, finished) in minutes; None stays null."""
    c = lambda n: F.timestamp_seconds(F.col(n) * 60 + 1740787200).alias(n)
    return spark.createDataFrame(rs, "run_id int, status string, read_upto bigint, started_at bigint, finished_at bigint").select("run_id", "status", c("read_upto"), c("started_at"), c("finished_at"))


def minute(m):
    return datetime.datetime(2025, 3, 1) + datetime.timedelta(minutes=m)


def test_ledger_equals_replay_and_brute_force(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.randrange(400), rng.choice(["/a", "\\a", "/b", "/c/d", None] + ["/hot"] * 5), rng.choice(["aa", " AA", "bb\n", "", None, "cc"]), rng.choice([None] + list(range(0, 300))), rng.choice([None] + list(range(0, 300)))) for _ in range(400)]
    rs = [(k, s, 30 * k + 7, 30 * k + 8, None if s == "crashed" else 30 * k + rng.choice([12, 45])) for k in range(1, 9) for s in [rng.choice(["succeeded", "succeeded", "failed", "crashed"])]]
    f, r = feed(spark, rows + rows[:50]), run_table(spark, rs)
    want = brute(rows, [x[:3] for x in rs])
    assert {(x.run_id, x.file_path) for x in replay_runs(f, r).collect()} == want
    got = [(x.run_id, x.file_path) for x in replay_ledger(f, r).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert replay_ledger(f.filter("false"), r).count() == 0 and replay_ledger(f, r.filter("false")).count() == 0
    extra = f.withColumn("t", F.lit(1)).withColumn("run_id", F.lit(3)).withColumn("changed", F.lit(True))
    assert {(x.run_id, x.file_path) for x in replay_ledger(extra, r, str(tmp_path / "kept")).collect()} == want
    again = IncrementalReader(spark, str(tmp_path / "kept"))
    n = again.pairs().count()
    assert n == again.pairs().distinct().count()  # the overlap was not taken twice
    assert {(x.run_id, x.file_path) for x in replay_ledger(f, r, str(tmp_path / "kept")).collect()} == want and again.pairs().count() == n


def test_reread_positions(spark):
    rs = [(1, "succeeded", 10, 11, 15), (2, "crashed", 20, 21, None), (3, "failed", 25, 26, 60), (4, "succeeded", 30, 31, 40), (5, "succeeded", 50, 51, 55), (6, "running", 70, 71, None), (7, "succeeded", 80, 81, 90)]
    at = [(r, str(minute(u)), str(minute(m))) for r, u, m in [(1, 10, 10), (4, 30, 21), (5, 50, 26), (7, 80, 71)]]
    assert reread_positions(run_table(spark, rs)) == at


@pytest.mark.parametrize("step", ["pairs", "state", "publish"])
def test_a_run_that_dies_leaves_nothing(spark, tmp_path, monkeypatch, step):
    rows = [(1, "/a", "1", 1, 1), (2, "/b", "1", 2, 2), (3, "/a", "2", 5, 6), (4, "/b", "0", 1, 7), (5, "/a", "1", 9, 11), (6, "/c", "1", 3, 12)]
    f, reader = feed(spark, rows), IncrementalReader(spark, str(tmp_path / "ledger"))
    reader.run(1, f, minute(3), minute(1))
    write, publish = reader.store._write, reader.store.publish_folders

    def dying(name, *a):
        out = write(name, *a)
        if name == step:
            raise RuntimeError("lost")
        return out

    def lost(*a):
        raise RuntimeError("lost")

    monkeypatch.setattr(reader.store, "_write", dying)
    if step == "publish":
        monkeypatch.setattr(reader.store, "publish_folders", lost)
    with pytest.raises(RuntimeError):
        reader.run(2, f, minute(8))
    monkeypatch.setattr(reader.store, "_write", write)
    monkeypatch.setattr(reader.store, "publish_folders", publish)
    assert {(r.run_id, r.file_path) for r in reader.changes().collect()} == {(1, "/a"), (1, "/b")}
    for _ in range(2):  # started again, twice
        assert [(r.run_id, r.file_path, r.content_hash) for r in reader.run(2, f, minute(8), minute(5)).collect()] == [(2, "/a", "2")]
    assert {(r.file_path, r.content_hash) for r in reader.run(3, f, minute(20)).collect()} == {("/a", "1"), ("/c", "1")}
    assert reader.pairs().count() == 6 and reader.store.vacuum(keep_ms=-10_000) >= (step != "publish") and reader.pairs().count() == 6


def test_a_run_reads_the_feed_once(spark, tmp_path, monkeypatch):
    feed(spark, [(1, "/a", "1", 1, 1), (2, "/b", "1", 2, 2), (3, "/a", "2", 5, 6)]).write.parquet(str(tmp_path / "feed"))
    f, reader, read = spark.read.parquet(str(tmp_path / "feed")), IncrementalReader(spark, str(tmp_path / "ledger")), []
    write = reader.store._write

    def noting(name, df, key):
        read.append((name, any("/feed/" in x for x in df.inputFiles())))
        return write(name, df, key)

    monkeypatch.setattr(reader.store, "_write", noting)
    for run, upto in ((1, 3), (2, 8)):
        reader.process(run, f, minute(upto))
    assert read == [("pairs", True), ("state", False)] * 2
    assert {(r.run_id, r.file_path, r.content_hash) for r in reader.changes().collect()} == {(1, "/a", "1"), (1, "/b", "1"), (2, "/a", "2")}


def test_store_buckets_appends_and_meta(spark, tmp_path):
    s = M.SnapshotStore(spark, str(tmp_path / "s"), buckets=8)
    rows = spark.createDataFrame([(f"/f{k}", k) for k in range(40)], "file_path string, n int")
    s.commit({"t": rows}, {"t": "file_path"})
    assert s.read("t", "file_path string, n int").count() == 40
    one = spark.createDataFrame([("/f3", 300)], "file_path string, n int")
    was = s._current()[1]["tables"]["t"]
    b = s.touched(one)
    assert len(b) == 1
    kept = s.read("t", "file_path string, n int", b).filter("file_path <> '/f3'").unionByName(one)
    s.replace({"t": (kept, "file_path", b)})
    now = s._current()[1]["tables"]["t"]
    assert {k for k in was if was[k] != now.get(k)} == set(b)  # the other buckets are not written again
    assert s.read("t", "file_path string, n int").agg(F.sum("n")).first()[0] == sum(range(40)) - 3 + 300
    s.replace({"t": (one.filter("false"), "file_path", b)})  # a bucket can become empty
    assert s.read("t", "file_path string, n int").filter("n = 300").count() == 0
    for _ in range(3):
        s.append({"log": one}, {"log": "file_path"})
    assert s.read("log", "file_path string, n int").count() == 3
    assert s.compact("log", "file_path", least=3) == 1 and s.read("log", "file_path string, n int").count() == 3
    s.put_meta(version="2", other=None)
    assert s.meta("version") == "2" and s.meta("other", "d") == "d"
    s.put_meta(version=None)
    assert s.meta("version") is None
    seen = s._current()[0]
    other = M.SnapshotStore(spark, str(tmp_path / "s"), buckets=8)
    other.append({"log": one}, {"log": "file_path"})
    with pytest.raises(Conflict):
        s._publish(seen, lambda m: None)
    with pytest.raises(Conflict):  # what was read before another commit does not overwrite it
        s.commit({"log": one}, seen=seen)
    assert s.read("log", "file_path string, n int").count() == 4


def test_blocks_of_queries_equal_broadcast_queries(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(f"v{k:03}", rng.choice([None, [], [0.0] * 8, [1.0] * 3]) if k % 20 == 0 else [rng.gauss(0, 1) for _ in range(8)]) for k in range(300)]
    df = spark.createDataFrame(rows + rows[:5], "id string, vector array<float>").withColumn("i", F.lit(1)).withColumn("score", F.lit(0.5))
    q = df.filter("size(vector) = 8 and id < 'v050'").distinct().select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    one = {tuple(r) for r in S.vector_topk_batch(df, q, 4).select("query_id", "id", F.round("score", 9), "rank").collect()}
    for name, n in (("BROADCAST_QUERIES", 0), ("QUERIES", 7), ("ROWS", 50)):
        monkeypatch.setattr(S, name, n)
    blocks = {tuple(r) for r in S.vector_topk_batch(df, q, 4).select("query_id", "id", F.round("score", 9), "rank").collect()}
    assert one == blocks and len(one) == 4 * q.count()
    assert S.vector_topk_batch(df, q.filter("false"), 4).count() == 0 and S.vector_topk_batch(df.filter("false"), q, 4).count() == 0


def test_text_index_equals_the_scan(spark):
    from quern.operators import textindex as TI

    rng = random.Random(9)
    words = ["door", "open", "indoor", "key_9", "Lock", "x1", "é", ""]
    rows = [(f"d{k}", rng.choice([None, "", " ", "!!"]) if k % 15 == 0 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))), rng.choice([None, "openDoor", "lock"]), rng.choice([None, "fn(door)"])) for k in range(120)]
    df = spark.createDataFrame(rows, "id string, content string, name string, signature string")
    index, sizes = TI.postings(df, more=("name", "signature")), TI.lengths(df)
    have = {(r.term, r.id): (r.tf, r.doc_len) for r in index.collect()}
    plain = {(r.term, r.id): (r.tf, r.doc_len) for r in S.inverted_index(df).collect()}
    assert {k: v for k, v in have.items() if v[0]} == plain
    for query in ("door", "open door key", "nothing here", "DOOR lock x1", "9"):
        a = [(r.id, round(r.score, 9)) for r in TI.bm25(index, sizes, query, 15).collect()]
        b = [(r.id, round(r.score, 9)) for r in S.bm25_topk(df, query, 15).collect()]
        assert a == b
        cols = ["id", "combined_score"]
        assert TI.keyword_search(df, index, query, 500).select(cols).collect() == S.keyword_search(df, query, 500).select(cols).collect()
    assert TI.candidates(index, "key_9 door") is None
    assert TI.keyword_search(df, index, "key_9", 500).select(cols).collect() == S.keyword_search(df, "key_9", 500).select(cols).collect()
    assert TI.postings(df.filter("false")).count() == 0


def test_errors_paths_and_lookups(spark):
    from quern.errors import InvalidFilter, PathOutsideRoot, QuernError
    from quern.operators import predicates as P

    e = InvalidFilter("no", pattern="x")
    assert isinstance(e, QuernError) and e.code == "INVALID_FILTER" and e.as_dict() == {"code": "INVALID_FILTER", "message": "no", "details": {"pattern": "x"}}
    assert P.within_root("/Srv/Code", "/srv/code/a", fold=True).endswith("/a")
    with pytest.raises(PathOutsideRoot):
        P.within_root("/Srv/Code", "/srv/code/a", fold=False)
    assert P.PATTERN_LANGUAGES["tsx"] == "typescript" and P.PATTERN_LANGUAGES["pyw"] == "python" and len(P.PATTERN_LANGUAGES) == 10
    n = spark.createDataFrame([("a", "/x", 9, True), ("b", "/x", 2, False), ("c", "/y", 1, False)], "id string, file_path string, start_line int, stale boolean")
    assert [r.id for r in G.nodes_of_file(n, "/x").collect()] == ["b", "a"] and G.node(n, "c").first().file_path == "/y" and [r.id for r in G.stale(n).collect()] == ["a"]


def test_holes_of_format_strings():
    from quern.grammars.lexers import holes

    good = {"f'{x!r:>{w}} {d[\"k\"]}'": ["x", "w", 'd["k"]'], "f'{{}} {x}'": ["x"], "f'{x=}{z==1}{a!=b}'": ["x", "z==1", "a!=b"], "'{x'": [], "rf'\\{x:%Y-%m}'": ["x"], "f'\\N{DASH}{y}'": ["y"], "f'{ {1:2}[1] }'": [" {1:2}[1] "], 'f"""{\na}"""': ["\na"]}
    assert {k: holes(k) for k in good} == good
    assert all(holes(t) is None for t in ("f'{x'", "f'}'", "f'{x!q}'", "f'{x:{y}'"))
