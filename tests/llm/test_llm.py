"""The llm operators against brute force, exact libraries, round trips and defined edge cases."""

import ast
import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.grammars import gll, pda
from quern.llm import bpe, functions, handwritten, languages, mixing, nearpairs, parsing, repetition, vectors

SF = "/root/testdata/sf0.001"
VOCAB = bpe.vocabulary()
needs_vocab = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary")
REC = (
    "id string, vector array<float>, file_path string, content string, start_line int, end_line int, name string, signature string, docstring string, "
    "node_type string, language string, content_hash string, indexed_at timestamp"
)
CHUNK = "id string, file_path string, content string, start_line int, end_line int, name string, node_type string, signature string, docstring string, language string"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, repo_id int, text_format string"


def records(spark, rows):
    """rows: (id, vector, file_path, content, signature, minute)."""
    import datetime

    t0 = datetime.datetime(2025, 1, 1)
    return spark.createDataFrame([(i, v, p, c, 1, 2, None, s, None, "function", "py", "h", None if m is None else t0 + datetime.timedelta(minutes=m)) for i, v, p, c, s, m in rows], REC)


def chunks(spark, rows):
    """rows: (id, file_path, content, start_line, name, node_type, docstring)."""
    return spark.createDataFrame([(i, p, c, s, None, n, t, None, d, None) for i, p, c, s, n, t, d in rows], CHUNK)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None, 1, "plain") for i, t, lang, s in rows], DOC)


# -- problem 8 ----------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCAB)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def encode(texts):
    ids, off = bpe.load(VOCAB).encode(texts)
    return [ids[a:b].tolist() for a, b in zip(off, off[1:])]


HARD = ["", None, " ", "  \n\t x", "a" * 5000, " " * 3001 + "b", "1" * 777, "don't we'll I'M", "<|endoftext|> <|startoftext|>", "日本語とEnglish 混在", "é\u0301\u200d👩‍👩‍👧", "\x00\x1c\x85\xa0\u3000x", "a\u2028b\r\n\r\n c", "_-_=+" * 200, "x\u180ey"]


@needs_vocab
def test_bpe_equals_the_library(exact):
    assert encode(HARD) == exact(HARD)


@needs_vocab
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=6))
def test_bpe_equals_the_library_on_any_text(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCAB)
    t.encode_special_tokens = True
    assert encode(texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@needs_vocab
def test_bpe_round_trip_and_very_long_word():
    text = "".join(random.Random(2).choice("abcdefgh") for _ in range(200_000))
    ids = encode([text])[0]
    from tokenizers import Tokenizer

    assert Tokenizer.from_file(VOCAB).decode(ids) == text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9999), max_size=50))
def test_rank_bitmap(xs):
    b = bpe.RankBitmap(10_000)
    for x in xs:
        b.add(x)
    out = []
    while (r := b.pop_first()) >= 0:
        out.append(r)
    assert out == sorted(set(xs))


@needs_vocab
def test_encode_corpus(spark, exact):
    d = docs(spark, [(i, t, None, None) for i, t in enumerate(HARD)] + [(0, "again", None, None)]).withColumn("ids", F.lit(1)).withColumn("k", F.lit(2))
    got = sorted((r.doc_id, list(r.ids)) for r in bpe.encode_corpus(d).collect())
    assert got == sorted([*zip(range(len(HARD)), exact(HARD)), (0, exact(["again"])[0])])
    assert bpe.encode_corpus(d.filter("false")).count() == 0


# -- problem 10 ---------------------------------------------------------------------------------------------------------
def brute_repeated(text, n=8):
    words = re.findall("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]|[^\\W_\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]+", (text or "").lower())
    seen, mark = set(), [0] * len(words)
    for i in range(len(words) - n + 1):
        g = tuple(words[i : i + n])
        if g in seen:
            mark[i : i + n] = [1] * n
        seen.add(g)
    return len(words), sum(mark)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "A", "の", "漢字", "x1", "_", "\n", "-"]), max_size=120), max_size=4))
def test_repetition(parts):
    texts = [" ".join(p) for p in parts] + [None, ""]
    n, r = repetition.repeated_words(texts)
    assert list(zip(n.tolist(), r.tolist())) == [brute_repeated(t) for t in texts]


def test_repetition_rows(spark):
    rep = "one two three four five six seven eight nine. " * 20
    d = docs(spark, [(1, rep, None, None), (2, None, None, None), (3, "", None, None), (1, rep, None, None), (4, rep * 2000, None, None)]).withColumn("share", F.lit("x"))
    got = sorted((r.doc_id, r.n_words, r.n_repeated) for r in repetition.repeated_share(d).collect())
    assert got == [(1, 180, 171), (1, 180, 171), (2, 0, 0), (3, 0, 0), (4, 360_000, 359_991)]
    assert repetition.repeated_share(d.filter("false")).count() == 0
    assert repetition.line_frequency(d.filter("false")).count() == 0


# -- problem 9 ----------------------------------------------------------------------------------------------------------
@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.floats(0, 1e6)), min_size=1, max_size=8), st.floats(0, 1e7))
def test_waterfill(parts, budget):
    need = {str(i): p for i, p in enumerate(parts)}
    got = mixing.waterfill(need, budget)
    room = sum(c for w, c in parts if w > 0 and c > 0)
    assert sum(got.values()) == pytest.approx(min(budget, room), rel=1e-6, abs=1e-3)
    assert all(-1e-9 <= got[s] <= need[s][1] + 1e-6 for s in need)
    # Sources that are not clamped share in proportion to their targets.
    free = [(got[s] / need[s][0]) for s in need if need[s][0] > 1e-6 and 1e-6 < got[s] < need[s][1] * (1 - 1e-9)]
    assert not free or max(free) == pytest.approx(min(free), rel=1e-6)


@needs_vocab
def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(1, 30))), None, rng.choice(["Code", " code ", "CODE", "docs", "docs", "docs", "none", None])) for i in range(600)]
    rows += [(900, None, None, "docs"), (901, "", None, "code"), (5, "repeat me", None, "docs")]
    d = docs(spark, rows)
    t = spark.createDataFrame([("code", 0.5, 3), ("Docs ", 0.3, 1), ("rare", 0.2, 4), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    drawn, report = mixing.mix(d, t)
    rep = {r.source: r for r in report.collect()}
    assert set(rep) == {"code", "docs", "rare"} and rep["rare"].used_tokens == 0 and rep["rare"].docs == 0
    total = rep["code"].tokens + rep["docs"].tokens
    want = mixing.waterfill({"code": (0.5, 3.0 * rep["code"].tokens), "docs": (0.3, 1.0 * rep["docs"].tokens), "rare": (0.2, 0.0)}, total)
    for s in ("code", "docs"):
        assert abs(rep[s].used_tokens - want[s]) <= 60  # within a document
        assert rep[s].most_repeats <= rep[s].max_repeats
    per = {(r.doc_id, r.source): r.repeats for r in drawn.collect()}
    assert per[(900, "docs")] in (0, 1) and not any(s == "none" for _, s in per)
    again = {(r.doc_id, r.source): r.repeats for r in mixing.mix(d, t)[0].collect()}
    assert per == again
    assert mixing.mix(d.filter("false"), t)[1].filter("used_tokens <> 0").count() == 0
    assert mixing.mix(d, t.filter("false"))[1].count() == 0


# -- problem 6 ----------------------------------------------------------------------------------------------------------
def brute_pairs(rows, least=0.7):
    cur = {}
    for i, _, _, c, s, m in rows:
        if i is not None and (i not in cur or (m if m is not None else -1) > cur[i][0]):
            cur[i] = (m if m is not None else -1, ((s or "") + "\n" + (c or "")).lower())
    sets = {}
    for i, (_, t) in cur.items():
        w = re.findall("[A-Za-z0-9_]+", t)
        if x := set(zip(w, w[1:], w[2:])):
            sets[i] = x
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def test_near_pairs_against_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(900)]
    rows = []
    for k in range(120):
        base = [rng.choice(words) for _ in range(rng.randrange(20, 90))]
        for j in range(rng.randrange(1, 5)):
            t = list(base)
            for _ in range(rng.randrange(0, 7)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((f"id{k}_{j}", None, "f", " ".join(t), "common start of every signature here", j))
    rows += [(f"hot{k}", None, "f", "the very same text in a hundred rows", None, 1) for k in range(100)]
    rows += [("id0_0", None, "f", "older other text of the id", None, -5), ("n1", None, None, None, None, None), ("n2", None, None, "", None, 1), (None, None, None, "x y z", None, 1)]
    df = records(spark, rows + rows[:20]).withColumn("cls", F.lit(1)).withColumn("text", F.lit("x"))
    got = [(r.id_a, r.id_b) for r in nearpairs.near_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows)
    groups = {r.id: r for r in nearpairs.near_groups(df).collect()}
    assert groups["hot0"].copies == 100 and "n1" not in groups
    assert nearpairs.near_pairs(df.filter("false")).count() == 0


def test_dense_bucket_is_not_capped(spark):
    rng = random.Random(1)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(260):  # more near-duplicates than a bucket holds without splitting
        t = list(base)
        t[rng.randrange(60)] = f"x{k}"
        rows.append((f"d{k:03}", None, "f", " ".join(t), None, 1))
    got = {(r.id_a, r.id_b) for r in nearpairs.near_pairs(records(spark, rows)).collect()}
    want = brute_pairs(rows)
    assert len(want) > 30_000 and not got - want and len(got) >= 0.995 * len(want)


# -- problem 5 ----------------------------------------------------------------------------------------------------------
def brute_nearest(rows, k=5, least=0.9):
    cur = {}
    for i, v, _, _, _, m in rows:
        if i not in cur or m > cur[i][0]:
            cur[i] = (m, v)
    good = {i: np.array(v, np.float32).astype(float) for i, (_, v) in cur.items() if v is not None and len(v) == 64 and np.isfinite(v).all() and np.any(v)}
    ids = sorted(good)
    x = np.array([good[i] / np.linalg.norm(good[i]) for i in ids])
    s = (x @ x.T).round(12)
    np.fill_diagonal(s, -2)
    out = set()
    for a in range(len(ids)):
        for b in np.lexsort((np.arange(len(ids)), -s[a]))[:k]:
            if s[a, b] >= least:
                out.add((min(ids[a], ids[b]), max(ids[a], ids[b])))
    return out


def test_similar_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(150):
        c = rng.standard_normal(64)
        for j in range(rng.integers(1, 9)):
            rows.append((f"v{k:03}_{j}", (c + rng.standard_normal(64) * rng.choice([0.05, 0.2, 0.35])).astype(np.float32).tolist(), None, None, None, 1))
    same = rng.standard_normal(64).astype(np.float32).tolist()
    rows += [(f"same{k:02}", same, None, None, None, 1) for k in range(40)]
    rows += [("z", [0.0] * 64, None, None, None, 1), ("s", [1.0] * 3, None, None, None, 1), ("e", [], None, None, None, 1), ("n", None, None, None, None, 1), ("i", [float("inf")] * 64, None, None, None, 1), ("q", [float("nan")] * 64, None, None, None, 1)]
    rows.append(("v000_0", rng.standard_normal(64).astype(np.float32).tolist(), None, None, None, 0))
    df = records(spark, rows + rows[:30]).withColumn("pt", F.lit(1)).withColumn("key", F.lit(2))
    got = {(r.id_a, r.id_b) for r in vectors.similar_pairs(df).collect()}
    want = brute_nearest(rows)
    assert not got - want and len(got & want) >= 0.97 * len(want)
    assert {p for p in want if p[0].startswith("same")} <= got
    assert vectors.similar_pairs(df.filter("false")).count() == 0


def vector_table(spark, ids, v):
    import pyarrow as pa

    t = pa.table({"id": ids, "vector": pa.array(v.tolist(), pa.list_(pa.float32())), "n": pa.array([0] * len(ids))})
    return spark.createDataFrame(t).select("id", F.col("vector").cast("array<float>").alias("vector"), F.timestamp_seconds("n").alias("indexed_at"))


def close_vectors(rng, n, cosine):
    """``n`` distinct vectors with about this cosine between any two, beside their group's direction."""
    c = rng.standard_normal(64)
    z = rng.standard_normal((n, 64))
    return (c / np.linalg.norm(c) + np.sqrt(1 / cosine - 1) * z / 8).astype(np.float32)


def nearest_lists(ids, v, rows, k=5, least=0.9):
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u[rows] @ u.T
    s[np.arange(len(rows)), rows] = -2
    return {(ids[r], ids[j]) for n, r in enumerate(rows) for j in np.argsort(-s[n], kind="stable")[:k] if s[n, j] >= least}


def found_lists(df, ids):
    return {(r.id, r.other) for r in vectors.most_similar(df).filter(F.col("id").isin(ids)).collect()}


def test_nearest_in_a_group_far_larger_than_a_window(spark):
    rng = np.random.default_rng(11)
    v = np.concatenate([close_vectors(rng, 20_000, 0.95), close_vectors(rng, 1_500, 0.93), rng.standard_normal((3_000, 64)).astype(np.float32)])
    ids = [f"v{n:06d}" for n in rng.permutation(len(v))]
    rows = rng.choice(len(v), 400, replace=False)
    want = nearest_lists(ids, v, rows)
    got = found_lists(vector_table(spark, ids, v), [ids[r] for r in rows])
    assert len(want) > 1_500 and got == want


@pytest.mark.parametrize("n", [120, 512])
def test_nearest_among_near_copies_whose_8_bit_cosines_tie(spark, n):
    rng = np.random.default_rng(12)
    v = np.concatenate([close_vectors(rng, n, 0.9999999), rng.standard_normal((1_000, 64)).astype(np.float32)])
    ids = [f"v{x:06d}" for x in rng.permutation(len(v))]
    assert found_lists(vector_table(spark, ids, v), ids[:n]) == nearest_lists(ids, v, np.arange(n))


def test_8_bit_threshold_keeps_spiky_vectors():
    rng = np.random.default_rng(13)
    x, y = np.eye(64)[[0] * 4000], np.zeros((4000, 64))
    x = x + rng.uniform(0.4, 0.6, x.shape) / 127  # near half a step everywhere
    for n in range(4000):
        d = rng.standard_normal(64) * (rng.random(64) < rng.uniform(0.02, 1))
        d -= x[n] * (d @ x[n]) / (x[n] @ x[n])
        y[n] = x[n] / np.linalg.norm(x[n]) + (np.sqrt(1 / 0.81 - 1) - 1e-9) * d / max(np.linalg.norm(d), 1e-9)
    q = [np.rint(v * 127 / np.abs(v).max(axis=1, keepdims=True)) for v in (x, y)]
    cos = (q[0] * q[1]).sum(1) / np.linalg.norm(q[0], axis=1) / np.linalg.norm(q[1], axis=1)
    assert cos.min() >= vectors._loosened(0.9, 64)


def test_hilbert_neighbours_touch():
    pts = np.stack(np.meshgrid(range(8), range(8), range(8), indexing="ij"), -1).reshape(-1, 3)
    key = vectors.hilbert_keys(pts, 3)
    assert sorted(key.tolist()) == list(range(512))
    walk = pts[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


# -- problem 7 ----------------------------------------------------------------------------------------------------------
GOOD = {
    "python": [
        "", "\n\n# c\n", "x = 1", "def f(a, /, b: int = 2, *args, c, d=3, **kw) -> list[int]:\n\treturn [i async for i in x if i]\n", "class A(B, metaclass=M):\n    '''d'''\n    x: int = 5\n\n    @p.q(1)\n    async def f(self): await g(); return\n",
        "if a:\n  pass\nelif b: pass\nelse:\n    x = lambda *a, k=1: (yield)\n", "try:\n  a\nexcept* (E, F) as e:\n  raise X from e\nelse:\n  b\nfinally:\n  c\n", "with open(a) as f, (b) as g:\n  pass\nwith (open(a) as f, open(b)):\n  pass\n",
        "match x:\n    case [1, *r] | {'a': -1, **k} if r: pass\n    case A.B(y=2): pass\n    case _: pass\nmatch = 1\nmatch(x)\n", "x = {**a, 'b': 1}; y = {*a, 1}; z = {k: v for k, v in b}\n", "a[1:2, ::3, ...] = *b, c\nprint(*a, **b, sep='')\n",
        "f'{x!r:>{w}} {d[\"k\"]}' 'b' r'\\x00'\n", "x = (\n  1,\n\n  2)\ny = 0xFF + 1_000.5e-3j + .5\n", "global_ = not a in b is not c\nassert x, 'm'\ndel a.b, c[0]\n", "from . import (a as b, c,)\nfrom ...x.y import *\nimport a.b as c, d\n", "type X[T] = list[T]\ndef g[T: int](x: T): ...\n",
        "if (n := f()) > 1: pass\nwhile True:\n    break\nelse:\n    pass\n", "\ufeffx = 1", "a = b = c if d else e\nx @= y ** -z\nx: int\n", "for i, *j in a, b:\n  continue\n",
    ],
    "javascript": [
        "", "a\nb\n++c", "const {a, b: [c = 1, ...d], ...e} = f, g = async (x, {y} = {}) => ({x});", "export default class extends (A) { static #p = 1; get x() { return this.#p } async *[k]() {} static { init() } }", "for (const [k, v] of Object.entries(o)) if (k) continue; else break",
        "label: for (let i = 0, n = a.length; i < n; i++) { do x++; while (x < 5) }", "import a, {b as c} from 'd'; import * as e from \"f\"; export * from 'g'; export {h as default}", "const r = /[/\\]]+/gi.test(s) ? a / b / c : `t${`n${x}`} ${ {a: 1}.a }`;", "try { throw new Error(`x`) } catch { } finally { }",
        "switch (a) { case 1: case b: { } break; default: return_ = 5 }", "x = a ?? b?.c?.[d]?.(e) ** f; x ||= y; delete a.b, void 0, typeof z", "(function () {})(); (() => {})(), new A, new B().c", "var f = function* g() { yield* h; const x = yield }", "if (a) b\nelse c\nreturn_\n", "async () => { for await (const x of y) await z }", "#!/usr/bin/env node\na = {get b() { return 1 }, set b(v) {}, c, 'd': 1, [e]: 2, f() {}, async g() {}, ...h}",
    ],
    "typescript": [
        "interface A<T extends object = {}> extends B<T>, C { readonly a?: string; [k: string]: any; m<U>(x: U): x is string; new (x: number): A; (y: T): void }", "type X<T> = T extends (infer U)[] ? U : { [K in keyof T]-?: T[K] } & Partial<Record<'a' | `b${string}`, [x: number, y?: string]>>;",
        "abstract class A<T> extends B<T> implements C, D { private readonly x: number = 1; constructor(private y?: string, public z = 2) { super() } abstract f(): void; static async g<U>(this: A<U>, ...r: U[]): Promise<void> { } declare q: string }", "enum E { A = 1, B = 'x', } const enum F { G } declare module 'm' { export const x: number; }",
        "export const f = async <T,>(a: Map<string, number>, b?: T): Promise<Map<string, T[]>> => { const x = <any>a as unknown as T; return x!.y!; };", "namespace N.M { export function f(a: string): void; export function f(a: any) { } }", "let a: (x: number) => void, b: typeof c.d, e: unique symbol, g = h satisfies I;", "function assertIsString(v: any): asserts v is string {}\nimport type { T } from './t'; export type { U }; import fs = require('fs');", "@Comp({a: 1}) export class K { @In() x!: string; @Out() y = new E<string>(); }",
    ],
    "go": [
        "", "package a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\nconst (\n\tA = iota\n\tB\n)\n\nvar c, d = 1, \"s\"\n", "func (s *T[K]) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[a]; ok && v > 1 {\n\t\treturn\n\t} else if x := f(); x {\n\t} else {\n\t}\n\treturn 1, nil\n}\n",
        "type S struct {\n\tA, B int `json:\"a\"`\n\t*E\n\tf func(int) (string, error)\n}\ntype I interface {\n\tM(x int) error\n\t~int | string\n}\n", "func f() {\n\tfor i := 0; i < 10; i++ {\n\t\tcontinue\n\t}\n\tfor range ch {\n\t}\n\tfor k, v := range m {\n\t\tdelete(m, k)\n\t\t_ = v\n\t}\n\tfor {\n\t\tbreak\n\t}\n}\n",
        "func f() {\n\tswitch x := y.(type) {\n\tcase int, *T:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-ch:\n\t\tch <- v\n\tcase <-done:\n\t}\n\tgo func() { defer mu.Unlock() }()\n\tx := []T{{1, 2}, {A: 3}}\n\ty := map[string][]int{\"a\": {1}}\n\tz := &T{\n\t\tA: 1,\n\t}\n\ta[1:2:3], p.q = <-c, func(i int) bool { return i&^1 == 0 }\n}\n", "func g[T any, U comparable](x T) map[T]U { return nil }\nvar h = g[int, string](1)\n",
    ],
    "rust": [
        "", "#![allow(x)]\nuse a::{b, c::*, d as e};\nmod m { pub(crate) fn f() {} }\n", "pub async fn f<'a, T: Clone + 'a>(x: &'a mut [T], (a, b): (u8, char)) -> Result<Vec<T>, Box<dyn E + Send>> where T: Ord { let v = x.iter().map(|y| y.a::<u8>()?).collect::<Vec<_>>(); Ok(v) }", "struct S<T>(pub T, u8);\n#[derive(Debug)]\nenum E { A, B { x: i32 }, C(String) = 3 }\nunion U { a: u8 }\n",
        "impl<T> Tr for S<T> { type X = u8; const N: usize = 1 << 3; fn f(&self, mut y: u8) -> Self { match y { 0 | 1 => {} 2..=9 if y > 3 => return S(1), S { a, .. } => (), _ => panic!(\"{}\", y), } while let Some(z) = it.next() { continue 'l; } loop { break 5 } } }", "fn g() { let x = if a { 1 } else { 2 }; let Some(y) = z else { return }; for i in 0..n { v[i] += 1; } let c = move |a: u8, b| -> u8 { a + b }; let s = S { a: 1, ..d }; unsafe { *p = 1 as u8; } x == y && !z || a <= b; let t = (1,); let r = &*q; r#\"raw\"#; 'x' ; b'\\n'; }", "macro_rules! m { ($x:expr) => { $x + 1 }; }\ntrait Q: A + B { fn f(&self); }\nstatic mut X: [u8; 3] = [0; 3];\n",
    ],
    "c": [
        "", "#include <a.h>\n#define X(a) \\\n  a\nint x, *y = 0, z[3] = {1, [2] = 3};\n", "static inline const char *f(int a, char *b[], void (*cb)(int), ...) { return b[a] ? *b : (char *)0; }", "typedef struct node { struct node *next; unsigned f : 3; union { int i; float g; }; } node_t, *node_p;\nenum e { A, B = 1 << 2, };\n",
        "int main(void) { for (int i = 0, n = 5; i < n; ++i) { if (x) continue; else break; } do { x->y.z += sizeof(int) + sizeof x; } while (0); switch (c) { case 'a': default: goto end; } end: return 0; }", "size_t g(size_t n) { T *p = malloc(n * sizeof(*p)); p = (T *)q; a * b; return (size_t)p & ~1UL; }", "extern int printf(const char *, ...);\nint (*fp)(int) = &f;\nvoid h() { struct s v = { .a = 1, .b = { 2 } }; while (*p++ != NULL) ; \"a\" \"b\"; }",
    ],
}
BAD = {
    "python": ["def f(:\n  pass", "x = (1", "if a:\npass", "  x = 1", "if a:\n    b\n  c", "print 'x'", "<<<<<<< a\nx = 1\n=======\n", "x = 5abc", "x = 012", "def f()\n  pass", "class", "else: pass", "x = 'a", "a b", "except: pass", "x = [1, 2", "f(a=1 b=2)", "return = 1", "try:\n  x\n", "for x y: pass", "int main() { }", "x = {a: }", "def f(a, *): pass" if False else "lambda: = 1"],
    "javascript": ["const", "const a", "function f( {", "if (a { }", "a b", "let x = ;", "}", "class A { x: number = 1; }", "x = `a${b", "foo(", "interface A { }", "def f(): pass", "return a b", "for (;;", "a = {b: 1", "x = 'a\n", "if (a &lt; b) { }", "<<<<<<< HEAD\n", "import { a from 'b'", "case 1: x", "async function f() {\n"],
    "typescript": ["interface A { a: }", "type X = ;", "function f(a: ) {}", "const x: = 1", "class A { private }}", "enum E { A B }", "def f(x):\n  return x", "let a: Map<string = 1", "export const"],
    "go": ["func f( {", "func f() {", "x := 1", "func f() { if x { }", "func f() {\n\tx = \n}\n", "type T struct", "package a b", "func f() { for i := range x }", "func f()\n{\n}\n", "const x = 1;;\nfunc", "def f(): pass", "func f() { a b }"],
    "rust": ["fn f( {", "fn f() {", "let x = 1;", "fn f() { let x = ; }", "struct S { a: }", "fn f() { a b }", "fn f() { match x { 1 => } }", "impl {", "def f(): pass", "fn f() -> { }", "fn f() { x.iter( }"],
    "c": ["int f( {", "int f() {", "int x = ;", "x;y z", "int f() { if x { } }", "struct s { int a }", "int f() { return 1 }", "def f(): pass", "int f() { a b; c d e; }", "int f() { for (;;", "func f() int { }", "}"],
}


@pytest.mark.parametrize("lang", sorted(GOOD))
def test_valid_sources(lang):
    for text in GOOD[lang]:
        if lang == "python":
            ast.parse(text.lstrip("\ufeff"))
        assert parsing.first_error(lang, text.lstrip("\ufeff")) is None, text


@pytest.mark.parametrize("lang", sorted(BAD))
def test_invalid_sources(lang):
    for text in BAD[lang]:
        if lang == "python":
            with pytest.raises(SyntaxError):
                ast.parse(text)
        assert parsing.first_error(lang, text) is not None, text


def test_holes_of_format_strings_are_parsed():
    good = ["x = f'{a!r:>{w}} {b[\"k\"]} {{}}'\n", "x = f'{y = }' rf'\\{z:%Y}'\n", "def f():\n    return f'{(yield)}{(lambda: 1)()}{*a, b}'\n", "x = f'\\N{EM DASH} {a if b else c}'\n"]
    bad = ["x = f'{a b ) }'\n", "x = f'{}'\n", "x = 1\ny = f'{a +}'\n", "x = f'{a!q}'\n", "x = f'{a:{b c}}'\n"]
    for t in good:
        ast.parse(t)
        assert parsing.first_error("python", t) is None, t
    for t in bad:
        with pytest.raises(SyntaxError):
            ast.parse(t)
        assert parsing.first_error("python", t) is not None, t
    assert parsing.first_error("python", bad[2])[0] == 2


def test_python_grammar_agrees_with_the_library_on_damaged_files():
    rng = random.Random(0)
    text = open(parsing.__file__, encoding="utf-8").read()
    lines = text.split("\n")
    for _ in range(150):
        cut = list(lines)
        k = rng.randrange(len(cut))
        how = rng.randrange(3)
        if how == 0:
            cut = cut[:k]
        elif how == 1:
            del cut[k]
        elif cut[k]:
            j = rng.randrange(len(cut[k]))
            cut[k] = cut[k][:j] + cut[k][j + 1 :]
        t = "\n".join(cut)
        try:
            compile(t, "x", "exec", ast.PyCF_ONLY_AST)
            ok = True
        except SyntaxError as e:
            ok = False
            if "positional" in e.msg or "cannot assign" in e.msg or "non-default" in e.msg or "parameter without" in e.msg or "f-string" in e.msg or "unicode" in e.msg or "delete" in e.msg or "keyword argument" in e.msg:
                continue  # rules beside the grammar
        assert (parsing.first_error("python", t) is None) == ok, (k, how)


def test_error_lines():
    assert parsing.first_error("python", "a = 1\nb = (\nc d\n")[0] == 3
    assert parsing.first_error("go", "func f() {\n\ta := 1\n\tb c\n}\n")[0] == 3
    assert parsing.first_error("javascript", "a = 1\n\nb c\n")[0] == 3
    assert parsing.first_error("c", "int a;\nint f() {\n")[1] == "end of file"


def test_files(spark):
    rows = [
        ("1", "/r/a.py", "def f():\n    return 1", 1, None, "f", None), ("2", "/r/a.py", "    return 1\n\ndef g():\n    pass", 2, None, "f", None), ("1", "/r/a.py", "def f():\n    return 1", 1, None, "f", None),
        ("3", "/r/b.py", "def f(:", 1, None, "f", None), ("4", "/r/c.txt", "(((", 1, None, "f", None), ("5", None, "(((", 1, None, "f", None), ("6", "/r/d.py", None, None, None, "f", None),
        ("7", "/r2/e.ts", "\ufefffunction f() {\r\n}\r\n", 1, None, "f", None), ("8", "/r2/x/f.ts", "x" * 3_000_000, 1, None, "f", None), ("9", "/zz/g.go", "func f() {", 1, None, "f", None),
    ]
    df = chunks(spark, rows).withColumn("lang", F.lit("x")).withColumn("parts", F.lit(1)).withColumn("start", F.lit(9))
    c = parsing.check_files(df)
    assert {(r.file_path, r.ok) for r in c.collect()} == {("/r/a.py", True), ("/r/b.py", False), ("/r/d.py", True), ("/r2/e.ts", True), ("/r2/x/f.ts", True), ("/zz/g.go", False)}
    repos = spark.createDataFrame([(1, "/r"), (2, "/r2"), (3, "/r2/x"), (4, None)], "repo_id int, root_path string")
    assert {(r.repo_id, r.lang, r.files, r.invalid) for r in parsing.rates(c, repos).collect()} == {(1, "python", 3, 1), (2, "typescript", 1, 0), (3, "typescript", 1, 0), (None, "go", 1, 1)}
    assert parsing.check_files(df.filter("false")).count() == 0


# -- problem 3 ----------------------------------------------------------------------------------------------------------
def test_gll_handles_ambiguity_and_left_recursion():
    g = pda.Grammar("start: start '+' start | start start | 'a' | ;")
    r = gll.parse(g, ["a", "+", "a", "a"])
    assert 4 in r.ends[(g.start, 0)] and 0 in r.ends[(g.start, 0)]
    g = pda.Grammar("start: 'x' start 'y' | ;")
    assert 6 in gll.parse(g, list("xxxyyy")).ends[(g.start, 0)]
    assert 5 not in gll.parse(g, list("xxyyy")).ends[(g.start, 0)]


GOOD_DOC = "Every caller of fooBar waits for the lock and then gives up."
FUNCTIONS = {
    "python": ["def f(x):\n    pass", "@a.b(1)\nasync def f(x: dict = {}) -> list[int]:\n    pass", "# c\ndef f(\n    a,\n):\n    return {"],
    "typescript": ["export default async function f<T>(x: Map<string, T>): Promise<T> {\n}", "const f = async (a, { b }) => {", "export const f = x => x", "private static async f(a: string): Promise<void> {\n}", "<<<<<<< HEAD\nfunction f() {"],
    "go": ["func f(x int) (int, error) {", "func (s *T) f(m map[string]interface{}) *x.Y {"],
    "rust": ["pub(crate) async fn f<'a, T: A<B>>(x: &'a [T]) -> Result<Vec<T>, E> where T: X {", "#[inline]\nfn f() {"],
    "c": ["static const char *f(int a, void (*g)(int)) {", "struct s *f(void)\n{"],
}


@pytest.mark.parametrize("lang", sorted(FUNCTIONS))
def test_functions_are_found(lang):
    for text in FUNCTIONS[lang]:
        f = functions.find_function(lang, text)
        assert f and f[1] == "f", text
        assert functions.find_function("javascript", text)[1] == "f"  # with a wrong extension


def test_what_is_no_function():
    for lang, text in (("typescript", "class A { f() {} }"), ("typescript", "  if (a) {\n"), ("typescript", "const a = b.map((x) => x);"), ("python", "class A:\n  def f(self): pass"), ("go", "type T struct {"), ("rust", "struct S {"), ("c", "struct s {\n int a;\n};"), ("python", "    return f(x)"), ("typescript", "interface A {")):
        assert functions.find_function(lang, text) is None, text


def test_descriptions():
    yes = [GOOD_DOC, f"/**\n * {GOOD_DOC}\n * @param a\n */", "// @returns " + GOOD_DOC, ":return: " + GOOD_DOC, "每次fooBar从列表取得结果然后返回。"]
    no = ["", "TODO", "Opens the big door.", "This is the open big door function for the big door.", "/** ======== */", "// eslint-disable-next-line no-shadow", "@param a\n@param b\n@returns", "const a = b.c(d, 1);", "try:\nexcept ValueError as err:", "如果列表为空"]
    assert all(functions.descriptive(functions.clean(d), "openBigDoor") for d in yes)
    for d in no:
        assert not functions.descriptive(functions.clean(d), "openBigDoor"), d


def test_documented_rows(spark):
    rows = [
        ("a", "/r/a.ts", "function f() {\n}", 1, "f", "function_declaration", GOOD_DOC), ("b", "/r/a.ts", f"// {GOOD_DOC}\nfunction f() {{", 9, None, "function_declaration", None),
        ("c", "/r/a.py", f'def f():\n    """{GOOD_DOC}"""\n', 1, "f", "function_definition", None), ("d_p1", "/r/a.ts", "function f() {\n}", 1, "f (part 2)", "function_declaration", GOOD_DOC),
        ("e", "/r/a.ts", "class A {}", 1, "A", "class_declaration", GOOD_DOC), ("g", "/r/a.ts", "function f() {}", 1, "f", "fallback", GOOD_DOC), ("h", "/r/a.ts", None, 1, "f", None, GOOD_DOC),
        ("i", "/r/a.ts", "function f() {}", 1, None, None, None), ("a", "/r/a.ts", "function f() {\n}", 1, "f", "function_declaration", GOOD_DOC), (None, "/r/a.ts", "function f() {}", 1, None, None, GOOD_DOC),
    ] + [(f"t{k}", "/r/a.ts", f"function g{k}() {{}}", 1, f"g{k}", "function_declaration", f"Some words that every tool of Maker{k} puts here.".replace(f"Maker{k}", "ABCDEFG"[k % 7] + "aker")) for k in range(9)]
    df = chunks(spark, rows).withColumn("template", F.lit(1)).withColumn("description", F.lit("x"))
    got = {r.id: r for r in functions.pairs(df).collect()}
    assert set(got) == {"a", "b", "c"} and got["b"].name == "f" and got["b"].description == GOOD_DOC
    assert functions.documented_ids(df.filter("false")).count() == 0


def test_repeated_texts_are_templates_and_others_stay(spark):
    same = ["Description of the method goes in this place.", "Copyright (c) 2021 the Xab authors. All rights reserved. Use of this file is governed by the terms.", "TODO: somebody should document {} when there is time for it"]
    rows = [(f"s{n}_{k}", "/r/a.ts", f"// {t.format(f'runJob{k}').replace('Xab', 'ABCDEFG'[k] + 'ba')}\nfunction runJob{k}() {{}}", 1, None, "function_declaration", None) for n, t in enumerate(same) for k in range(functions.TEMPLATE)]
    real = ["Returns whether the license key of the given seat has expired.", "Return every open todo: the oldest first, the rest by name.", "All copyright lines of a page in the order in which they stand."]
    rows += [(f"r{k}", "/r/a.py", f'def f{k}(x):\n    """{t}"""\n    return x', 1, None, "function_definition", None) for k, t in enumerate(real)]
    rows += [(f"q{k}", "/r/a.go", f"// The very same text at one function of one name here.\nfunc same() {{\n}}", k, None, "function_declaration", None) for k in range(9)]  # one name: no template
    assert {r.id for r in functions.documented_ids(chunks(spark, rows)).collect()} == {"r0", "r1", "r2"} | {f"q{k}" for k in range(9)}


def test_functions_within_rows_and_broken_bodies(spark):
    d = "// Every caller of fooBar waits for lock number {} and then gives up."
    texts = {
        "js": d.format(1) + "\nfunction pick(a, b) { return (1 + ; ]] }\n" + d.format(2) + "\nfunction next(a) { return a }",
        "ts": "class A {\n  " + d.format(3) + "\n  async foo(x: number): Promise<void> { if (a) { b(); } }\n  " + d.format(4) + "\n  bar = 3;\n}",
        "rs": d.format(5).replace("//", "///") + "\nfn f<T0>() where " + ", ".join(f"T{k}: A + B<C>" for k in range(40)) + " { 1 }",
        "py": 'class A:\n    def f(self):\n        """' + d.format(6)[3:] + '"""\n        return (1\n\n    def g(self, x):\n        """' + d.format(7)[3:] + '"""\n        return x\n',
        "go": d.format(8) + "\nfunc f(x int) (int, error) {\n\treturn 1, nil\n}\n\n" + d.format(9) + "\nfunc (s *T) g() {\n\tfor {\n",
    }
    rows = [(k, f"/r/a.{k}", t, 1, None, "x", None) for k, t in texts.items()]
    got = {(r.id, r.place, r.name, r.body) for r in functions.pairs(chunks(spark, rows)).collect()}
    assert got == {("js", 0, "pick", "broken"), ("js", 1, "next", "whole"), ("ts", 1, "foo", "whole"), ("rs", 0, "f", "whole"), ("py", 1, "f", "broken"), ("py", 2, "g", "whole"), ("go", 0, "f", "whole"), ("go", 1, "g", "cut")}
    assert {r.id for r in functions.documented_ids(chunks(spark, rows)).collect()} == {"js", "rs", "go"}


def test_parts_and_windows_are_read_whole(spark):
    d = "// Every caller of fooBar waits for lock number {} and then gives up."
    lines = [d.format(1), "function pick(a, b) {", "  let x = 1;", "  " + d.format(2), "  function inner(c) {", "    return c;", "  }", "  return x;", "}"]
    part = lambda k, a, b, **x: (f"i_L3_p{k}", "/r/a.ts", "\n".join(lines[a:b]), x.get("start", 3 + a), f"pick (part {k + 1})", "function_declaration", None)
    file = [d.format(3), "func f(x int) (int, error) {", "\treturn 1, nil", "}", "", d.format(4), "func g() {", "\tf(1)", "\tf(2)", "}"]
    window = lambda k, a, b: (f"w_L{a + 1}_fallback{k}", "/r/b.go", "\n".join(file[a:b]), a + 1, None, "fallback", None)
    rows = [part(0, 0, 4), part(1, 2, 6), part(1, 2, 6), part(2, 6, 9, start=None), window(0, 0, 6), window(1, 4, 8), window(2, 7, 10), ("o_p4", "/r/c.ts", "  return 1;\n}\n" + d.format(5) + "\nfunction alone() {}", 90, None, "function_declaration", d.format(6))]
    got = {(r.id, r.place): r for r in functions.pairs(chunks(spark, rows)).collect()}
    assert {(k, r.name, r.body) for k, r in got.items()} == {(("i_L3_p0", 0), "pick", "whole"), (("i_L3_p1", 1), "inner", "whole"), (("w_L1_fallback0", 1), "f", "whole"), (("w_L5_fallback1", 2), "g", "whole"), (("o_p4", 1), "alone", "whole")}
    assert got["i_L3_p0", 0].content == "\n".join(lines) and got["w_L5_fallback1", 2].content == "\n".join(file[6:])
    assert {r.id for r in functions.documented_ids(chunks(spark, rows)).collect()} == {"i_L3_p0"}
    # windows count for the templates; a row is read by its language column, or tried in all, if the extension says nothing
    t = "// Description of the method goes in this place.\nfunc m{}() {{\n}}"
    rows = [(f"x_L{k}_fallback0", f"/r/{k}.go", t.format(k), 1, None, "fallback", None) for k in range(1, functions.TEMPLATE)] + [("y", "/r/y.go", t.format(0), 1, None, "function_declaration", None)]
    more = [("n", None, d.format(7) + "\nfn f() {}", 1, None, "function_item", None), ("u", "/r/a.tsx", d.format(8) + "\nfunction f() {}", 1, None, "function_declaration", None)]
    assert {r.id for r in functions.documented_ids(chunks(spark, rows + more)).collect()} == {"n", "u"}


# -- problem 2 ----------------------------------------------------------------------------------------------------------
def test_language_model_on_held_out_sentences():
    model = languages.fit([])
    held = {
        "en": "When the server starts, it reads the settings and opens a port for the clients.", "de": "Wenn der Server startet, liest er die Einstellungen und öffnet einen Port für die Kunden.", "fr": "Quand le serveur démarre, il lit les réglages et ouvre un port pour les clients.",
        "es": "Cuando el servidor arranca, lee los ajustes y abre un puerto para los clientes.", "pt": "Quando o servidor começa, ele lê as configurações e abre uma porta para os clientes.", "it": "Quando il server si avvia, legge le impostazioni e apre una porta per i clienti.",
        "ru": "Когда сервер запускается, он читает настройки и открывает порт для клиентов.", "zh": "服务器启动时会读取设置，并为客户打开端口。", "ja": "サーバーが起動すると、設定を読み込んでポートを開きます。",
    }
    got = [languages.LANGS[i] for i in languages.classify(list(held.values()), model)]
    assert got == list(held)


def test_text_shares(spark):
    model = languages.fit([])
    de = "Die Funktion wartet auf die Sperre und gibt danach den Speicher wieder frei."
    cut = de.index(" ", 35)
    en = "This part of the code waits until the whole file has been written."
    rows = [
        ("1", "/r/a.ts", f"// {de[:cut]}\n// {de[cut + 1:]}\nfunction f() {{\n  log.warn(\"{en}\");\n  q('SELECT a FROM b WHERE c = 1 AND d = 2');\n  // const x = call(a, b, c);\n}}", 1, None, "f", f"/** {de} */"),
        ("2", "/r/b.py", "x = 1\n", 1, None, "f", None), ("3", "/r/c.go", None, None, None, "f", None), ("4", "/r/d.rs", "fn f() {}\n", 1, None, "f", en), ("5", None, en, 1, None, "f", None), ("4", "/r/d.rs", "fn f() {}\n", 1, None, "f", en),
    ]
    got = {(r.file_path, r.lang): r for r in languages.shares(chunks(spark, rows).withColumn("chars", F.lit(1)).withColumn("lang", F.lit("x")), model).collect()}
    assert set(got) == {("/r/a.ts", "de"), ("/r/a.ts", "en"), ("/r/d.rs", "en")}
    assert got[("/r/a.ts", "de")].chars == len(de) and got[("/r/a.ts", "en")].chars == len(en)
    assert got[("/r/d.rs", "en")].file_chars == len("fn f() {}\n") + len(en)
    assert languages.shares(chunks(spark, rows).filter("false"), model).count() == 0


def test_training_bound(spark):
    d = docs(spark, [(i, "This is a text in the English language, as all can see.", " EN", "x") for i in range(50)] + [(99, None, "de", "x"), (98, "x", None, "x")])
    assert languages.train(d).shape == (languages.BUCKETS, len(languages.LANGS))
    assert languages.train(d.filter("false")).shape[1] == len(languages.LANGS)


# -- problem 1 ----------------------------------------------------------------------------------------------------------
def test_notices():
    tool = ["// Code generated by x v1. DO NOT EDIT.", "# @generated by y", "/* AUTO-GENERATED FILE, source: a.proto */", "// Diese Datei wurde von x maschinell erzeugt und darf nicht geändert werden.", "// This file was produced automatically by x; changes will be lost."]
    hand = ["// rows generated by x are skipped here, see below", "// do not edit this loop without reading the notes", "# callers must not edit the generated ids", "// Licensed to the X group under one or more agreements", "// Copyright (c) 2021 the X authors. All rights reserved."]
    assert all(handwritten.TOOL_NOTICE.search(handwritten.head(t + "\nx = 1")) for t in tool)
    assert not any(handwritten.TOOL_NOTICE.search(handwritten.head(t + "\nx = 1")) or handwritten.COPY_NOTICE.search(t) for t in hand)
    assert not handwritten.TOOL_NOTICE.search(handwritten.head('x = "Code generated by y. DO NOT EDIT."'))
    assert all(handwritten.COPY_NOTICE.search(t) for t in ("// abc 3.2.1 - bundled copy of the upstream release", "/*! abc v1.2.3 | (c) 2016 abc contributors | own terms */", "# Imported verbatim from abc release 1.2; see notes"))
    assert handwritten.VENDOR_PATH.search("/a/vendor/b.js") and not handwritten.VENDOR_PATH.search("/a/vendor_portal/b.js")


def test_too_few_labels_are_said(spark, caplog):
    rows = [(f"h{k}", None, f"/r/hand{k}.py", f"def f{k}():\n    return {k}", None, 1) for k in range(6)] + [("c", None, "/r/vendor/x.py", "x = 1", None, 1)]
    with caplog.at_level("WARNING", "quern"):
        assert [r.file_path for r in handwritten.not_handwritten(records(spark, rows)).collect()] == ["/r/vendor/x.py"]
        assert "no forest" in caplog.text
        rows.append(("t", None, "/r/t.py", "# @generated by x\nx = 1", None, 1))
        assert {"/r/t.py", "/r/vendor/x.py"} <= {r.file_path for r in handwritten.not_handwritten(records(spark, rows)).collect()}
        assert "one forest for all folds" in caplog.text


def test_forest_learns_held_out():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 5))
    y = ((x[:, 0] > 0.3) & (x[:, 3] < 0.5)).astype(int)
    f = handwritten.Forest().fit(x[:400], y[:400])
    assert ((f.score(x[400:]) > 0.5) == y[400:]).mean() > 0.9


def test_handwritten_rows(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("bcdfgkmnprst") + rng.choice("aeiou") for _ in range(3))
    rows = []
    for k in range(90):
        body = "\n".join(rng.choice([f"    {word()}_{word()} = {word()}.{word()}({word()}, {rng.randrange(999)})", f"    if {word()} > {rng.randrange(99)}:\n        return {word()}", f"    for {word()} in {word()}_{word()}:\n        {word()}[{word()}] = {word()}"]) for _ in range(12))
        rows.append((f"h{k}", None, f"/r/hand{k}.py", f"def {word()}():\n{body}", None, 1))
    for k in range(40):
        body = "\n".join(f"_{word().upper()} = _b.Field(name='{word()}', number={n}, offset={rng.randrange(9999)})" for n in range(14))
        rows.append((f"g{k}", None, f"/r/made{k}.py", ("# @generated by x\n" if k % 2 else "") + body, None, 1))
    for k in range(24):
        table = "\n".join("    " + ", ".join(f"0x{rng.randrange(1 << 16):04x}" for _ in range(10)) + "," for _ in range(rng.randrange(12, 40)))
        rows.append((f"d{k}", None, f"/r/table{k}.py", ("# table of x\n" if k % 2 else "") + f"{word().upper()} = [\n{table}\n]", None, 1))
    rows += [("v", None, "/r/third_party/x.py", "def f():\n    pass", None, 1), ("n", None, None, "x", None, 1), ("e", None, "/r/empty.py", None, None, 1)]
    got = {r.file_path for r in handwritten.not_handwritten(records(spark, rows).withColumn("x", F.lit(1)).withColumn("fold", F.lit(0))).collect()}
    made, tables = {f"/r/made{k}.py" for k in range(40)}, {f"/r/table{k}.py" for k in range(24)}
    assert "/r/third_party/x.py" in got and len(got & made) >= 39 and len(got & tables) >= 22 and len(got - made - tables) <= 4
    assert handwritten.not_handwritten(records(spark, rows).filter("false")).count() == 0


# -- all queries over the smallest tables -------------------------------------------------------------------------------
@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_queries_run(spark):
    import duckdb

    from quern.llm import queries

    con = duckdb.connect()
    for t in ("documents", "vector_records"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, q in queries.QUERIES.items():
        df = q(spark, SF)
        rows = df.collect()
        assert rows or name in ("p1_found",), name
        if name in queries.ORACLE:
            cur = con.execute(queries.ORACLE[name])
            cols = [d[0] for d in cur.description]
            assert sorted(tuple(r[c] for c in sorted(cols)) for r in rows) == sorted(tuple(r[cols.index(c)] for c in sorted(cols)) for r in cur.fetchall())


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(parsing.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(?:from|import) quern\.llm", p.read_text(), re.M), p
