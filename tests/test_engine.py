"""Syntax, sources, streams and the engine from end to end."""

import pytest
from pyspark.sql import functions as F

from quern.config import GraphConfig, IndexConfig
from quern.engine import Engine
from quern.errors import EmbeddingFailed, InvalidId
from quern.operators import syntax
from quern.operators.embed import HashEmbedder, QueryEmbedder, embed_batch, embed_documents
from quern.sources.files import scan

PY = '''import os


# opens the door
def open_door(key):
    """Doc."""
    handle = find_handle(key)
    return handle.turn(left, speed=2)


@decorated
class Door(Base, metaclass=Meta):
    """A door that can be opened."""
    def close(self):
        return open_door(self)
'''
TS = """import { x } from './x';

/** Adds two numbers. */
export function addNumbers(a: number, b: number): number {
  return combine(a, b) + obj.method(a);
}

class Shape extends Base implements Drawable {
  draw() { return new Pen(this.color); }
  area() { return helper(1, 2, 3); }
}

const answer = (n: number) => {
  return n * 42 + fortyTwo(n);
};
"""
SAMPLES = {
    "a.go": ("package a\n\n// F does.\nfunc F(x int) int {\n\treturn g(x) + 1000000000 // and so on\n}\n\nfunc (s *T) M(a int) {\n\ts.x = a + 11111111111111\n}\n\ntype T struct {\n\tx int\n\ty int // more of it here\n}\n", {("function_declaration", "F"), ("method_declaration", "M")}),
    "a.rs": ("pub fn run(x: u32) -> u32 {\n    x + 1 // add one to the number\n}\n\nimpl Foo for Bar {\n    fn a(&self) -> usize { self.b }\n    fn c() {}\n}\n\nstruct S {\n    field_number_one: u32,\n    field_number_two: u32,\n}\n", {("function_item", "run"), ("impl_item", "Foo"), ("struct_item", "S")}),
    "A.java": ("package x;\nimport y.Z;\n\n/** Doc. */\npublic class A extends B {\n  int f(int x) { return x + 1; }\n  A() { super(); }\n}\n", {("class_declaration", "A")}),
    "a.c": ("#include <stdio.h>\n\nint add(int a, int b) {\n  return a + b + 0; /* nothing more to do */\n}\n\nstruct point {\n  int x_coordinate;\n  int y_coordinate; int z;\n};\n", {("function_definition", "add"), ("struct_specifier", "point")}),
    "a.cs": ("using X;\nnamespace A.B {\n  class C { int d; void E() { } }\n  class F { int g; void H() { } }\n}\n", {("namespace_declaration", "A")}),
    "a.cpp": ("template <typename T>\nT largest(T a, T b) {\n  return a > b ? a : b; // the larger\n}\n\nnamespace n {\nint f() { return 1; }\nint g() { return 2; } // and more\n}\n", {("template_declaration", None), ("namespace_definition", "n")}),
}


@pytest.mark.parametrize("path", sorted(SAMPLES))
def test_scanner(path):
    text, want = SAMPLES[path]
    _, got = syntax.units(path, text)
    assert want <= {(u[0], u[1]) for u, _ in got}
    for u, _ in got:
        assert u[4].split("\n")[0].strip() in text.split("\n")[u[2] - 1]


NESTED = """import { a } from './a';
namespace Shop.Parts {
  // Opens it.
  export function openShop(key: string): void {
    return unlock(key, obj?.turn(1), new Key(2), obj.deep.call<string>(3));
  }
  interface Door extends Base, Other<Key> {
    open(): void; close(): void; lock(): void;
  }
}
describe('doors', () => {
  const handle = makeHandle(1, 2, 3,
    'more of it');
  function helper(x) {
    function inner() { return x }
    return inner() + 'text that is long enough';
  }
});
if (flag) {
  class Late<T> extends mixin(Base) implements A.B, C<T> {
    run<U>(x: U): U { return this.walk(x); }
    stop() { super.stop(); if (x) { y() } }
  }
}
module.exports = {
  method(a, b) {
    return combine(a, b, 'text that is long enough');
  },
};
export default class extends Thing {
  draw() { return paint(this.color, 'long enough') }
}
function broken( {
export const last = async (n: number) => {
  return n * 42 + fortyTwo(n);
};
abstract class Odd<T = { a: 1 }> {
  abstract f(): void; g = (x: number) => h(x);
}
"""


def test_declarations_within_others_and_behind_broken_ones():
    _, got = syntax.units("x.ts", NESTED)
    units = [(u[0], u[1], u[2], u[3]) for u, _ in got]
    assert units == [
        ("export_statement", "openShop", 4, 6), ("interface_declaration", "Door", 7, 9), ("lexical_declaration", "handle", 12, 13), ("function_declaration", "helper", 14, 17),
        ("class_declaration", "Late", 20, 23), ("method_definition", "method", 26, 28), ("export_statement", None, 30, 32), ("export_statement", "last", 34, 36), ("class_declaration", "Odd", 37, 39),
    ]
    edges = {u[1]: set(e) for u, e in got}
    assert edges["openShop"] == {("unlock", "calls", None), ("turn", "calls", None), ("call", "calls", None), ("openShop", "exports", None)}
    assert edges["helper"] == {("inner", "calls", None)} and edges["method"] == {("combine", "calls", None)}
    assert edges["Late"] == {("mixin", "extends", None), ("mixin", "calls", None), ("A", "implements", None), ("C", "implements", None), ("T", "implements", None), ("walk", "calls", None), ("stop", "calls", None), ("y", "calls", None)}
    assert {("paint", "calls", None), ("Thing", "extends", None)} == edges[None] and ("h", "calls", None) in edges["Odd"]
    assert got[0][0][5] == "// Opens it."


def test_declarations_of_other_languages():
    go = "package a\n\nfunc Map[K comparable](m map[K]struct{ a int }, f func(K) (int, error)) (x []K) {\n\treturn nil // some more text\n}\n\ntype (\n\tA struct{ x int }\n\tB = map[string]int // and more\n)\n"
    assert [(u[0], u[1], u[2], u[3]) for u, _ in syntax.units("a.go", go)[1]] == [("function_declaration", "Map", 3, 5), ("type_declaration", None, 7, 10)]
    rs = "#[derive(Debug)]\npub struct P<T>(pub T, u8)\nwhere T: Clone + Send + Sync + Default;\nunsafe impl<'a, T: X<Y>> Tr<T> for &'a S<T> where T: Q {\n    fn a(&self) {} // some more text here\n}\nmod inner {\n    pub async fn deep() -> Result<(), E> { work().await }\n}\nmacro_rules! m { () => {\n    fn hidden_in_macro(x: u32) -> u32 {\n        x + 1 + 2 + 3 + 4 + 5 } } }\n"
    assert [(u[0], u[1], u[2], u[3]) for u, _ in syntax.units("a.rs", rs)[1]] == [("struct_item", "P", 1, 3), ("impl_item", "Tr", 4, 6), ("mod_item", "inner", 7, 9), ("function_item", "hidden_in_macro", 11, 12)]
    c = "typedef struct node {\n  struct node *next; unsigned flags : 3; int value;\n} node_t;\n\nextern int table[] = {\n  1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15\n};\nstatic int f(int (*cb)(int), char *b[]) {\n  int local_one = cb(1), local_two = cb(2); return b[0][1];\n}\n"
    assert [(u[0], u[1], u[2], u[3]) for u, _ in syntax.units("a.c", c)[1]] == [("struct_specifier", "node", 1, 3), ("declaration", None, 5, 7), ("function_definition", "f", 8, 10)]


def test_python_units():
    lang, got = syntax.units("x.py", PY)
    (f, fe), (c, ce) = got
    assert lang == "python" and f[:4] == ("function_definition", "open_door", 5, 8) and f[5] == "# opens the door"
    assert c[:4] == ("decorated_definition", None, 11, 15) and c[5] is None
    assert ("find_handle", "calls", None) in fe and ("handle", "calls", None) in fe and ("speed", "extends", None) in fe
    assert ("Base", "extends", None) in ce and ("open_door", "calls", None) in ce


def test_script_units():
    _, got = syntax.units("x.ts", TS)
    by = {u[1]: (u, e) for u, e in got}
    assert by["addNumbers"][0][0] == "export_statement" and by["addNumbers"][0][5] == "/** Adds two numbers. */"
    assert {("combine", "calls", None), ("method", "calls", None), ("addNumbers", "exports", None)} <= set(by["addNumbers"][1])
    assert {("Base", "extends", None), ("Drawable", "implements", None), ("helper", "calls", None)} <= set(by["Shape"][1])
    assert not any(e[0] == "Pen" for e in by["Shape"][1])
    assert by["answer"][0][0] == "lexical_declaration"


def test_chunks_and_fallback(spark):
    files = [("p/x.py", PY), ("p/bad.py", "def broken(:\n" + "x = 1\n" * 60), ("p/readme.txt", "hello\nworld"), ("p/none.py", None), ("p/blank.ts", "\n \n"), ("p/bom.py", "﻿" + PY), ("p/long.py", "def f():\n" + "    a_long_name = compute(value, value)\n" * 120)]
    parsed = syntax.parse_files(spark.createDataFrame(files, "file_path string, content string"))
    rows = syntax.chunk_files(parsed).collect()
    by = {}
    for r in rows:
        by.setdefault(r.file_path, []).append(r)
    assert {r.id for r in by["p/x.py"]} == {"p_x_py_L5", "p_x_py_L11"} == {r.id.replace("bom", "x") for r in by["p/bom.py"]}
    assert {r.id for r in by["p/bad.py"]} == {"p_bad_py_L1_fallback0", "p_bad_py_L46_fallback1"} and by["p/bad.py"][0].language == "py"
    assert by["p/readme.txt"][0].node_type == "fallback_chunk" and "p/none.py" not in by and "p/blank.ts" not in by
    assert {r.name for r in by["p/long.py"]} == {"f"} and len(by["p/long.py"]) > 2
    assert "SyntaxError" in parsed.filter("error is not null").first().error
    raw = syntax.raw_edges(parsed).filter("file_path is null" if False else "source_path = 'p/long.py'").collect()
    assert {r.source_id for r in raw} == {"p_long_py_L1_p0"}


def test_documentation_comment_of_any_length():
    doc = "/**\n" + " * See http://example.org/x for the rest of it.\n" * 200 + " */"
    body = "(a: number) {\n  return helper(a, 'some longer text here')\n}\n"
    text = f"/** First. */\nfunction one{body}\n{doc}\nfunction two{body}\nfunction three{body}// Last one.  \n\nfunction four{body}"
    assert {u[1]: u[5] for u in syntax.scan_units("typescript", text)} == {"one": "/** First. */", "two": doc, "three": None, "four": "// Last one."}


def test_chunk_table_is_parsed_by_whole_files(spark, tmp_path):
    from quern.queries import QUERIES

    long = ["def long_one(value):", *[f"    a_long_name_{n} = compute(value, value)" for n in range(70)], "    return finish(value)"]
    windows = [f"const item{n} = make(item{n}, {n})" if n % 30 else f"export function part{n}(a) {{\n  return useful{n}(a, 'some longer text')\n}}" for n in range(60)]
    windows = "\n".join(windows).split("\n")
    broken = ["def broken(:", *["x = 1"] * 60]
    rows = [
        ("r/a.py", "\ufeffdef first(value):\r\n    return helper(value, 'some longer text')", 3, "function_definition"),
        ("r/a.py", "\n".join(long[:40]), 10, "function_definition"), ("r/a.py", "\n".join(long[35:]), 45, "function_definition"), ("r/a.py", "\n".join(long[35:]), 45, "function_definition"),
        ("r/a.py", "def untyped(value):\n    return other(value, 'some longer text here')", 90, None),
        ("r/w.js", "\n".join(windows[:50]), 1, "fallback"), ("r/w.js", "\n".join(windows[45:]), 46, "fallback"),
        ("r/bad.py", "\n".join(broken[:50]), 1, "fallback"), ("r/bad.py", "\n".join(broken[45:]), 46, "fallback"), ("r/null.py", None, None, None),
    ]
    spark.createDataFrame(rows, "file_path string, content string, start_line int, node_type string").write.parquet(f"{tmp_path}/code_chunks.parquet")
    got = QUERIES["ast_chunks"](spark, str(tmp_path)).collect()
    a = {(r.id, r.start_line, r.name) for r in got if r.file_path == "r/a.py" and "_p" not in r.id.removeprefix("r_a_py")}
    assert a == {("r_a_py_L3", 3, "first"), ("r_a_py_L90", 90, "untyped")}
    parts = [r for r in got if r.id.startswith("r_a_py_L10_p")]
    assert {r.name for r in parts} == {"long_one"} and max(r.end_line for r in parts) == 81
    assert {r.name for r in got if r.file_path == "r/w.js"} == {"part0", "part30"}
    assert {(r.start_line, r.end_line, r.node_type) for r in got if r.file_path == "r/bad.py"} == {(1, 50, "fallback_chunk"), (46, 61, "fallback_chunk")}
    edges = {(r.source_id, r.target_symbol) for r in QUERIES["ast_edges"](spark, str(tmp_path)).filter("edge_type = 'calls'").collect()}
    assert {("r_a_py_L3", "helper"), ("r_a_py_L10_p0", "compute"), ("r_a_py_L10_p0", "finish"), ("r_a_py_L90", "other"), ("r_w_js_L1", "useful0")} <= edges


def test_embedding(spark):
    def flaky(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return HashEmbedder(8)(texts)

    got = embed_batch(flaky, ["good", None, "bad", "x" * 5], 8)
    assert [g[2] for g in got] == [True, False, False, True] and got[2][0] == [0.0] * 8 and "RuntimeError" in got[2][3] and got[3][1] == 2
    df = embed_documents(spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "id int, content string"), dimension=8)
    assert {(r.id, r.embed_ok, len(r.vector)) for r in df.collect()} == {(1, True, 8), (2, False, 8), (3, False, 8)}
    calls = []
    q = QueryEmbedder(lambda t: calls.append(t) or HashEmbedder(4)(t))
    assert q("x") == q("x") and len(calls) == 1

    def broken(t):
        raise OSError

    with pytest.raises(EmbeddingFailed):
        QueryEmbedder(broken)("x")


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "src"
    (root / "node_modules").mkdir(parents=True)
    (root / "a.py").write_text(PY)
    (root / "b.ts").write_text(TS)
    (root / "c.py").write_text("def uses_door():\n    thing = open_door('key')\n    return thing, addNumbers(1, 2)\n")
    (root / "empty.py").write_text("")
    (root / "big.py").write_text("x = 1\n" * 300_000)
    (root / "node_modules" / "d.py").write_text(PY)
    (root / "notes.md").write_text("# no")
    return root


def test_scan(spark, corpus):
    rows = {r.file_path.split("/")[-1]: r.skip for r in scan(spark, str(corpus)).collect()}
    assert rows == {"a.py": None, "b.ts": None, "c.py": None, "big.py": "too large"}  # the file source does not list empty files


def test_engine(spark, corpus, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), IndexConfig(str(corpus), graph=GraphConfig(enabled=True)))
    first = e.build()
    assert (first["indexed_files"], first["skipped_files"], first["deleted_files"]) == (3, 1, 0)
    out = e.semantic_search("open door", limit=3)
    assert out["results"] and out["results"][0]["name"] in ("open_door", "uses_door", None) and out["index_stats"]["indexed"]
    assert all(r["file"].endswith(".ts") for r in e.semantic_search("numbers", file_pattern="*.ts")["results"])
    # Unchanged, then one file changed and one removed: edges into the changed file come back.
    assert e.build()["indexed_files"] == 0
    edges = {(r.source_id.split("_")[-3:][0], r.edge_type) for r in e.edges().collect()}
    (corpus / "a.py").write_text(PY.replace("Doc.", "Changed doc."))
    (corpus / "b.ts").unlink()
    again = e.build()
    assert (again["indexed_files"], again["deleted_files"]) == (1, 1)
    assert e.records().filter("file_path like '%b.ts'").count() == 0 and edges
    target = e.nodes().filter("symbol_name = 'open_door'").first().id
    assert e.edges().filter(F.col("target_id") == target).filter("source_id like '%c_py%'").count() == 1
    ctx = e.context_query("uses door", session_id="s1", depth=2, limit=5)
    assert ctx["graph_stats"]["graph_available"] and ctx["session"]["visited_count"] == len(ctx["results"])
    node = ctx["results"][0]["id"]
    ann = e.graph_annotate("s1", node, note="look", links=[ctx["results"][1]["id"]], reasoning="because")
    assert ann["links_created"] == 1 and ann["session_visited_count"] == ctx["session"]["visited_count"]
    s = e.session_summary("s1")
    assert s["session"]["annotation_count"] == 1 and s["session"]["reasoning_count"] == 1 and s["graph_stats"]["total_edges"] >= 2
    for bad in ("a b", "x" * 101, ""):
        with pytest.raises(InvalidId):
            e.session_summary(bad)
    for args in ({"limit": 0}, {"limit": 51}, {"multiplier": 21}):
        with pytest.raises(ValueError):
            e.search("q", **args)
    assert e.metrics()["searches"] == 2 and e.expire_sessions() == 0
    # A full build gives the same records as the increments.
    have = sorted((r.id, r.content_hash) for r in e.records().collect())
    e.build(force=True)
    assert sorted((r.id, r.content_hash) for r in e.records().collect()) == have


def test_search_without_embedder(spark, corpus, tmp_path):
    def broken(texts):
        raise OSError("no model")

    e = Engine(spark, str(tmp_path / "store"), IndexConfig(str(corpus)), embedder=broken)
    e.build()
    rows = e.search("door", limit=2).collect()
    assert rows and all(r.from_fallback for r in rows) and e.store.exists("postings")
    assert e.text_search("key", 3).count() == 2 and e.text_search("door key", 3).count() == 3
    (corpus / "c.py").write_text("def uses_window():\n    thing = open_window('key')\n    return thing, addNumbers(1, 2)\n")
    e.build()
    assert e.text_search("window", 3).count() == 1 and e.search("uses_door").count() == 0
    assert e.context_query("door")["graph_stats"]["graph_available"] is False


def test_watch_stream(spark, corpus, tmp_path):
    from quern.streaming.watch import stop, watch

    e = Engine(spark, str(tmp_path / "store"), IndexConfig(str(corpus)))
    e.build()
    a, c = str(corpus / "a.py"), str(corpus / "c.py")
    rows = [(a, 1, "change", PY.replace("open_door", "first_name")), (a, 2, "change", PY.replace("open_door", "second_name")), (c, 3, "unlink", None)]
    df = spark.createDataFrame(rows, "file_path string, t int, kind string, content string").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    df.write.parquet(str(tmp_path / "changes"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "changes"))
    q = watch(s, e.apply_changes, str(tmp_path / "state"), available_now=True)
    q.awaitTermination(120)
    assert stop(q)
    names = {r.name for r in e.records().collect()}
    assert "second_name" in names and "first_name" not in names and "uses_door" not in names


def test_session_stream_expires(spark, tmp_path):
    from quern.streaming.sessions import session_stream

    df = spark.createDataFrame([("a", 1, "visit", "n", None, None), ("a", 2, "reason", None, None, "t")], "session_id string, seq bigint, action string, node_id string, priority double, text string")
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = []
    q = session_stream(s, ttl_s=None).writeStream.outputMode("update").foreachBatch(lambda b, n: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.session_id, r.visited_count, r.log_count, r.last_seq) for r in got] == [("a", 1, 1, 2)]


def test_session_stream_over_batches_equals_the_fold(spark, tmp_path):
    import random

    from quern.streaming.sessions import Session, session_stream

    rng = random.Random(5)
    schema = "session_id string, seq bigint, action string, node_id string, priority double, text string"
    rows = [(f"s{rng.randrange(3)}", k, rng.choice(["visit", "frontier", "frontier", "reason", "annotate"]), rng.choice([None, *[f"n{n}" for n in range(12)]]), rng.choice([None, float("nan"), 0.5, 2.0, rng.random()]), f"t{k}") for k in range(240)]
    for k in range(4):
        spark.createDataFrame(rows[k * 60 : k * 60 + 60], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = {}

    def keep(b, n):
        got.update({r.session_id: (r.visited_count, r.frontier_count, r.log_count, r.annotation_count, r.last_seq) for r in b.collect()})

    q = session_stream(s, visited_cap=7, log_cap=5, ttl_s=None).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {}
    for sid, seq, action, node, priority, text in rows:
        want.setdefault(sid, Session(None, 7, 5)).apply(seq, action, node, priority, text)
    assert got == {k: v.counts() for k, v in want.items()} and max(v[2] for v in got.values()) == 5


def test_session_stream_drops_idle_sessions(spark, tmp_path):
    import time

    from quern.streaming.sessions import session_stream

    schema = "session_id string, seq bigint, action string, node_id string, priority double, text string"
    put = lambda k: spark.createDataFrame([("a", k, "visit", f"n{k}", None, None)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    put(1)
    s = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = []
    q = session_stream(s, ttl_s=1).writeStream.outputMode("update").foreachBatch(lambda b, n: got.extend((r.last_seq, r.visited_count) for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    def wait(n):
        end = time.time() + 40
        while len(got) < n and time.time() < end:
            time.sleep(0.2)

    try:  # timers keep the query busy, so it is never done with what is available
        wait(1)
        time.sleep(6)
        put(2)
        wait(2)
    finally:
        q.stop()
    assert got == [(1, 1), (2, 1)]  # the second event begins a new session


def test_change_source(spark, tmp_path):
    import os
    import time

    from quern.sources.changes import FileChanges, listing

    root = tmp_path / "w"
    (root / "node_modules").mkdir(parents=True)
    for n in ("a.py", "b.ts", "c.txt", "node_modules/d.py"):
        (root / n).write_text("x = 1")
    old = time.time() - 60
    for p in root.rglob("*.*"):
        os.utime(p, (old, old))
    assert {os.path.basename(p) for p in listing(str(root), 500)} == {"a.py", "b.ts"}
    os.utime(root / "a.py")
    assert {os.path.basename(p) for p in listing(str(root), 5000)} == {"b.ts"}
    os.utime(root / "a.py", (old, old))
    spark.dataSource.register(FileChanges)
    got = []

    def run():
        s = spark.readStream.format("quern_changes").option("path", str(root)).option("settle_ms", "0").load()
        q = s.writeStream.foreachBatch(lambda b, n: got.extend((os.path.basename(r.file_path), r.kind, r.content) for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()

    run()
    assert sorted(got) == [("a.py", "add", "x = 1"), ("b.ts", "add", "x = 1")]
    got.clear()
    (root / "a.py").write_text("x = 22")
    (root / "b.ts").unlink()
    run()
    assert sorted(got, key=str) == [("a.py", "change", "x = 22"), ("b.ts", "unlink", None)]


def test_log_lines(capsys):
    import json
    import logging

    from quern.log import setup

    setup({"QUERN_LOG_FORMAT": "json", "QUERN_LOG_LEVEL": "warn"})
    logging.getLogger("quern.x").info("no")
    logging.getLogger("quern.x").warning("yes %s", 1)
    lines = capsys.readouterr().err.strip().split("\n")
    assert len(lines) == 1 and json.loads(lines[0])["message"] == "yes 1" and json.loads(lines[0])["component"] == "quern.x"


def test_paths_relative_to_the_root(spark, corpus, tmp_path):
    from quern.errors import InvalidFilter, PathOutsideRoot

    (corpus / "app").mkdir()
    (corpus / "app" / "door.py").write_text("def app_door(key):\n    handle = find_handle(key)\n    return handle.turn_slowly(key)\n")
    (corpus / "app2.py").write_text("def other_door(key):\n    handle = find_handle(key)\n    return handle.turn_slowly(key)\n")
    e = Engine(spark, str(tmp_path / "store"), IndexConfig(str(corpus)))
    e.build()
    for path in ("app", "app/", "./app", str(corpus / "app"), "app/../app", "app/door.py"):
        assert {r["name"] for r in e.semantic_search("door", path=path)["results"]} == {"app_door"}, path
    assert len(e.semantic_search("door", path=".")["results"]) > 2
    for path in ("..", "/etc", "app/../../x", str(tmp_path)):
        with pytest.raises(PathOutsideRoot):
            e.semantic_search("door", path=path)
    with pytest.raises(InvalidFilter):
        e.context_query("door", edge_kinds=["calls", "owns"])


def test_a_changed_file_rewrites_its_bucket_and_edges_stay_right(spark, corpus, tmp_path):
    for n in range(12):
        (corpus / f"m{n}.py").write_text(f"def job_{n}(key):\n    first = open_door(key)\n    return job_{(n + 1) % 12}(first)\n")
    config = IndexConfig(str(corpus), graph=GraphConfig(enabled=True))
    e = Engine(spark, str(tmp_path / "store"), config)
    e.build()
    was = e.store._current()[1]["tables"]
    e.graph_annotate("s", e.nodes().filter("symbol_name = 'job_3'").first().id, links=[e.nodes().filter("symbol_name = 'job_9'").first().id, e.nodes().filter("symbol_name = 'job_5'").first().id])
    (corpus / "m4.py").write_text("def job_4(key):\n    first = open_door(key)\n    return job_9(first)\n\n\ndef job_40(key):\n    first = open_door(key)\n    return key + first\n")
    (corpus / "m5.py").unlink()
    (corpus / "m7.py").write_text("# moved down\n" + (corpus / "m7.py").read_text())
    assert e.build()["indexed_files"] == 2
    now = e.store._current()[1]["tables"]
    for t in ("records", "nodes", "raw_edges"):
        assert 1 <= len([b for b in now[t] if now[t][b] != was[t].get(b)]) <= 3
    fresh = Engine(spark, str(tmp_path / "other"), config)
    fresh.build()
    key = lambda d: sorted((r.source_id, r.target_id, r.edge_type, r.weight, r.metadata or "") for r in d.collect())
    assert key(e.edges().filter("edge_type <> 'agent_linked'")) == key(fresh.edges())
    links = e.edges().filter("edge_type = 'agent_linked'").collect()
    assert len(links) == 1 and "m9" in links[0].target_id  # the link to the removed file went with it
    assert sorted(r.id for r in e.nodes().collect()) == sorted(r.id for r in fresh.nodes().collect())
    n = len(e.store.folder.names())
    assert e.vacuum(keep_ms=-10_000) > 0 and len(e.store.folder.names()) < n and key(e.edges().filter("edge_type <> 'agent_linked'")) == key(fresh.edges())


def test_sessions_are_appended_listed_and_deleted(spark, corpus, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    e = Engine(spark, str(tmp_path / "store"), IndexConfig(str(corpus), graph=GraphConfig(enabled=True)))
    e.build()
    node = e.nodes().first().id
    engines = [e, Engine(spark, str(tmp_path / "store"), e.config)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: engines[k % 2].graph_annotate(f"s{k % 2}", node, note=f"n{k}", reasoning=f"r{k}"), range(8)))
    assert e.sessions() == ["s0", "s1"] and e.session_events("s0").filter("action = 'reason'").count() == 4
    assert e.session_summary("s1")["session"]["reasoning_count"] == 4
    assert e.delete_session("s0") and not e.delete_session("s0") and e.sessions() == ["s1"]
    e.COMPACT = 2
    for k in range(3):
        e.graph_annotate("s1", node, reasoning=f"again{k}")
    assert e.session_summary("s1")["session"]["reasoning_count"] == 7
    assert all(len(x) <= 2 for x in e.store._current()[1]["tables"]["events"].values())
    e.close_sessions()
    assert e.sessions() == []


def test_close_meta_and_degraded_graph(spark, corpus, tmp_path, monkeypatch):
    import threading

    from quern.errors import Closed
    from quern.operators import graph

    e = Engine(spark, str(tmp_path / "store"), IndexConfig(str(corpus), graph=GraphConfig(enabled=True)))
    real = graph.resolve_edges

    def fails(*a):
        raise RuntimeError("no graph")

    monkeypatch.setattr("quern.engine.G.resolve_edges", fails)
    assert e.build()["indexed_files"] == 3 and not e.graph_available
    assert e.semantic_search("door")["results"] and e.context_query("door")["graph_stats"]["graph_available"] is False
    monkeypatch.setattr("quern.engine.G.resolve_edges", real)
    (corpus / "c.py").write_text("def uses_door():\n    thing = open_door('other')\n    return thing, addNumbers(1, 2)\n")
    e.build(force=True)
    assert e.graph_available
    e.put_meta("schema", "3")
    assert e.get_meta("schema") == "3" and Engine(spark, str(tmp_path / "store"), e.config).get_meta("schema") == "3"
    e.put_meta("schema", None)
    assert e.get_meta("schema") is None
    m = e.metrics()
    assert m["searches"] == 1 and m["files_indexed"] == 6 and m["chunks_created"] >= 6 and m["index_errors"] == 0
    with pytest.raises(Exception):
        e.semantic_search("door", limit=99)
    assert e.metrics()["search_errors"] == 1
    held, go = threading.Event(), threading.Event()

    def work():
        with e._operation():
            held.set()
            go.wait(30)

    t = threading.Thread(target=work)
    t.start()
    held.wait(30)
    assert e.pending == 1 and e.close(0.1) is False
    with pytest.raises(Closed):
        e.semantic_search("door")
    go.set()
    assert e.close(30) is True and e.pending == 0
    t.join()


def test_recorder_forgets_no_total():
    from quern.operators.metrics import Recorder

    r = Recorder(10)
    for k in range(35):
        r.search(k, 1, k % 5 == 0, k == 7)
    assert len(r.samples) == 10 and r.totals()["searches"] == 35 and r.totals()["fallbacks"] == 7 and r.totals()["search_errors"] == 1
    r.reset()
    assert r.totals()["searches"] == 0 and r.totals()["fallback_rate"] == 0.0


def test_embedder_on_a_device_and_preload():
    from quern.errors import EmbedderUnavailable
    from quern.operators.embed import on_device

    def make(d):
        if d == "gpu":
            raise OSError("none here")
        return HashEmbedder(16)

    e, d = on_device(make)
    assert d == "cpu" and len(e(["x"])[0]) == 16
    with pytest.raises(EmbedderUnavailable):
        on_device(make, ("gpu",))
    q = QueryEmbedder(lambda t: [[0.5] * 7 for _ in t])
    assert q.dimension == 7 and q.preload() == 7
    q("a"), q("a")
    assert q.stats()["hits"] == 1 and q.stats()["dimension"] == 7
    q.clear()
    assert q.stats()["size"] == 0
    one = HashEmbedder(8)
    assert one(["a b a", "", "ß Ω"]) == [one(["a b a"])[0], one([""])[0], one(["ß Ω"])[0]] and one([""]) == [[0.0] * 8]


def test_changes_that_are_too_large_remove_what_was_indexed(spark, tmp_path):
    import os
    import time

    from quern.sources.changes import _Reader
    from quern.sources.files import MAX_BYTES

    root = tmp_path / "w"
    root.mkdir()
    old = time.time() - 60
    (root / "a.py").write_text("def f():\n    return some_long_function_name(1)\n")
    (root / "b.py").write_text("")
    r = _Reader({"path": str(root), "settle_ms": "0"})
    rows, at = r.read(r.initialOffset())
    assert sorted((os.path.basename(p), k, c if k == "skip" else None) for p, _, k, c in rows) == [("a.py", "add", None), ("b.py", "skip", "empty")]
    (root / "a.py").write_text("x = 1\n" * (MAX_BYTES // 6 + 1))
    (root / "b.py").write_text("y = 1")
    rows, at = r.read(at)
    assert sorted((os.path.basename(p), k, c) for p, _, k, c in rows) == [("a.py", "skip", "too large"), ("b.py", "add", "y = 1")]
    os.utime(root / "b.py", (old, old))
    e = Engine(spark, str(tmp_path / "store"), IndexConfig(str(root)))
    e.index(spark.createDataFrame([(str(root / "a.py"), "def f():\n    return some_long_function_name(1)\n", "h")], "file_path string, content string, content_hash string"))
    assert e.records().count() == 1
    e.apply_changes(spark.createDataFrame([(str(root / "a.py"), "skip", "too large")], "file_path string, kind string, content string"))
    assert e.records().count() == 0


def test_debounced_changes(spark, tmp_path):
    from quern.streaming.watch import stop, watch

    schema = "file_path string, ts timestamp, kind string, content string"
    put = lambda n, rows: spark.createDataFrame(rows, "file_path string, t double, kind string, content string").select("file_path", F.timestamp_millis((F.col("t") * 1000).cast("bigint")).alias("ts"), "kind", "content").coalesce(1).write.parquet(str(tmp_path / "in" / n))
    put("1", [("a", 1.0, "add", "1"), ("a", 1.2, "change", "2"), ("b", 1.0, "add", "1"), ("b", 1.3, "change", "2")])
    put("2", [("a", 1.5, "change", "3"), ("c", 9.0, "add", "x")])
    put("3", [("a", 30.0, "unlink", None), ("c", 30.0, "change", "y")])
    put("4", [("d", 60.0, "add", "z")])
    put("5", [("e", 90.0, "add", "z")])
    s = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in" / "1")).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    assert schema.startswith("file_path")
    got = []
    q = watch(s, lambda b: got.extend((r.file_path, r.kind, r.content) for r in b.collect()), str(tmp_path / "cp"), available_now=True, gap="1 second")
    q.awaitTermination(120)
    assert stop(q)
    # The runs that d and e began may go on; a removal comes at once and ends its run.
    # The batch that ends a's first run brings its removal too, and only the last change of a batch counts.
    want = [("b", "change", "2"), ("c", "add", "x"), ("a", "unlink", None), ("a", "unlink", None), ("c", "change", "y")]
    assert sorted((g for g in got if g[0] not in "de"), key=str) == sorted(want, key=str)
    assert got.index(("a", "unlink", None)) < got.index(("c", "change", "y"))


def test_stop_lets_the_batch_end(spark, tmp_path):
    import time

    from quern.streaming.watch import stop, watch

    spark.createDataFrame([("a", "add", "1")], "file_path string, kind string, content string").withColumn("ts", F.current_timestamp()).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    done, began = [], []

    def slow(b):
        began.append(1)
        time.sleep(3)
        done.extend(b.collect())

    q = watch(s, slow, str(tmp_path / "cp"))
    while not began:
        time.sleep(0.05)
    assert stop(q, 60) and len(done) == 1 and not q.isActive


def test_overlapping_roots_are_listed_once(spark, corpus):
    from quern.sources.files import outermost

    assert outermost(["/a/b", "/a", "/ab", "/a/"]) == ["/a", "/ab"]
    (corpus / "app").mkdir()
    (corpus / "app" / "x.py").write_text("x = 1")
    rows = [r.file_path for r in scan(spark, [str(corpus), str(corpus / "app")]).collect()]
    assert len(rows) == len(set(rows)) == 5


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_units_are_those_of_the_recorded_chunk_table():
    """Stored units of whole files come out with the same last line, from the same first line on or behind their comment. What
    is left are files with a wrong extension or a broken place."""
    import duckdb

    rows = duckdb.sql("SELECT DISTINCT file_path, start_line, end_line, content, node_type, id FROM '/root/testdata/sf0.01/code_chunks.parquet' WHERE file_path IS NOT NULL").fetchall()
    files = {}
    for r in rows:
        files.setdefault(r[0], []).append(r)
    same = near = total = 0
    for path, parts in files.items():
        text = syntax.put_together(list({(r[1] or 1, r[3] or "") for r in parts}))
        try:
            found = syntax.units(path, text)[1]
        except (SyntaxError, ValueError, RecursionError):
            continue
        first = {}
        for u, _ in found:
            first.setdefault(u[3], set()).add(u[2])
        for _, a, b, content, kind, id_ in parts:
            if kind in (None, "fallback") or "_p" in id_.rsplit("_L", 1)[-1] or syntax.small(content):
                continue
            total += 1
            same += a in first.get(b, ())
            near += any(a <= x for x in first.get(b, ()))
    assert total > 800 and near >= 0.98 * total and same >= 0.88 * total
