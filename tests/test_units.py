"""Driver-side pieces: filters, ids, cache, settings, rendering."""

import pytest

from quern import render
from quern.cache import LruCache
from quern.config import GraphConfig, IndexConfig
from quern.errors import InvalidFilter, PathOutsideRoot
from quern.functions.text import is_valid_id, keywords
from quern.operators import predicates as P


def test_keywords_keep_duplicates():
    assert keywords("  Foo\tbar foo ") == ["foo", "bar", "foo"]
    assert keywords("") == []


def test_ids():
    assert is_valid_id("a_b-9") and is_valid_id("x" * 500)
    assert not any(map(is_valid_id, ("", "a b", "a;b", "x" * 501, "é")))


def test_compat_patterns():
    assert P.path_pattern("src/test") == "src_test"
    assert "%" + P.glob_pattern("**/*.test.ts") == "%%_%_test_ts"


@pytest.mark.parametrize("bad", ["", "x" * 501])
def test_bad_filters(bad):
    with pytest.raises(InvalidFilter):
        P.path_pattern(bad)


@pytest.mark.parametrize("payload", ["'; DROP TABLE x; --", "1' OR '1'='1", "a\" OR \"\"=\"", "x%27", "\\'; --", "a/*b*/c", "${x}", "a\x00b", "a\nb", "UNION SELECT"])
def test_injection_is_never_sql(spark, payload):
    df = spark.createDataFrame([("a_L1", "/a/b.ts", "typescript")], "id string, file_path string, language string")
    assert df.filter(P.search_filter(payload)).count() == 0
    assert df.filter(P.search_filter(payload, compat=True)).count() in (0, 1)
    with pytest.raises(InvalidFilter):
        P.language_is(payload)


def test_glob_and_prefix(spark):
    paths = ["/r/src/a.ts", "/r/src2/a.ts", "/r/src/x/b.test.ts", "/r/src/x/c.py", "/r/src"]
    df = spark.createDataFrame([(str(i), p, "ts" if p.endswith("ts") else "python") for i, p in enumerate(paths)], "id string, file_path string, language string")
    got = lambda c: sorted(r.file_path for r in df.filter(c).collect())
    assert got(P.under_path("/r/src")) == ["/r/src", "/r/src/a.ts", "/r/src/x/b.test.ts", "/r/src/x/c.py"]
    assert got(P.under_path("/r/src/")) == got(P.under_path("/r/src"))
    assert got(P.matches_glob("**/*.test.ts")) == ["/r/src/x/b.test.ts"]
    assert got(P.matches_glob("*.ts")) == ["/r/src/a.ts", "/r/src/x/b.test.ts", "/r/src2/a.ts"]
    assert got(P.matches_glob("?.py")) == ["/r/src/x/c.py"]
    assert got(P.language_is("typescript")) == ["/r/src/a.ts", "/r/src/x/b.test.ts", "/r/src2/a.ts"]
    assert got(P.language_is("typescript", compat=True)) == []
    assert got(P.matches_glob("*.java", compat=True)) == sorted(paths)  # unknown there: no filter


def test_filters_reach_the_scan(spark, tmp_path):
    df = spark.createDataFrame([("a", "/r/a.ts", "typescript", "x")], "id string, file_path string, language string, content string")
    df.write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    t = spark.read.parquet(str(tmp_path / "t")).filter(P.under_path("/r") & P.matches_glob("*.ts")).select("id")
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(file_path,/r/)" in plan and "StringEndsWith(file_path,.ts)" in plan
    assert "content" not in plan


@pytest.mark.parametrize("path", ["../x", "/etc/passwd", "a/../../b", "..", "a/./../../c"])
def test_paths_stay_within_the_root(tmp_path, path):
    with pytest.raises(PathOutsideRoot):
        P.within_root(str(tmp_path), path)


def test_paths_below_the_root(tmp_path):
    (tmp_path / "a").mkdir()
    assert P.within_root(str(tmp_path), "a/../a") == str((tmp_path / "a").resolve())
    assert P.within_root(str(tmp_path), ".") == str(tmp_path.resolve())
    with pytest.raises(PathOutsideRoot):
        P.within_root(str(tmp_path / "a"), str(tmp_path) + "/ab")


def test_cache():
    now = [0.0]
    c = LruCache(2, 10, lambda: now[0])
    c.set("a", 1)
    c.set("b", None)
    assert c.get("a") == 1 and c.has("b") and c.get("x", 5) == 5
    c.set("c", 3)
    assert not c.has("b") and c.get("a") == 1 and len(c) == 2
    now[0] = 10.0
    assert c.has("a")
    now[0] = 10.1
    assert not c.has("a") and c.delete("c") and not c.delete("c")
    assert c.stats()["hits"] == 2 and c.stats()["misses"] == 1
    with pytest.raises(ValueError):
        LruCache(0)


def test_settings():
    g = GraphConfig.load({"QUERN_GRAPH": "TRUE", "QUERN_GRAPH_DEPTH": "9", "QUERN_SESSION_TTL": "x", "QUERN_EDGE_KINDS": "calls, nope"})
    assert g == GraphConfig(True, 2, 3600, ("calls",))
    assert GraphConfig.load({}) == GraphConfig()
    assert IndexConfig.load("/x", {"QUERN_ROOT": "/y"}).root == "/x" and IndexConfig.load(None, {"QUERN_ROOT": "/y"}).root == "/y"


def test_rendering():
    hit = {"file": "/a.py", "start_line": 1, "end_line": 2, "name": None, "node_type": "t", "score": 0.505, "content": "a\nb", "signature": "s" * 90}
    text = render.search({"query": "q", "total_results": 1, "results": [hit]})
    assert "anonymous" in text and "s" * 77 + "..." in text and "/a.py:1-2" in text
    assert render.search({"query": "q", "total_results": 0, "results": []}) == 'No results found for query: "q"'
    n = {"direction": "outgoing", "edge_type": "calls", "symbol_name": "f", "id": "i", "kind": "function", "file": "/b"}
    text = render.search({"query": "q", "total_results": 1, "results": [hit | {"neighbors": [n] * 7}], "graph_stats": {"graph_available": True, "total_neighbors": 7}})
    assert "(7 graph neighbors)" in text and "... and 2 more" in text and "-> calls: f (function) in /b" in text
    assert render.snake(render.camel({"file_path": 1, "a": 2})) == {"file_path": 1, "a": 2}
    assert "Note: n" in render.annotation({"node_id": "x", "note": "n", "links_created": 0, "session_visited_count": 1})


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    import pytest

    from quern.operators.folders import shared_folder

    def fake(conf, held, master):
        there = N(isDefined=lambda: held is not None, get=lambda: held)
        return N(conf=N(get=lambda k, d=None: conf), sparkContext=N(master=master, _jsc=N(sc=lambda: N(getCheckpointDir=lambda: there))))

    assert shared_folder(fake("hdfs:///a", None, "yarn")) == "hdfs:///a"
    assert shared_folder(fake(None, "hdfs:///b", "yarn")) == "hdfs:///b"
    with pytest.raises(ValueError):
        shared_folder(fake(None, None, "spark://x:7077"))


def test_hint_for_an_index_in_the_working_copy(tmp_path):
    from quern.config import ignore_hint

    root, store = str(tmp_path), str(tmp_path / ".quern" / "index")
    assert ignore_hint(root, store) is None  # no working copy
    (tmp_path / ".git").mkdir()
    assert ignore_hint(root, store) == ".quern/" and ignore_hint(root, "/elsewhere/x") is None
    for line in (".quern", "/.quern/", ".quern/index"):
        (tmp_path / ".gitignore").write_text(f"*.log\n{line}\n")
        assert ignore_hint(root, "file://" + store) is None
