"""Command line: ``python -m quern build|search|context|annotate|summary|sessions|forget|vacuum``."""

from __future__ import annotations

import argparse
import json

from quern import __version__, render


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quern", description="Index source files and search them.")
    p.add_argument("--version", action="version", version=f"quern {__version__}")
    p.add_argument("--root", help="folder to index (else QUERN_ROOT, else the working folder)")
    p.add_argument("--store", required=True, help="folder of the index")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("build").add_argument("--force", action="store_true")
    for name in ("search", "context"):
        q = sub.add_parser(name)
        q.add_argument("query")
        q.add_argument("--limit", type=int, default=10)
        q.add_argument("--path")
        q.add_argument("--pattern")
    n = sub.add_parser("annotate")
    n.add_argument("session")
    n.add_argument("node")
    n.add_argument("--note")
    n.add_argument("--reason")
    n.add_argument("--link", action="append", default=[])
    sub.add_parser("summary").add_argument("session")
    sub.add_parser("sessions")
    sub.add_parser("forget").add_argument("session")
    sub.add_parser("vacuum")
    a = p.parse_args(argv)

    from pyspark.sql import SparkSession

    from quern.config import IndexConfig
    from quern.engine import Engine

    spark = SparkSession.builder.appName("quern").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    e = Engine(spark, a.store, IndexConfig.load(a.root))
    if a.command == "build":
        out, text = e.build(a.force), str
    elif a.command == "search":
        out, text = e.semantic_search(a.query, limit=a.limit, path=a.path, file_pattern=a.pattern), render.search
    elif a.command == "context":
        out, text = e.context_query(a.query, limit=a.limit, path=a.path, file_pattern=a.pattern), render.search
    elif a.command == "annotate":
        out, text = e.graph_annotate(a.session, a.node, a.note, a.link, a.reason), render.annotation
    elif a.command == "sessions":
        out, text = e.sessions(), "\n".join
    elif a.command == "forget":
        out, text = {"deleted": e.delete_session(a.session)}, str
    elif a.command == "vacuum":
        out, text = {"folders": e.vacuum()}, str
    else:
        out, text = e.session_summary(a.session), render.session
    print(json.dumps(out, default=str) if a.json else text(out))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
