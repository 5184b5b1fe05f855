"""Plain-text renderings of results, for people. They take the few rows of a finished result, as dictionaries."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime, timezone


def _short(s: str, n: int) -> str:
    return s if len(s) <= n else s[: n - 3] + "..."


def _hit(i: int, r: Mapping, lines: int) -> list[str]:
    out = [f"{i}. [{r['score'] * 100:.0f}%] {r.get('name') or 'anonymous'} ({r['node_type']})", f"   Location: {r['file']}:{r['start_line']}-{r['end_line']}"]
    if r.get("signature"):
        out.append("   Signature: " + _short(r["signature"], 80))
    return [*out, "   ---", *(f"   {x}" for x in r["content"].split("\n")[:lines])]


def _neighbours(ns: list[Mapping]) -> list[str]:
    if not ns:
        return []
    arrow = {"outgoing": "->"}
    out = [f"   Graph neighbors ({len(ns)}):"]
    out += [f"     {arrow.get(n['direction'], '<-')} {n['edge_type']}: {n.get('symbol_name') or n['id']} ({n['kind']}) in {n['file']}" for n in ns[:5]]
    return [*out, f"     ... and {len(ns) - 5} more"] if len(ns) > 5 else out


def search(out: Mapping) -> str:
    """Results of a search, with graph neighbours where there are any."""
    if not out["results"]:
        return f'No results found for query: "{out["query"]}"'
    graph = out.get("graph_stats") or {}
    more = f" ({graph['total_neighbors']} graph neighbors)" if graph.get("graph_available") else ""
    text = [f'Found {out["total_results"]} results for: "{out["query"]}"{more}', ""]
    for i, r in enumerate(out["results"], 1):
        text += [*_hit(i, r, 5), *_neighbours(r.get("neighbors") or []), ""]
    return "\n".join(text)


def annotation(out: Mapping) -> str:
    text = [f"Annotated node: {out['node_id']}"]
    text += [f"Note: {out['note']}"] if out.get("note") else []
    text += [f"Created {out['links_created']} agent_linked edge(s)"] if out["links_created"] else []
    return "\n".join([*text, f"Session visited nodes: {out['session_visited_count']}"])


def session(out: Mapping) -> str:
    s, g = out["session"], out["graph_stats"]
    text = [
        f"Session: {s['session_id']} (age: {round(s['age_ms'] / 1000)}s)", f"  Visited nodes: {s['visited_count']}", f"  Frontier: {s['frontier_count']}",
        f"  Annotations: {s['annotation_count']}", f"  Reasoning entries: {s['reasoning_count']}", "",
    ]
    if g["graph_available"]:
        text += ["Graph:", f"  Total nodes: {g['total_nodes']}", f"  Total edges: {g['total_edges']}", f"  Stale nodes: {out['stale_node_count']}"]
    else:
        text += ["Graph: not available"]
    if s["top_frontier"]:
        text += ["", "Top frontier nodes:", *(f"  - {f['node_id']} (priority: {f['priority']:.2f})" for f in s["top_frontier"])]
    if s["recent_reasoning"]:
        iso = lambda t: datetime.fromtimestamp(t, timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        text += ["", "Recent reasoning:", *(f"  [{iso(r['ts'])}] {r['text']}" for r in s["recent_reasoning"])]
    return "\n".join(text) + "\n"


def camel(row: Mapping) -> dict:
    """Keys in camel case, values unchanged."""
    return {k.split("_")[0] + "".join(p.title() for p in k.split("_")[1:]): v for k, v in row.items()}


def snake(row: Mapping) -> dict:
    import re

    return {re.sub(r"(?<!^)([A-Z])", lambda m: "_" + m[1].lower(), k): v for k, v in row.items()}


def rows(df) -> Iterable[dict]:
    """Rows of a bounded result as dictionaries."""
    return (r.asDict(recursive=True) for r in df.collect())
