"""Engine settings. Values outside their range fall back to the default, as do unknown edge kinds."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from quern.schemas import EDGE_TYPES


def _int(v: str | None, default: int, low: int, high: int | None = None) -> int:
    try:
        n = int(v) if v is not None else default
    except ValueError:
        return default
    return n if n >= low and (high is None or n <= high) else default


@dataclass(frozen=True)
class GraphConfig:
    enabled: bool = False
    max_depth: int = 2
    session_ttl_s: int = 3600
    edge_kinds: tuple[str, ...] = ()  # empty: all

    @staticmethod
    def load(env: Mapping[str, str] | None = None) -> GraphConfig:
        env = os.environ if env is None else env
        kinds = tuple(k for k in (x.strip() for x in env.get("QUERN_EDGE_KINDS", "").split(",")) if k in EDGE_TYPES)
        return GraphConfig(
            env.get("QUERN_GRAPH", "").strip().lower() in ("1", "true"),
            _int(env.get("QUERN_GRAPH_DEPTH"), 2, 1, 5),
            _int(env.get("QUERN_SESSION_TTL"), 3600, 1),
            kinds,
        )


@dataclass(frozen=True)
class IndexConfig:
    """Limits of ingest and search."""

    root: str = "."
    max_file_bytes: int = 1 << 20
    dimension: int = 64
    graph: GraphConfig = field(default_factory=GraphConfig)
    compat: bool = False

    @staticmethod
    def load(root: str | None = None, env: Mapping[str, str] | None = None) -> IndexConfig:
        env = os.environ if env is None else env
        return IndexConfig(os.path.abspath(root or env.get("QUERN_ROOT") or os.getcwd()), graph=GraphConfig.load(env))


def ignore_hint(root: str, store: str) -> str | None:
    """What to add to ``.gitignore`` if the store lies in the working copy that is indexed and is not ignored there."""
    root, store = os.path.realpath(root), os.path.realpath(store.removeprefix("file://"))
    if not os.path.isdir(os.path.join(root, ".git")) or not store.startswith(root + os.sep):
        return None
    parts = os.path.relpath(store, root).split(os.sep)
    above = {"/".join(parts[:n]) for n in range(1, len(parts) + 1)} | set(parts)
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8", errors="replace") as f:
            lines = {x.strip().strip("/") for x in f}
    except OSError:
        lines = set()
    return None if lines & above else parts[0] + "/"
