"""Logging set-up: level and text or JSON lines from QUERN_LOG_LEVEL and QUERN_LOG_FORMAT."""

from __future__ import annotations

import json
import logging
import os
import sys


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        out = {"time": self.formatTime(record), "level": record.levelname.lower(), "component": record.name, "message": record.getMessage()}
        if record.exc_info:
            out["error"] = self.formatException(record.exc_info)
        return json.dumps(out | getattr(record, "context", {}), default=str)


def setup(env=None) -> logging.Logger:
    """The engine's logger; children of it (``quern.search``) inherit its level and format."""
    env = os.environ if env is None else env
    log = logging.getLogger("quern")
    level = env.get("QUERN_LOG_LEVEL", "info").upper()
    log.setLevel(level if level in ("DEBUG", "INFO", "WARNING", "WARN", "ERROR") else "INFO")
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(JsonLines() if env.get("QUERN_LOG_FORMAT") == "json" else logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    log.handlers = [handler]
    log.propagate = False
    return log
