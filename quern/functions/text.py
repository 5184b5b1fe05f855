"""Text, path and id expressions. All are Catalyst expressions over Columns; nothing here runs in Python per row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_LIMIT = 500
_ID = re.compile(r"[A-Za-z0-9_-]+")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def keywords(query: str) -> list[str]:
    """Lower-case words of a query in order, duplicates kept."""
    return query.lower().split()


def keywords_column(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def non_blank_lines(c: Column) -> Column:
    return F.size(F.filter(lines(c), lambda x: F.regexp_replace(x, r"\s+", "") != ""))


def normalised_path(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9_-]", "_")


def chunk_id(path: Column, start_line: Column) -> Column:
    return F.concat(normalised_path(path), F.lit("_L"), start_line.cast("string"))


def chunk_uid(path: Column, start_line: Column, content: Column) -> Column:
    """Key that, unlike the id, does not collide for paths that differ only in special characters."""
    return F.sha2(F.concat_ws("\x00", path, start_line.cast("string"), content), 256)


def valid_id(c: Column) -> Column:
    return c.isNotNull() & c.rlike("^[A-Za-z0-9_-]+$") & (F.length(c) <= ID_LIMIT)


def is_valid_id(s: str) -> bool:
    return bool(_ID.fullmatch(s)) and len(s) <= ID_LIMIT


def extension(c: Column) -> Column:
    """Lower-case extension with its dot, empty if there is none; a leading dot of a name starts no extension."""
    return F.lower(F.regexp_extract(c, r"[^/\\](\.[^./\\]*)$", 1))


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]*)[/\\]*$", 1)


def forward(c: Column) -> Column:
    return F.translate(c, "\\", "/")


def relative_to(c: Column, root: str) -> Column:
    r = root.rstrip("/") + "/"
    return F.when(c.startswith(r), F.substring(c, len(r) + 1, 1 << 30)).otherwise(c)


def without_bom(c: Column) -> Column:
    return F.regexp_replace(c, "^﻿", "")


def content_hash(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def token_estimate(c: Column, limit: int = 32768) -> Column:
    return F.ceil(F.length(F.left(c, F.lit(limit))) / 4)


def round2(c: Column) -> Column:
    """Two decimals, half up."""
    return F.floor(c * 100 + 0.5) / 100
