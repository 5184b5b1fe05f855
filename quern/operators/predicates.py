"""Search filters as Columns. Nothing is ever put into SQL text.

``compat`` gives the id-pattern predicates (LIKE over normalised ids, ``_`` a wildcard) that existing callers may rely
on; the default compares file paths with their separators and pushes down to Parquet.
"""

from __future__ import annotations

import os
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.errors import InvalidFilter, PathOutsideRoot
from quern.operators.languages import LANGUAGES

LIMIT = 500
_SAFE = re.compile(r"[A-Za-z0-9_\-%]+")
_PLAIN = {"tsx": "typescript", "jsx": "javascript"}
#: Language by extension, for patterns of the form *.ext.
PATTERN_LANGUAGES = {e[1:]: _PLAIN.get(k, k) for k in ("typescript", "tsx", "javascript", "jsx", "python", "go", "rust") for e in LANGUAGES[k]["extensions"]}
#: Spellings of a language in the data: fallback rows carry the bare extension.
ALIASES = {"typescript": ("typescript", "ts", "tsx"), "javascript": ("javascript", "js", "jsx", "mjs", "cjs"), "python": ("python", "py", "pyw"), "go": ("go",), "rust": ("rust", "rs"), "c": ("c", "h")}


def checked(pattern: str) -> str:
    """The pattern, if it is not empty, not too long and has only letters, digits, ``_``, ``-`` and ``%``."""
    if not pattern or len(pattern) > LIMIT or not _SAFE.fullmatch(pattern):
        raise InvalidFilter("filter is empty, too long or has characters that are not allowed", pattern=pattern[:100])
    return pattern


def path_pattern(path: str) -> str:
    return checked(re.sub(r"[^A-Za-z0-9_-]", "_", path))


def glob_pattern(glob: str) -> str:
    return checked("".join("%" if p in ("**", "*") else "_" if not re.fullmatch(r"[A-Za-z0-9_-]+", p) else p for p in re.findall(r"\*\*|\*|[A-Za-z0-9_-]+|.", glob, re.S)))


def language_is(language: str, compat: bool = False) -> Column:
    if not re.fullmatch("[a-z]+", language):
        raise InvalidFilter("a language has lower-case letters only", language=language[:100])
    names = (language,) if compat else ALIASES.get(language, (language,))
    return F.col("language") == names[0] if len(names) == 1 else F.col("language").isin(*names)


def under_path(path: str, compat: bool = False) -> Column:
    """Rows of a file or folder."""
    if compat:
        return F.col("id").like(path_pattern(path) + "%")
    path_pattern(path)
    p = path.rstrip("/")
    return (F.col("file_path") == p) | F.col("file_path").startswith(p + "/")


def glob_regex(glob: str) -> str:
    """Regular expression of a glob over whole paths; a glob without ``/`` matches the file name."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif glob[i] == "*":
            out.append("[^/]*")
            i += 1
        elif glob[i] == "?":
            out.append("[^/]")
            i += 1
        else:
            out.append(re.escape(glob[i]))
            i += 1
    return ("^" if glob.startswith(("/", "**")) else "(?:^|/)") + "".join(out) + "$"


def matches_glob(glob: str, compat: bool = False) -> Column:
    simple = re.fullmatch(r"\*\.([A-Za-z0-9]+)", glob)
    if compat:
        if simple:
            lang = PATTERN_LANGUAGES.get(simple[1].lower())
            return language_is(lang, True) if lang else F.lit(True)
        return F.col("id").like("%" + glob_pattern(glob))
    glob_pattern(glob)
    if simple:
        return F.col("file_path").endswith("." + simple[1])
    return F.col("file_path").rlike(glob_regex(glob))


def search_filter(path: str | None = None, file_pattern: str | None = None, compat: bool = False) -> Column:
    """Conjunction of the given parts; true without any."""
    parts = [under_path(path, compat)] if path else []
    if file_pattern:
        parts.append(matches_glob(file_pattern, compat))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def within_root(root: str, path: str, fold: bool | None = None) -> str:
    """Absolute form of ``path`` below ``root``, or an error. ``fold``: whether case counts not, as on Windows."""
    fold = os.name == "nt" if fold is None else fold
    same = (lambda x: x.casefold()) if fold else (lambda x: x)
    r = os.path.realpath(root)
    p = os.path.realpath(os.path.join(r, path))
    if same(p) != same(r) and not same(p).startswith(same(r.rstrip(os.sep) + os.sep)):
        raise PathOutsideRoot("path leaves the root", path=path)
    return p


def edge_kinds(kinds) -> Column:
    """Edges of the given kinds; all if none are given."""
    return F.col("edge_type").isin(*kinds) if kinds else F.lit(True)
