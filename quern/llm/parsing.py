"""Source files that do not parse (problem 7).

The chunks of a file are put together by line number, each line once, and the token stream of the file's language is
run to its end through the table-driven recogniser of :mod:`quern.grammars.pda` with the bundled grammar. The first
token at which no parse is left is the file's error; expressions in the holes of Python's format strings are parsed too. JavaScript and TypeScript get their semicolons inserted by the
rule of the language: only before a token that no parse accepts, after a line end, before ``}`` or at the end.

Defined results: the language is that of the path's extension; a path that is null or has another extension is not
judged; null content counts as no lines, a file without any text parses; lines between chunks are not needed; a
leading byte-order mark and line ends of any kind are no faults. If chunks disagree on a line, the chunk that starts
first wins (then the longer, then the smaller text). Repeated rows count once; extra columns are ignored. Whole files
are read. The repository of a file is the one with the longest root path that starts its path before a ``/``.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.grammars import lexers, pda
from quern.llm.blocks import per_block

_loaded: dict[str, tuple] = {}


def _tools(lang: str):
    if lang not in _loaded:
        g = pda.bundled(*lexers.GRAMMARS[lang])
        _loaded[lang] = (pda.Recogniser(g, {}), lexers.kinds_of(lang, g.terminals))
    return _loaded[lang]


def assemble(chunks: list[tuple[int, str]]) -> str:
    """One text of (start_line, content) pieces, each line once."""
    lines: dict[int, str] = {}
    put = lines.setdefault
    for start, content in sorted(chunks, key=lambda c: (c[0], -len(c[1]), c[1])):
        for i, line in enumerate(content.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n").split("\n"), start):
            put(i, line)
    return "\n".join([lines[i] for i in sorted(lines)])


def first_error(lang: str, text: str) -> tuple[int, str] | None:
    """(line of the text, token) where the text stops being valid, or None."""
    rec, kinds = _tools(lang)
    if len(rec.states) > rec.LIMIT:
        rec.reset()
    toks = lexers.lex(lang, text, kinds)
    d = rec.first
    for t in toks:
        d = d[t]
        if d is None:
            break
    else:
        if rec.accepts_end(d):
            return _format_error(text) if lang == "python" and _FORMAT.search(text) else None
    return _slow_error(lang, text, toks)


_FORMAT = re.compile(r"[fF][rR]?[\"']")


def _format_error(text: str) -> tuple[int, str] | None:
    """The first format string with a hole that does not parse."""
    for t, line in lexers.tokens_with_lines("python", text):
        if t[0] in "fFrR" and t[-1] in "\"'" and not _valid_holes(t):
            return line, t[:80]
    return None


@lru_cache(maxsize=50_000)
def _valid_holes(token: str) -> bool:
    found = lexers.holes(token)
    return found is not None and all(x.strip() and first_error("python", f"({x}\n)\n") is None for x in found)


def _slow_error(lang: str, text: str, toks: list[str]) -> tuple[int, str] | None:
    rec, kinds = _tools(lang)
    script = lang in ("javascript", "typescript")
    if script:
        stream = []
        last_line = 1
        for t, line in lexers.tokens_with_lines(lang, text if not text.startswith("#!") else "//" + text):
            broke = line > last_line
            for part in lexers._open_templates([t], lexers._LEX[lang].findall):
                stream.append((lexers._TEMPLATE[part] if part in lexers._TEMPLATE else kinds[part], line, broke))
                broke = False
            last_line = line + t.count("\n")
    else:
        stream = [(t, 0, False) for t in toks]
    d = rec.first
    before = ""
    for i, (t, line, broke) in enumerate(stream):
        if script and broke and (t in ("++", "--") or before in ("return", "break", "continue", "throw", "yield")) and d[";"] is not None:
            d = d[";"]  # productions that a line end cuts
        before = t
        nxt = d[t] if t else d
        if nxt is None and script and (broke or t == "}"):
            filled = d[";"]
            nxt = filled[t] if filled is not None else None
        if nxt is None:
            return (line or _line_of(lang, text, toks, i), t)
        d = nxt
    if rec.accepts_end(d) or script and d[";"] is not None and rec.accepts_end(d[";"]):
        return None
    return (text.count("\n") + 1, "end of file")


def _line_of(lang: str, text: str, toks: list[str], at: int) -> int:
    """Line of the token that made the terminal ``at``; terminals made of line ends count for the token before."""
    real = sum(1 for t in toks[: at + 1] if t and not (t in ("NL", "INDENT", "DEDENT", "BADDENT") or lang == "go" and t == ";"))
    lines = [n for t, n in lexers.tokens_with_lines(lang, text) if t[0] != "\n" and not (lang == "go" and t == ";")]
    return lines[min(max(real - 1, 0), len(lines) - 1)] if lines else 1


def language_of(path):
    """Language by extension, as a column."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in lexers.EXTENSIONS.items() for x in kv])
    return F.element_at(table, ext)


def files(chunks: DataFrame, *more: str) -> DataFrame:
    """(file_path, lang, parts): the distinct pieces of every file in a known language, combined before the shuffle."""
    lang = language_of(F.col("file_path"))
    return (
        chunks.select("file_path", lang.alias("lang"), F.coalesce("start_line", F.lit(1)).alias("start"), F.coalesce("content", F.lit("")).alias("content"), *more)
        .filter("lang is not null")
        .groupBy("file_path", "lang")
        .agg(F.collect_set(F.struct("start", "content", *more)).alias("parts"))
    )


def check_files(chunks: DataFrame) -> DataFrame:
    """(file_path, lang, ok, error_line, error_token) of every file; the line counts within the text put together."""

    def run(t: pa.Table) -> pa.Table:
        paths, langs = t.column("file_path"), t.column("lang").to_pylist()
        ok, line, token = [], [], []
        for lang, parts in zip(langs, t.column("parts").to_pylist()):
            e = first_error(lang, assemble([(p["start"], p["content"]) for p in parts]))
            ok.append(e is None)
            line.append(e and e[0])
            token.append(e and e[1])
        return pa.table({"file_path": paths, "lang": langs, "ok": ok, "error_line": pa.array(line, pa.int32()), "error_token": pa.array(token, pa.string())})

    return files(chunks).mapInArrow(per_block(run, 16 << 20), "file_path string, lang string, ok boolean, error_line int, error_token string")


def with_repo(df: DataFrame, repos: DataFrame) -> DataFrame:
    """``df`` with repo_id: every prefix of the path that ends before a ``/`` is looked up, the longest root wins."""
    part = F.split("file_path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(part) - 1), lambda n: F.array_join(F.slice(part, 1, n), "/"))
    roots = repos.filter("root_path is not null").groupBy("root_path").agg(F.min("repo_id").alias("repo_id"))
    hit = (
        df.select("file_path").distinct()
        .filter(F.instr("file_path", "/") > 0)
        .select("file_path", F.explode(prefixes).alias("root_path"))
        .join(roots, "root_path")
        .groupBy("file_path")
        .agg(F.max_by("repo_id", F.length("root_path")).alias("repo_id"))
    )
    return df.join(hit, "file_path", "left")


def rates(checked: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo_id, lang, files, invalid, rate)."""
    return (
        with_repo(checked, repos)
        .groupBy("repo_id", "lang")
        .agg(F.count("*").alias("files"), F.count_if(~F.col("ok")).alias("invalid"))
        .withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
    )
