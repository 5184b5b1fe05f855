"""Semantic chunks and symbol edges of source files.

Python files are parsed with the standard ``ast`` module, TypeScript, JavaScript, Go, Rust and C with the bundled grammars
(:mod:`quern.operators.declarations`). TSX, JSX, Java, C# and C++ are read by a scanner that knows strings, comments and
brackets and cuts a file into its top-level declarations; it is approximate where a declaration depends on more than its
first words. A file in an unknown language, one without a declaration of two lines and fifty
characters, and one that fails falls back to line windows and gives no edges. Files are independent: a failure is a
row's, not the job's. Chunks over the size limit are split by :func:`quern.operators.chunking.split_large`.
"""

from __future__ import annotations

import ast
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import chunk_id
from quern.operators import chunking, declarations
from quern.operators.languages import LANGUAGES, WITH_EDGES, by_extension

Unit = tuple  # (node_type, name, first line, last line, text, docstring)
Edge = tuple  # (target_symbol, edge_type, module_path)

_TOKEN = re.compile(
    r"(?P<skip>//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`)|(?P<open>[({\[])|(?P<shut>[)}\]])|(?P<end>;)|(?P<word>[^\W\d][\w$]*)|(?P<nl>\n)|(?P<other>[^\s\w])"
)
_DIRECTIVE = re.compile(r"(?m)^[ \t]*#[^\n]*")


_OPEN_END = frozenset("= => , + - * / | & ? : . < > ( [ {".split()) | {"&&", "||"}
_GOES_ON = re.compile(r"\s*(?:[.?:=|&+\-*,({]|/(?![/*])|extends\b|implements\b|else\b|catch\b|finally\b|instanceof\b|in\b)")


def _statements(text: str, by_line: bool, comments: dict[int, int]) -> Iterator[tuple[int, int, list[str], bool]]:
    """(start, end, first words and marks, has a braced body) of the top-level statements of a bracketed language.

    ``by_line``: a line end closes a statement that cannot go on, as in languages without needed semicolons.
    ``comments`` gets the start of every comment so far by its end.
    """
    depth, start, words, body, assigned, last = 0, -1, [], False, False, ""
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "nl":
            if by_line and depth == 0 and start >= 0 and last not in _OPEN_END and not _GOES_ON.match(text, m.end()):
                yield start, m.start(), words, body
                start, words, body, assigned = -1, [], False, False
            continue
        if kind != "skip" or m[0][0] != "/":
            last = m[0]
        if kind == "skip":
            if m[0][0] == "/":
                comments[m.start() + len(m[0].rstrip())] = m.start()
            if start >= 0 and depth == 0 and m[0][0] not in "/":
                words.append("''")
            continue
        if start < 0:
            if kind in ("shut", "end"):
                continue
            start = m.start()
        if kind == "open":
            depth += 1
            if depth == 1:
                words.append(m[0])
                body |= m[0] == "{"
        elif kind == "shut":
            depth = max(0, depth - 1)
            if depth == 0 and m[0] == "}" and not assigned:
                tail = re.compile(r"[ \t]*;").match(text, m.end())
                yield start, tail.end() if tail else m.end(), words, True
                start, words, body, assigned = -1, [], False, False
        elif kind == "end":
            if depth == 0:
                yield start, m.end(), words, body
                start, words, body, assigned = -1, [], False, False
        elif depth == 0:
            words.append(m[0])
            assigned |= m[0] == "=" and (len(words) < 2 or words[-2] not in "=!<>")
    if start >= 0:
        yield start, len(text.rstrip()), words, body


def _after(words: list[str], *keys: str) -> str | None:
    for k in keys:
        if k in words:
            i = words.index(k) + 1
            while i < len(words) and words[i] in ("*", "mut", "["):
                i += 1
            if i < len(words) and words[i][0].isidentifier():
                return words[i]
    return None


def _classify(lang: str, words: list[str], body: bool) -> tuple[str, str | None] | None:
    """(node type, name) of a statement, or None."""
    head = [w for w in words if w not in ("async", "declare", "abstract", "default", "pub", "unsafe", "static", "inline", "public", "private", "protected", "internal", "sealed", "final", "partial", "virtual", "override", "readonly")]
    first = head[0] if head else ""
    before_paren = head[head.index("(") - 1] if "(" in head and head.index("(") > 0 else None
    if lang in ("typescript", "tsx", "javascript", "jsx"):
        if first == "export":
            return "export_statement", _after(head, "function", "class", "const", "let", "var", "interface", "type", "enum")
        table = {"function": "function_declaration", "class": "class_declaration", "interface": "interface_declaration", "type": "type_alias_declaration", "enum": "enum_declaration", "const": "lexical_declaration", "let": "lexical_declaration", "var": "variable_declaration"}
        if first == "const" and len(head) > 1 and head[1] == "enum":
            return "enum_declaration", _after(head, "enum")
        return (table[first], _after(head, first)) if first in table else None
    if lang == "go":
        if first == "func":
            return ("method_declaration", head[head.index("(", 2) - 1] if head.count("(") > 1 and head.index("(") == 1 else before_paren) if len(head) > 1 and head[1] == "(" else ("function_declaration", _after(head, "func"))
        return ("type_declaration", None) if first == "type" else None
    if lang == "rust":
        head = [w for w in head if w not in ("crate", "extern", "''", "const")] if "fn" in head else head
        while head and head[0] in ("#", "[", "(", "!"):
            head = head[1:]
        first = head[0] if head else ""
        table = {"fn": "function_item", "impl": "impl_item", "struct": "struct_item", "enum": "enum_item", "trait": "trait_item", "mod": "mod_item"}
        return (table[first], _after(head, first)) if first in table else None
    if lang in ("java", "csharp"):
        for k in ("namespace", "class", "interface", "enum", "record", "struct"):
            if k in head and body and (k != "namespace" or lang == "csharp") and (k != "struct" or lang == "csharp") and (k != "record" or lang == "java"):
                return f"{k}_declaration", _after(head, k)
        if before_paren and body:
            kind = "constructor_declaration" if head.index("(") == 1 else "method_declaration"
            return kind, before_paren
        return ("property_declaration", head[head.index("{") - 1]) if lang == "csharp" and "{" in head and head.index("{") > 1 else None
    if lang == "cpp":
        for k, t in (("template", "template_declaration"), ("namespace", "namespace_definition")):
            if first == k:
                return t, _after(head, k) if k == "namespace" else _after(head, "class", "struct")
    if lang in ("c", "cpp"):
        if before_paren and body and "=" not in head:
            return "function_definition", before_paren
        for k, t in (("class", "class_specifier"), ("struct", "struct_specifier"), ("enum", "enum_specifier")):
            if first == k and body and (k != "class" or lang == "cpp") and (k != "enum" or lang == "c"):
                return t, _after(head, k)
        return ("declaration", None) if lang == "c" and first and first != "#" and len(head) > 1 else None
    return None


def _line_offsets(text: str) -> list[int]:
    out = [0]
    out += [m.end() for m in re.finditer("\n", text)]
    return out


def _line_at(offsets: list[int], pos: int) -> int:
    import bisect

    return bisect.bisect_right(offsets, pos)


def scan_units(lang: str, text: str) -> list[Unit]:
    offsets = _line_offsets(text)
    out = []
    code = _DIRECTIVE.sub(lambda m: " " * len(m[0]), text) if lang in ("c", "cpp") else text
    comments: dict[int, int] = {}
    for a, b, words, body in _statements(code, lang in ("go", "typescript", "tsx", "javascript", "jsx"), comments):
        kind = _classify(lang, words, body)
        if kind and kind[0] in LANGUAGES[lang]["types"]:
            e = a
            while e and text[e - 1].isspace():
                e -= 1
            doc = text[comments[e] : e] if e in comments else None
            out.append((kind[0], kind[1], _line_at(offsets, a), _line_at(offsets, max(a, b - 1)), text[a:b], doc))
    return out


def python_units(text: str) -> list[tuple[Unit, ast.AST]]:
    """Functions and classes outside other functions and classes, with their trees."""
    lines = text.split("\n")
    out = []

    def visit(node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            if not isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                visit(child)
                continue
            first = min([child.lineno, *[d.lineno for d in child.decorator_list]])
            kind = "class_definition" if isinstance(child, ast.ClassDef) else "function_definition"
            doc = None
            above = first - 2
            while above >= 0 and not lines[above].strip():
                above -= 1
            if above >= 0 and lines[above].lstrip().startswith("#") and len(lines[above]) - len(lines[above].lstrip()) == child.col_offset:
                doc = lines[above].strip()
            elif not child.decorator_list:
                e = next((s for s in child.body if isinstance(s, ast.Expr)), None)
                if e is not None and isinstance(e.value, ast.Constant) and isinstance(e.value.value, str):
                    doc = ast.get_source_segment(text, e.value)
            body = lines[first - 1 : child.end_lineno]
            source = "\n".join([body[0][child.col_offset :], *body[1:]])
            decorated = bool(child.decorator_list)
            out.append((("decorated_definition" if decorated else kind, None if decorated else child.name, first, child.end_lineno, source, doc), child))

    visit(ast.parse(text))
    return out


def python_edges(tree: ast.AST) -> list[Edge]:
    """Calls (of an attribute of a plain name, that name), imports, and every name in a list of arguments or bases as a parent."""
    out: list[Edge] = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Call):
            f = n.func
            if isinstance(f, ast.Name):
                out.append((f.id, "calls", None))
            elif isinstance(f, ast.Attribute):
                out.append((f.value.id if isinstance(f.value, ast.Name) else f.attr, "calls", None))
        if isinstance(n, ast.Import):
            out += [(a.name.split(".")[-1], "imports", a.name) for a in n.names if not a.asname]
        if isinstance(n, ast.ImportFrom):
            module = n.module if n.module and not n.level else n.names[0].name
            out.append((module, "imports", module))
        lists = [*n.args, *n.keywords] if isinstance(n, ast.Call) else [*n.bases, *n.keywords] if isinstance(n, ast.ClassDef) else []
        for part in lists:
            if isinstance(part, ast.keyword) and part.arg:
                out.append((part.arg, "extends", None))
            for x in ast.walk(part):
                if isinstance(x, ast.Name):
                    out.append((x.id, "extends", None))
                elif isinstance(x, ast.Attribute):
                    out.append((x.attr, "extends", None))
    return out


_CALL = re.compile(r"(?<![\w$])(?P<new>new\s+)?(?:[\w$]+(?:\?)?\.\s*)*(?P<name>[A-Za-z_$][\w$]*)\s*\(")
_NOT_CALLED = frozenset("if for while switch catch function return typeof await super constructor of in".split())
_STRINGS = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")


def script_edges(node_type: str, text: str) -> list[Edge]:
    """Calls, imports, heritage and exports of a JavaScript or TypeScript chunk."""
    out: list[Edge] = []
    code = _STRINGS.sub(lambda m: "''" if m[0][0] in "\"'" else " ", text)
    for m in _CALL.finditer(code):
        before = code[: m.start()].rstrip()
        declared = before.endswith("function") or re.search(r"\)\s*(?::[^{;]*)?\s*$", code[m.end() : m.end()]) is not None
        method = re.compile(r"[^()]*\)\s*(?::[^{};]*)?\{").match(code, m.end()) and not before.endswith(("=", "return", "(", ",", "=>", "?", ":", "&&", "||", "!"))
        if not m["new"] and m["name"] not in _NOT_CALLED and not declared and not method:
            out.append((m["name"], "calls", None))
    for m in re.finditer(r"^\s*import\s+(?:type\s+)?([^;'\"]*?)\s*(?:from\s*)?['\"]([^'\"]+)['\"]", text, re.M):
        clause, module = m[1], m[2]
        named = re.search(r"\{([^}]*)\}", clause)
        names = [x.strip().split(" as ")[0].strip() for x in named[1].split(",") if x.strip()] if named else []
        default = re.match(r"[A-Za-z_$][\w$]*", clause)
        names += [default[0]] if default else []
        out += [(x, "imports", module) for x in names] or [(module.split("/")[-1], "imports", module)]
    for m in re.finditer(r"\bclass\b[^{]*", code):
        for part, kind in re.findall(r"\b(?:extends)\b([^{]*?)(?=\bimplements\b|$)|\bimplements\b([^{]*)", m[0]):
            for names, edge in ((part, "extends"), (kind, "implements")):
                out += [(x, edge, None) for x in re.findall(r"[A-Za-z_$][\w$]*", names)]
    if node_type == "export_statement":
        m = re.match(r"export\s+(?:default\s+)?(?:async\s+)?(?:function\s*\*?|class|const|let|var)?\s*([A-Za-z_$][\w$]*)", text)
        if m:
            out.append((m[1], "exports", None))
    return out


def small(text: str) -> bool:
    return len(text) < chunking.MIN_CHARS or sum(bool(x.strip()) for x in text.split("\n")) < chunking.MIN_LINES


def units(path: str, text: str) -> tuple[str | None, list[tuple[Unit, list[Edge]]]]:
    """(language, units with their edges) of a file; no units: it has to fall back."""
    lang = by_extension(os.path.splitext(path)[1])
    if lang is None:
        return None, []
    if lang == "python":
        found = [(u, python_edges(tree)) for u, tree in python_units(text)]
    elif lang in declarations.WITH_GRAMMAR:
        found = [x for x in declarations.units(lang, text) if x[0][0] in LANGUAGES[lang]["types"]]
    else:
        found = [(u, script_edges(u[0], u[4]) if lang in WITH_EDGES else [(u[1], "exports", None)] if u[0] == "export_statement" and u[1] else []) for u in scan_units(lang, text)]
    return {"tsx": "typescript", "jsx": "javascript"}.get(lang, lang), [(u, e) for u, e in found if not small(u[4])]


def put_together(pieces: list[tuple[int, str]]) -> str:
    """The text of a file from its (start_line, content) pieces, each line once and in its place; lines that no piece has are blank.

    If pieces disagree on a line, the piece that starts first wins, then the longer, then the smaller text.
    """
    lines: dict[int, str] = {}
    for start, content in sorted(pieces, key=lambda p: (p[0], -len(p[1]), p[1])):
        for i, line in enumerate(content.lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n").split("\n"), start):
            lines.setdefault(i, line)
    return "\n".join([lines.get(i, "") for i in range(min(1, *lines), max(lines) + 1)])


def whole_files(chunks: DataFrame) -> DataFrame:
    """(file_path, content) of every file, put together from all of its chunks; one file is put together in one task."""

    def run(batches):
        for b in batches:
            texts = [put_together([(p["start"], p["content"]) for p in parts]) for parts in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["file_path", "content"])

    part = F.struct(F.coalesce("start_line", F.lit(1)).alias("start"), F.coalesce("content", F.lit("")).alias("content"))
    parts = chunks.filter("file_path is not null").groupBy("file_path").agg(F.collect_set(part).alias("parts"))
    return parts.mapInArrow(run, "file_path string, content string")


_UNIT = (
    "file_path string, kind string, content string, start_line int, end_line int, name string, node_type string, docstring string, language string, "
    "source_text string, target_symbol string, edge_type string, module_path string, error string, content_hash string"
)


def parse_files(files: DataFrame) -> DataFrame:
    """One row per unit ('unit'), raw edge ('edge', keyed by the unit's start line) and file to fall back on ('fallback'). Each
    has the content_hash that came with the content, if any did."""

    def run(batches):
        for b in batches:
            rows = []
            for path, text, digest in zip(*(b.column(c).to_pylist() for c in range(3))):
                text = (text or "").removeprefix("﻿")
                error = None
                try:
                    lang, found = units(path, text)
                except (SyntaxError, ValueError, RecursionError) as e:
                    lang, found, error = None, [], f"{type(e).__name__}: {e}"[:200]
                if not found:
                    rows.append((path, "fallback", text, None, None, None, None, None, os.path.splitext(path)[1][1:] or "unknown", None, None, None, None, error, digest))
                src = text.split("\n") if found else []
                for (kind, name, first, last, body, doc), edges in found:
                    rows.append((path, "unit", body, first, last, name, kind, doc, lang, "\n".join(src[first - 1 : first + 4]), None, None, None, None, digest))
                    rows += [(path, "edge", None, first, None, None, None, None, lang, None, *e, None, digest) for e in edges]
            cols = list(zip(*rows)) if rows else [[]] * 15
            kinds = [pa.int32() if i in (3, 4) else pa.string() for i in range(15)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in _UNIT.split(", ")])

    digest = F.col("content_hash") if "content_hash" in files.columns else F.lit(None).cast("string")
    return files.select("file_path", "content", digest.alias("content_hash")).filter("file_path is not null").mapInArrow(run, _UNIT)


def chunk_files(parsed: DataFrame) -> DataFrame:
    """Chunks of parsed files: units, split where large, and line windows of the files that fall back."""
    u = parsed.filter("kind = 'unit'").select(
        chunk_id(F.col("file_path"), F.col("start_line")).alias("id"), "file_path", "content", "start_line", "end_line", "name", "node_type",
        chunking.signature(F.col("source_text")).alias("signature"), "docstring", "language", "content_hash",
    )
    null = F.lit(None).cast("string")
    w = chunking.line_windows(parsed.filter("kind = 'fallback'"), keep=("language", "content_hash"))
    w = w.select("id", "file_path", "content", "start_line", "end_line", null.alias("name"), F.lit("fallback_chunk").alias("node_type"), null.alias("signature"), null.alias("docstring"), "language", "content_hash")
    return chunking.split_large(u).unionByName(w.withColumn("part_no", F.lit(None).cast("int")))


def raw_edges(parsed: DataFrame) -> DataFrame:
    """(source_id, source_path, target_symbol, edge_type, module_path): references of a unit, from its first chunk."""
    e = parsed.filter("kind = 'edge'").select("file_path", "start_line", "target_symbol", "edge_type", "module_path").distinct()
    big = parsed.filter("kind = 'unit'").filter(chunking.too_large(F.col("content"))).select("file_path", "start_line", F.lit("_p0").alias("suffix")).distinct()
    return e.join(big, ["file_path", "start_line"], "left").select(
        F.concat(chunk_id(F.col("file_path"), F.col("start_line")), F.coalesce("suffix", F.lit(""))).alias("source_id"),
        F.col("file_path").alias("source_path"), "target_symbol", "edge_type", "module_path",
    )
