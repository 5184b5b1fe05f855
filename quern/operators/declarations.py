"""Declarations of a file by the bundled grammars, with what they call, extend and export.

A file's tokens are read once, with brackets matched as far as they can be. Wherever a statement can begin, GLL tries the
headers of functions and of the other declarations of the language; what parses is a unit, and the search goes on behind it.
What does not parse is entered: declarations within namespaces, calls, conditions and objects are found, those within units
are part of them. Broken places cost the declaration that they are in and no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from quern.grammars.tokens import CLOSE, Tokens, angles, header, parse_header, rule_of, statement_end

WITH_GRAMMAR = ("typescript", "javascript", "go", "rust", "c")
_JS = ("class_declaration", "interface_declaration", "enum_declaration", "type_alias_declaration")
_RUST = ("struct_item", "enum_item", "trait_item", "impl_item", "mod_item")
_WORDS = frozenset("if for while switch catch function return typeof await super constructor of in new do else case throw delete void yield import".split())


class Declaration(NamedTuple):
    kind: str
    name: str | None
    first: int  # tokens
    last: int


def _function(tk: Tokens, i: int):
    """(terminals, name, last token of the header) of a function header at token ``i``."""
    h = header(tk, i)
    at = h and parse_header(tk.lang, h[0])
    if at is None:
        return None
    return h[0], tk.texts[h[1][at]] if at >= 0 else None, h[1][-1]


def _block_end(tk: Tokens, j: int) -> int:
    """Last token of the block that token ``j`` opens."""
    return tk.shut.get(j, len(tk.texts) - 1)


def _body(tk: Tokens, j: int) -> int:
    """Last token of the body of a function whose header ends with token ``j``."""
    if tk.texts[j] == "=>":
        return _block_end(tk, j + 1) if tk.texts[j + 1 : j + 2] == ["{"] else statement_end(tk, min(j + 1, len(tk.texts) - 1))
    return _block_end(tk, j)


def _other(tk: Tokens, i: int, grammar: str, rules: tuple[str, ...]) -> Declaration | None:
    h = header(tk, i, grammar)
    r = h and rule_of(grammar, h[0], rules)
    if not r:
        return None
    j = h[1][-1]
    last = _block_end(tk, j) if h[0][-1] == "BODY" else j if h[0][-1] == "STOP" else statement_end(tk, j)
    return Declaration(r[0], tk.texts[h[1][r[1]]] if r[1] >= 0 else None, i, last)


def _script(tk: Tokens, i: int) -> Declaration | None:
    texts, n = tk.texts, len(tk.texts)
    t = texts[i]
    if t == "export":
        j = i + 1
        while j < n and texts[j] in ("default", "declare"):
            j += 1
        inner = _script(tk, j) if j < n and texts[j] != "export" else None
        if inner and inner.kind != "method_definition":
            last = inner.last
            return Declaration("export_statement", inner.name, i, last + 1 if texts[last + 1 : last + 2] == [";"] else last)
        return Declaration("export_statement", None, i, statement_end(tk, i))
    if t in ("const", "let", "var") and texts[i + 1 : i + 2] != ["enum"]:
        name = texts[i + 1] if i + 1 < n and (texts[i + 1][0].isalpha() or texts[i + 1][0] in "_$") else None
        return Declaration("variable_declaration" if t == "var" else "lexical_declaration", name, i, statement_end(tk, i))
    d = _other(tk, i, "declarations_js", _JS)
    if d:
        return d
    f = _function(tk, i)
    if f and ("function" in f[0] or texts[f[2]] == "{"):
        kind = "function_declaration" if "function" in f[0] else "method_definition"
        return Declaration(kind, f[1], i, _body(tk, f[2]))
    return None


def _go(tk: Tokens, i: int) -> Declaration | None:
    if tk.texts[i] == "type":
        return Declaration("type_declaration", None, i, statement_end(tk, i))
    f = _function(tk, i)
    return f and Declaration("method_declaration" if f[0][1] == "PARENS" and f[0].count("PARENS") > 1 and f[0][2] == "ID" else "function_declaration", f[1], i, _body(tk, f[2]))


def _rust(tk: Tokens, i: int) -> Declaration | None:
    f = _function(tk, i)
    if f:
        return Declaration("function_item", f[1], i, _body(tk, f[2]))
    return _other(tk, i, "declarations_rust", _RUST)


def _c(tk: Tokens, i: int, outside: bool) -> Declaration | None:
    texts = tk.texts
    if texts[i] == "typedef":
        return _c(tk, i + 1, False) if i + 1 < len(texts) else None
    f = _function(tk, i)
    if f:
        return Declaration("function_definition", f[1], i, _body(tk, f[2]))
    if texts[i] in ("struct", "enum"):
        name = texts[i + 1] if i + 1 < len(texts) and texts[i + 1][0].isidentifier() else None
        j = i + 1 + (name is not None)
        if texts[j : j + 1] == ["{"]:
            last = _block_end(tk, j)
            if texts[last + 1 : last + 2] in ([";"], []) or not outside:
                return Declaration(f"{texts[i]}_specifier", name, i, last + 1 if outside and texts[last + 1 : last + 2] == [";"] else last)
    if outside and texts[i][0].isidentifier():
        last = statement_end(tk, i)
        if last > i + 1 and texts[last] == ";":
            return Declaration("declaration", None, i, last)
    return None


def declarations(tk: Tokens) -> Iterator[Declaration]:
    """The outermost declarations in the order of the text."""
    n, i, within = len(tk.texts), 0, -1
    while i < n:
        if tk.fresh[i] or i == 0:
            if tk.base == "c":
                d = _c(tk, i, i > within)
            else:
                d = {"javascript": _script, "go": _go, "rust": _rust}[tk.base](tk, i)
            if d:
                yield d
                i = max(d.last, i) + 1
                continue
        if tk.texts[i] in CLOSE:
            within = max(within, _block_end(tk, i))
        i += 1


def script_edges(tk: Tokens, d: Declaration) -> list[tuple[str, str, str | None]]:
    """(symbol, kind, module) of the calls, parents and exports within a declaration of a script."""
    texts = tk.texts
    out: list[tuple[str, str, str | None]] = []
    for i in range(d.first, d.last + 1):
        t = texts[i]
        before = texts[i - 1] if i > d.first else ""
        if t == "class" and before not in (".", "?."):
            kind, j = None, i + 1
            while j <= d.last and texts[j] != "{":
                if texts[j] in ("extends", "implements"):
                    kind = texts[j]
                elif kind and (texts[j][0].isalpha() or texts[j][0] in "_$") and texts[j - 1] not in (".", "?."):
                    out.append((texts[j], kind, None))
                j = _block_end(tk, j) + 1 if texts[j] in ("(", "[") else j + 1
        if not (t[0].isalpha() or t[0] in "_$") or t[-1] in "\"'`" or (t in _WORDS and before not in (".", "?.")):
            continue
        j = i + 1
        if texts[j : j + 1] == ["?."]:
            j += 1
        if texts[j : j + 1] == ["<"] and tk.lang == "typescript":
            shut = angles(tk, j)
            j = shut + 1 if shut is not None and shut <= d.last else j
        if texts[j : j + 1] != ["("] or _made(tk, i, d.first) or before in ("function", "*") and "function" in texts[max(d.first, i - 2) : i]:
            continue
        shut = tk.shut.get(j)
        if shut is not None and _is_method(tk, i, shut):
            continue
        out.append((t, "calls", None))
    if d.kind == "export_statement":
        name = d.name or (texts[d.first + 2] if texts[d.first + 1 : d.first + 2] == ["default"] and d.last > d.first + 1 and (texts[d.first + 2][0].isalpha() or texts[d.first + 2][0] in "_$") and texts[d.first + 2] not in _WORDS and texts[d.first + 2] not in ("class", "async", "abstract") else None)
        if name:
            out.append((name, "exports", None))
    return out


def _made(tk: Tokens, i: int, first: int) -> bool:
    """Whether the name at ``i`` is what a ``new`` makes."""
    while i - 2 >= first and tk.texts[i - 1] in (".", "?."):
        i -= 2
    return i > first and tk.texts[i - 1] == "new"


def _is_method(tk: Tokens, i: int, shut: int) -> bool:
    """Whether a name with parameters up to ``shut`` is declared here: a block follows, maybe behind a type, where a member can begin."""
    texts, n = tk.texts, len(tk.texts)
    if texts[shut + 1 : shut + 2] not in (["{"], [":"]):
        return False
    k = i
    while k > 0 and texts[k - 1] in ("async", "static", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "*", "#"):
        k -= 1
    if k > 0 and not tk.fresh[k] and texts[k - 1] not in "{};,":
        return False
    j = shut + 1
    if texts[j] == ":":
        j += 1
        while j < n and texts[j] not in "{};,=)":
            j = _block_end(tk, j) + 1 if texts[j] in ("(", "[") else j + 1
    return texts[j : j + 1] == ["{"]


def units(lang: str, text: str) -> list[tuple[tuple, list[tuple]]]:
    """((node type, name, first line, last line, text, comment before it), edges) of the declarations of a file."""
    tk = Tokens(lang, text, 0)
    out = []
    line, at = 1, 0
    for d in declarations(tk):
        a, b = tk.starts[d.first], tk.ends[d.last]
        line += text.count("\n", at, a)
        at = a
        own = tk.comments.get(d.first)
        doc = text[own[-1][0] : own[-1][1]].rstrip() if own else None
        edges = script_edges(tk, d) if tk.base == "javascript" else []
        out.append(((d.kind, d.name, line, line + text.count("\n", a, b), text[a:b], doc), edges))
    return out
