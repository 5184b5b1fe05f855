"""Functions paired with their documentation (problem 3).

A row's text is lexed once, and brackets are matched with recovery: a closing bracket closes the nearest one of its kind and
with it what was left open inside, strays are passed over, and in Python a definition at the start of a line closes what
is open. Wherever a statement can begin, a generalised LL parser with a graph-structured stack tries the bundled function
grammar of the language over the header, its bracketed parts being one token each; the table-driven form of the same grammar
gives up at the first token that no parse has left, so headers of any length are read and other statements cost a token or
two. After a failure the parse goes on at the next place where a statement can begin, so valid functions come out of broken
files, and functions and methods within classes and bodies are found too. If nothing starts the row in the language of the
extension, the others are tried (files with a wrong extension). The body goes through the whole grammar of its language:
``whole`` bodies parse, ``cut`` ones end before their bracket does, ``broken`` ones do not parse. Lines of merge conflicts
and diffs in front of a declaration are skipped. Rows that begin inside a function, types and classes have no function of
their own.

Documentation is looked for in docstring (of the function that the row begins with), in the comments directly before the
function, and in the first string of a Python body. Comment marks, tags, directives, rulers and commented-out code are taken
off; what is left must have at least five words (or eight Chinese or Japanese characters), and some that the function's
name does not have. Texts that, apart from proper names, numbers and the function's own name, stand at ``TEMPLATE`` or more
functions with different names are dropped as templates (licence notices, placeholders) by exact counts of hashes over the
whole corpus; there is no list of such words.

The whole table is read. A function stored in several rows (``_p0``, ``_p1``, ...) is put together by line before it is
parsed, each line once, and comes out whole under the id of its first row; the line windows of a file (``fallback``) are put
together too. Functions found in windows, or in parts whose first row is not there, count for the templates and are among the
pairs under the id of the row that has their first line, with places from 1 on: no row begins with them, so place 0, which
``documented_ids`` reports, never holds a window or a later part.

Defined results: null docstring, name and signature count as absent; null content gives no function; repeated rows
count once; of several rows with one id any that qualifies is enough. Only the docstring and name of a function's first row
are used. A part without start_line follows the part before it. The language is that of the extension, else that of the
language column; where neither is known all languages are tried. Rows without an id are left out, as they cannot be named.
"""

from __future__ import annotations

import re
import textwrap
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.grammars.lexers import EXTENSIONS, GRAMMARS
from quern.grammars.tokens import ORDER, Tokens, body_end, header, parse_header
from quern.llm.blocks import per_block
from quern.llm.common import durable
from quern.llm.parsing import first_error, language_of

TEMPLATE = 5
_JUNK = re.compile(r"(?:(?:<<<<<<<|>>>>>>>|=======|\|\|\|\|\|\|\||[-+ ]?@@|diff |---|\+\+\+)[^\n]*\n|[ \t\r]*\n)+")


class Function(NamedTuple):
    lang: str
    name: str | None
    signature: str
    comments: list[str]
    first: bool  # the row begins with it
    start: int
    body: int  # end of the token that opens the body
    end: int
    cut: bool
    plain: bool  # no method: it may stand alone


def _function(tk: Tokens, i: int) -> tuple[Function, int] | None:
    h = header(tk, i)
    at = h and parse_header(tk.lang, h[0])
    if at is None:
        return None
    kinds, where = h
    begin, body = tk.starts[i], tk.ends[where[-1]]
    end, cut = body_end(tk, i, where[-1])
    plain = tk.base != "javascript" or not {"function", "const", "let", "var"}.isdisjoint(kinds)
    name = tk.texts[where[at]] if at >= 0 else None
    return Function(tk.lang, name, tk.text[begin:body].rstrip("{:").strip(), tk.before(i), i == 0, begin, body, max(end, body), cut, plain), where[-1]


def _begin(text: str) -> tuple[str, int]:
    text = text.lstrip("\ufeff")
    m = _JUNK.match(text)
    return text, m.end() if m else 0


def _own(lang: str, text: str, start: int):
    """(tokens, function, its body token) of the first language in which a function begins the text, else those of ``lang``."""
    own = None
    for k in (lang, *(x for x in ORDER if x != lang and not (x == "typescript" and lang == "javascript"))):
        tk = Tokens(k, text, start)
        own = own or tk
        f = _function(tk, 0)
        if f:
            return tk, *f
    return own, None, 0


def find_function(lang: str, text: str) -> Function | None:
    """The function that the text begins with."""
    return _own(lang, *_begin(text))[1]


def functions_in(lang: str, text: str) -> tuple[str, list[Function]]:
    """The text without its mark, and all functions and methods in it, from the first place on where one parses."""
    text, start = _begin(text)
    tk, f, body = _own(lang, text, start)
    out = [f] if f else []
    for i in range(body + 1 if f else 1, len(tk.texts)):
        if tk.fresh[i] and i > body:
            got = _function(tk, i)
            if got:
                out.append(got[0])
                body = got[1]
    return text, out


def body_state(f: Function, text: str) -> str:
    """``whole``, ``cut`` or ``broken``: the function through the whole grammar of its language."""
    part = text[f.start : f.end]
    if f.lang == "python":
        part = textwrap.dedent(" " * (f.start - (text.rfind("\n", 0, f.start) + 1)) + part)
    elif not f.plain:
        part = f"class _ {{ {part}\n}}"
    if first_error(f.lang, part) is None:
        return "whole"
    return "cut" if f.cut else "broken"


# Marks, tags and directives that are no description.
_MARK = re.compile(r"^\s*(?:/\*+!?|\*+/|\*(?!\*)|//+!?|#+!?|--)?[ \t]?|\s*\*+/\s*$")
_TAG = re.compile(r"^\s*(?:[@\\](?:param|arg|argument|returns?|throws|type|typedef|template|see|since|version|author|deprecated|example|yields?|raises?|exception|private|public|internal|override)\b(?:\s*\{[^}]*\})?(?:\s+\[?[\w$.]*[a-z0-9][A-Z_][\w$.]*\]?(?=\s|$))?(?:\s*[-:])?|:(?:param|type|return|returns|rtype|raises|raise|arg|yields?|ivar|var|cvar)\b[^:\n]*:)\s*")
_DIRECTIVE = re.compile(
    r"^\s*(?:eslint\b|eslint-|prettier-|istanbul\b|nolint|noqa|@ts-|ts-ignore|tslint|jshint|jslint|pylint|flake8|mypy|type:\s*ignore|pragma|clang-format|clang-tidy|NOLINT|rustfmt|clippy|go:|\+build|lint:|isort|fmt:|c8 ignore|v8 ignore|webpack|region\b|endregion\b|@formatter|sourceMappingURL|coverage|yapf|black:|codespell|cspell|spell-checker|vim:|-\*-)",
    re.I,
)
_CJK = re.compile("[぀-ヿ㐀-䶿一-鿿]")
_WORD = re.compile(r"[^\W\d_][\w'’]*")
_PLAIN = re.compile(r"(?<![\w.])[^\W\d_]+(?![\w(\[.]\w|[(\[])")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# Words that say nothing about a function beside its name.
_FILLER = frozenset("this is the a an of for to in on it its that which and or with by function method helper routine procedure func fn def does do will be value given implementation call calls called".split())


_STATEMENT = re.compile(r"^\s*(?:[-+}] ?)?(?:(?:try|else|finally|default)\s*[:{]$|(?:if|for|while|except|elif|with|def|class|case|switch|match|catch|func|fn)\b.*[:{]$|return\b\s*[\w.,() ]*;?$|import [\w.]+;?$)")


def code_like(line: str) -> bool:
    """Whether a line of a comment is code rather than prose: more marks of code than half its plain words."""
    if _STATEMENT.match(line):
        return True
    marks = len(re.findall(r"[=;{}()\[\]<>|&]", line)) + 2 * bool(re.search(r"[;{}]\s*$", line))
    return marks >= 2 and marks * 2 >= len(_PLAIN.findall(line))


def clean(doc: str) -> str:
    """The descriptive lines of a documentation comment."""
    out = []
    body = re.sub(r"^\s*[rRuUbB]{0,2}(\"\"\"|'''|\"|')([\s\S]*)\1\s*$", r"\2", doc.replace("\r", "\n"))
    for line in body.split("\n"):
        line = _MARK.sub("", _MARK.sub("", line)).strip()
        while (m := _TAG.match(line)) and m.end():
            line = line[m.end() :].strip()
        if not line or _DIRECTIVE.match(line) or not re.search(r"\w", line):
            continue
        if code_like(line):
            continue
        out.append(line)
    return "\n".join(out)


def descriptive(text: str, name: str | None) -> bool:
    """Enough words, and some that the name does not have."""
    words = _WORD.findall(text)
    if len(words) < 5 and len(_CJK.findall(text)) < 8:
        return False
    if not _CJK.search(text):
        stems = [p.lower() for p in _PARTS.findall(name or "")]
        own = {s + e for s in stems for e in ("", "s", "es", "d", "ed", "ing")} | {s[:-1] + e for s in stems for e in ("ing", "ies", "es", "ed") if s}
        left = [w for w in words if w.lower() not in own and w.lower() not in _FILLER and not (name and w.lower() == name.lower())]
        return len(left) >= 2
    return True


_PROPER = re.compile(r"\b[A-Z][a-z]+\b(?!\()|\d+")


def template_key(text: str, name: str | None = None) -> int:
    """Hash of a description without proper names, numbers and the function's own name; other words with inner capitals or
    ``_`` stay."""
    if name:
        text = text.replace(name, "0")
    return xxhash.xxh3_64_intdigest(re.sub(r"\s+", " ", _PROPER.sub("0", text)).lower()) - (1 << 63)


_FIRST = re.compile(r"\s*(?:#[^\n]*\n\s*)*([rRuU]?(?:\"\"\"(?:[^\\]|\\[\s\S])*?(?:\"\"\"|$)|'''(?:[^\\]|\\[\s\S])*?(?:'''|$)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'))")


def describe(lang: str, content: str, docstring: str | None, given: str | None, head: bool = True) -> list[tuple]:
    """(line, place, name, signature, content, description, state of the body) of the documented functions of a text; place 0
    is the function that the text begins with, if it is one row's own (``head``). Lines count from 0."""
    text, found = functions_in(lang, content)
    out = []
    for place, f in enumerate(found, 0 if head and found and found[0].first else 1):
        own = place == 0
        sources = [docstring if own else None, "\n".join(f.comments)]
        if f.lang == "python" and (m := _FIRST.match(text, f.body)):
            sources.append(m[1] if m[1].endswith(('"', "'")) else m[1] + m[1].lstrip("rRuU")[:3])
        name = f.name or (re.sub(r" \(part \d+\)$", "", given) if given and own else None)
        for s in sources:
            if s and descriptive(d := clean(s), name):
                out.append((text.count("\n", 0, f.start), place, name, f.signature, content if own else text[f.start : f.end], d, body_state(f, text)))
                break
    return out


class Piece(NamedTuple):
    number: int  # of the part or window
    start: int | None
    id: str
    content: str
    docstring: str | None
    name: str | None


def joined(pieces: list[Piece]) -> tuple[str, list[str]]:
    """One text of the pieces, each line once, and the id of the row that each line is from."""
    lines: dict[int, tuple[str, str]] = {}
    at = 1
    for p in sorted(pieces, key=lambda p: (p.number, p.start is None, p.start or 0, -len(p.content), p.content, p.id)):
        at = at if p.start is None else p.start
        for line in p.content.lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
            lines.setdefault(at, (line, p.id))
            at += 1
    order = sorted(lines)
    return "\n".join([lines[i][0] for i in order]), [lines[i][1] for i in order]


def described(lang: str, kind: str, pieces: list[Piece]) -> list[tuple]:
    """(id, place, name, signature, content, description, state of the body) of the documented functions of a unit: a row
    (``kind`` row), the parts of a function (part) or the windows of a file (window)."""
    if kind == "row":
        return [(p.id, *r[1:]) for p in pieces for r in describe(lang, p.content, p.docstring, p.name)]
    heads = [p for p in pieces if kind == "part" and p.number == 0]
    rest = [p for p in pieces if kind == "window" or p.number > 0]
    out = []
    for h in heads or [None]:
        text, ids = joined([h, *rest] if h else rest)
        out += [(ids[r[0]], *r[1:]) for r in describe(lang, text, h and h.docstring, h and h.name, bool(h))]
    return out


_OUT = "id string, place int, name string, signature string, content string, description string, body string, template bigint"


def _language() -> Column:
    known = F.create_map(*[F.lit(x) for kv in (EXTENSIONS | {k: k for k in GRAMMARS}).items() for x in kv])
    return F.coalesce(language_of(F.col("file_path")), F.element_at(known, F.lower(F.trim("language"))), F.lit(ORDER[0]))


def units(chunks: DataFrame) -> DataFrame:
    """(lang, kind, pieces): rows that stand alone, the parts of each function and the windows of each file; only parts and
    windows are shuffled, repeated ones combined before."""
    window = "node_type in ('fallback', 'fallback_chunk') or id rlike '_fallback[0-9]+$'"
    kind = F.expr(f"case when {window} then 'window' when id rlike '_p[0-9]+$' then 'part' else 'row' end")
    number = F.coalesce(F.regexp_extract("id", "_(?:p|fallback)([0-9]+)$", 1).try_cast("int"), F.lit(0))
    rows = (
        chunks.filter("id is not null and content is not null")
        .withColumns({"lang": _language(), "kind": kind})
        .select("lang", "kind", "file_path", "id", F.struct(F.when(F.col("kind") != "row", number).otherwise(0).alias("number"), F.col("start_line").alias("start"), "id", "content", "docstring", "name").alias("piece"))
    )
    unit = F.expr("if(kind = 'window' and file_path is not null, '', regexp_replace(id, '(_L[0-9]+)?_fallback[0-9]+$|_p[0-9]+$', ''))")
    split = rows.filter("kind <> 'row'").groupBy("lang", "kind", "file_path", unit.alias("unit")).agg(F.collect_set("piece").alias("pieces"))
    return rows.filter("kind = 'row'").select("lang", "kind", F.array("piece").alias("pieces")).unionByName(split.select("lang", "kind", "pieces"))


def documented(chunks: DataFrame) -> DataFrame:
    """(id, place, name, signature, content, description, body, template): the documented functions of the table."""

    def run(t: pa.Table) -> pa.Table:
        out = []
        for lang, kind, pieces in zip(*(t.column(c).to_pylist() for c in ("lang", "kind", "pieces"))):
            out += [(*r, template_key(r[5], r[2])) for r in described(lang, kind, [Piece(**p) for p in pieces])]
        kinds = (pa.string(), pa.int32(), *[pa.string()] * 5, pa.int64())
        return pa.table({n.split()[0]: pa.array([o[k] for o in out], kinds[k]) for k, n in enumerate(_OUT.split(", "))})

    return units(chunks).mapInArrow(per_block(run, 16 << 20), _OUT)


def _without_templates(d: DataFrame) -> DataFrame:
    """Without the descriptions that stand at ``TEMPLATE`` or more functions of different names, counted exactly."""
    names = d.groupBy("template", "name").agg(F.count("*").alias("c"))  # combined before both shuffles
    common = names.groupBy("template").agg(F.count("name").alias("n")).filter(F.col("n") >= TEMPLATE).select("template")
    return d.join(common, "template", "left_anti")


def pairs(chunks: DataFrame) -> DataFrame:
    """(id, place, name, signature, content, description, body) without descriptions that recur as templates; one row per id and
    place."""
    kept = _without_templates(durable(documented(chunks)))
    return kept.groupBy("id", "place").agg(F.min(F.struct("name", "signature", "content", "description", "body")).alias("r")).select("id", "place", "r.*")


def documented_ids(chunks: DataFrame) -> DataFrame:
    """(id) of the rows that begin with a documented function."""
    d = durable(documented(chunks).select("id", "place", "name", "template"))
    return _without_templates(d).filter("place = 0").select("id").distinct()
