"""Lexers of the bundled grammars: six languages, one regular expression each.

``lex`` gives the terminals of a text. A character that starts no token of the language stands for itself, which no
grammar accepts. ``pieces`` gives the comments and strings of a text, for any language, whether or not it parses.
"""

from __future__ import annotations

import re

# Languages by file extension.
EXTENSIONS = {
    "py": "python", "pyw": "python", "ts": "typescript", "js": "javascript", "mjs": "javascript", "cjs": "javascript",
    "go": "go", "rs": "rust", "c": "c", "h": "c",
}
GRAMMARS = {
    "python": ("python",), "typescript": ("js", "ts_hooks"), "javascript": ("js", "js_hooks"), "go": ("go",),
    "rust": ("rust",), "c": ("c",),
}

_SLASH = r"//[^\n]*|/\*[\s\S]*?\*/"
_NUM = r"0[xXbBoO][\da-fA-F_]+[a-zA-Z\d]*|(?:\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?"
_ID = r"[^\W\d]\w*"
_DQ, _SQ = r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'"
_HOLE = r"\$\{(?:[^{}`]|`(?:[^`\\]|\\[\s\S])*`|\{(?:[^{}`]|\{[^{}`]*\})*\})*\}"
_TPL = rf"`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|{_HOLE})*`"
_FSQ = r"[fF][rR]?'(?:[^'\\\n{]|\\[\s\S]|\{\{|\{[^{}\n]*(?:\{[^{}\n]*\}[^{}\n]*)*\})*'|[rR][fF]'(?:[^'\\\n{]|\\[\s\S]|\{\{|\{[^{}\n]*\})*'"
_FDQ = _FSQ.replace("'", '"')
_TRIPLE = r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""' + r"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''"
_PRE = r"(?:[rRbBuUfF]|[rR][bBfF]|[bBfF][rR])?"

_JS_PUNCT = r"=>|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|\.\.\.|==|!=|<=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\*\*|<<"
_C_PUNCT = r"\.\.\.|<<=|>>=|->|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>"
_REGEX = r"(?<=[=(,:;!&|?{}\[\n+]) ?/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*|(?<=return )/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_GO_RAW = r"`[^`]*`"
_RS_STR = r'b?r(#+)"[\s\S]*?"\2|b?r"[^"]*"|[bc]?"(?:[^"\\]|\\[\s\S])*"'

_SKIP_TOKEN = {
    "javascript": (_SLASH, f"{_DQ}|{_SQ}|{_TPL}|{_REGEX}|(?:{_NUM})n?(?![\\w$])|(?:[^\\W\\d]|\\$)[\\w$]*|{_JS_PUNCT}|\\S"),
    "go": (_SLASH, f"{_DQ}|{_GO_RAW}|'(?:[^'\\\\\\n]|\\\\[^\\n])[^'\\n]*'|(?:{_NUM})i?(?!\\w)|{_ID}|&\\^=|&\\^|:=|<-|{_C_PUNCT}|\\n|\\S"),
    "rust": (r"//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*[\s\S]*?\*/)*\*/", f"b?r#+\"[\\s\\S]*?\"#+|b?r\"[^\"]*\"|[bc]?\"(?:[^\"\\\\]|\\\\[\\s\\S])*\"|b?'(?:[^'\\\\\\n]|\\\\[^'\\n]+|\\\\')'|'{_ID}|r#{_ID}|(?:0[xbo][\\da-fA-F_]+|\\d[\\d_]*(?:\\.(?![.\\w])|\\.\\d[\\d_]*)?(?:[eE][+-]?[\\d_]+)?)(?:[iuf]\\d+|[iu]size)?(?!\\w)|{_ID}|=>|->|::|\\.\\.=|\\.\\.\\.|\\.\\.|&&|\\|\\||==|!=|<=|\\+=|-=|\\*=|/=|%=|&=|\\|=|\\^=|\\S"),
    "c": (_SLASH + r"|(?<![^\n])[ \t]*#(?:[^\n\\/]|\\[\s\S]|/(?!\*)|/\*[\s\S]*?\*/)*", f"(?:u8|[uUL])?{_DQ}|(?:u8|[uUL])?{_SQ}|(?:0[xX][\\da-fA-F.]+(?:[pP][+-]?\\d+)?|(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)[uUlLfF]*(?!\\w)|{_ID}|{_C_PUNCT}|\\S"),
    "python": (r"#[^\n]*|\\\n", f"{_PRE}(?:{_TRIPLE})|{_FSQ}|{_FDQ}|{_PRE}(?:{_DQ}|{_SQ})|(?:0[xX][\\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:0[0_]*(?![\\d_.eEjJ])|[1-9][\\d_]*(?![\\d_.eEjJ])|(?:\\d[\\d_]*\\.[\\d_]*|\\.\\d[\\d_]*)(?:[eE][+-]?\\d[\\d_]*)?[jJ]?|\\d[\\d_]*[eE][+-]?\\d[\\d_]*[jJ]?|\\d[\\d_]*[jJ]))(?!\\w)|{_ID}|\\.\\.\\.|\\*\\*=|//=|>>=|<<=|->|:=|\\*\\*|//|<<|>>|==|!=|<=|>=|\\+=|-=|\\*=|/=|%=|@=|&=|\\|=|\\^=|\\n[ \\t\\f]*|\\S"),
}
_SKIP_TOKEN["typescript"] = _SKIP_TOKEN["javascript"]
_LEX = {k: re.compile(f"(?:{skip})|({tok})") for k, (skip, tok) in _SKIP_TOKEN.items()}

# Words of C that the grammar knows under another name.
_C_NAMES = {
    "__attribute__": "attribute", "__inline": "inline", "__inline__": "inline", "__restrict": "restrict", "__restrict__": "restrict",
    "__volatile__": "volatile", "__const": "const", "__asm__": "asm", "__asm": "asm", "_Bool": "bool", "_Complex": "complex",
    "_Static_assert": "static_assert", "_Alignas": "alignas", "_Alignof": "alignof", "_Noreturn": "noreturn", "_Thread_local": "thread_local",
    "_Generic": "generic", "_Atomic": "atomic", "__typeof__": "typeof", "__signed__": "signed",
}
_C_PLAIN = {"attribute", "generic", "atomic", "noreturn", "complex", "bool", "alignas", "alignof", "thread_local", "asm", "static_assert", "typeof", "auto"}


class _Kinds(dict):
    """Terminal of each token; words and literals that are no terminals get their class."""

    def __init__(self, lang: str, terminals: set[str]):
        words = {t: t for t in terminals if not t.isupper()}
        for t in ("}$", "${"):
            words.pop(t, None)
        if lang == "c":
            words = {k: v for k, v in words.items() if k not in _C_PLAIN} | _C_NAMES
        super().__init__(words)
        self[""] = ""
        self.lang = lang

    def __missing__(self, t: str) -> str:
        c = t[0]
        if c.isidentifier() or c == "$":
            if t[-1] in "\"'" and len(t) > 1:
                return "CHAR" if self.lang in ("rust", "c") and t[-1] == "'" else "STR"
            if self.lang == "rust" and t[-1] == "#":
                return "STR"
            return "ID"
        if c.isdigit() or (c == "." and len(t) > 1 and t[1].isdigit()):
            return "NUM"
        if c in "\"'`" and len(t) > 1:
            if t[-1] == c:
                if c == "'":
                    return {"rust": "CHAR", "c": "CHAR"}.get(self.lang, "STR")
                return "STR"
            return "LIFE" if c == "'" and self.lang == "rust" else t
        if c in " /" and len(t) > 1:
            return "REGEX"
        return t


_HOLES = re.compile(_HOLE)


def _open_templates(found: list[str], lex) -> list[str]:
    """Templates as head, the tokens of each substitution in marks, and end."""
    out = []
    for t in found:
        if t[:1] != "`" or len(t) == 1:
            out.append(t)
            continue
        out.append("`head")
        for m in _HOLES.finditer(t):
            out.append("`open")
            out += _open_templates(lex(m[0][2:-1]), lex)
            out.append("`shut")
        out.append("`end")
    return out


_TEMPLATE = {"`head": "TPL", "`open": "${", "`shut": "}$", "`end": "TPLEND"}
_GO_END = re.compile(r"[\w)\]}\"'`]$|\+\+$|--$")


def lex_go(found: list[str], kinds: _Kinds) -> list[str]:
    """Terminals with the semicolons that a line end stands for."""
    out: list[str] = []
    last = ""
    for t in found:
        if t == "\n":
            if last and (last[-1] in ")]}\"'`" or last in ("++", "--") or last[-1].isalnum() or last[-1] == "_") and last not in _GO_OPEN:
                out.append(";")
            last = ""
        elif t:
            out.append(kinds[t])
            last = t
    if last and last not in _GO_OPEN:
        out.append(";")
    return out


# Words of Go after which a line end is no semicolon.
_GO_OPEN = {
    "case", "chan", "const", "default", "defer", "else", "for", "func", "go", "goto", "if", "import", "interface", "map", "package", "range",
    "select", "struct", "switch", "type", "var",
}


def lex_python(found: list[str], kinds: _Kinds) -> list[str]:
    """Terminals with NL, INDENT and DEDENT; a wrong dedent gives the terminal BADDENT."""
    out: list[str] = []
    put = out.append
    depth, indents, width, fresh = 0, [0], 0, True
    for t in found:
        if not t:
            continue
        if t[0] == "\n":
            if depth == 0:
                if not fresh:
                    put("NL")
                fresh = True
                width = len(t.expandtabs(8)) - 1
            continue
        if fresh:
            fresh = False
            if width > indents[-1]:
                indents.append(width)
                put("INDENT")
            else:
                while width < indents[-1]:
                    indents.pop()
                    put("DEDENT")
                if width != indents[-1]:
                    put("BADDENT")
        if t in "([{":
            depth += 1
        elif t in ")]}" and depth:
            depth -= 1
        put(kinds[t])
    if not fresh:
        put("NL")
    out += ["DEDENT"] * (len(indents) - 1)
    return out


def lex(lang: str, text: str, kinds: _Kinds) -> list[str]:
    find = _LEX[lang].findall
    if lang == "python":
        return lex_python(find(text if text[:1] not in " \t" else "\n" + text), kinds)
    if lang == "go":
        return lex_go(find(_blank_comments(text)), kinds)
    if lang in ("javascript", "typescript"):
        if text.startswith("#!"):
            text = "//" + text
        found = find(text)
        if "`" in text:
            found = _open_templates(found, find)
            return [_TEMPLATE[t] if t in _TEMPLATE else kinds[t] for t in found]
        return list(map(kinds.__getitem__, found))
    if lang == "rust" and text.startswith("#!") and not text.startswith("#!["):
        text = "//" + text
    return list(map(kinds.__getitem__, find(text)))


_GO_COMMENT = re.compile(rf"({_DQ}|{_GO_RAW}|'(?:[^'\\\n]|\\[^\n])[^'\n]*')|//[^\n]*|/\*[\s\S]*?\*/")


def _blank_comments(text: str) -> str:
    return _GO_COMMENT.sub(lambda m: m[1] or ("\n" if "\n" in m[0] else " "), text) if "/" in text else text


def tokens_with_lines(lang: str, text: str) -> list[tuple[str, int]]:
    """(token text, line) of every token, for messages and for semicolon insertion."""
    out = []
    line, at = 1, 0
    for m in _LEX[lang].finditer(text):
        if m[1]:
            line += text.count("\n", at, m.start(1))
            at = m.start(1)
            out.append((m[1], line))
    return out


_F_PREFIX = re.compile(r"[rR]?[fF][rR]?(\"\"\"|\'\'\'|[\"\'])")


def holes(token: str) -> list[str] | None:
    """The expressions in the holes of a Python string, those of its format specifications included; none if it is no f-string,
    None if a hole does not end or a brace stands alone."""
    m = _F_PREFIX.match(token)
    if not m:
        return []
    out: list[str] = []
    end = _literal(token[m.end() : len(token) - len(m[1])], 0, out, False)
    return None if end < 0 else out


def _literal(s: str, i: int, out: list[str], spec: bool) -> int:
    """Position behind a literal part (of a specification: its closing brace), or -1."""
    while i < len(s):
        if s[i] == "{":
            if not spec and s.startswith("{{", i):
                i += 2
                continue
            i = _hole(s, i + 1, out)
            if i < 0:
                return -1
        elif s[i] == "}":
            if spec:
                return i
            if not s.startswith("}}", i):
                return -1
            i += 2
        elif s.startswith("\\N{", i):  # a character by its name
            i = s.find("}", i) + 1 or len(s)
        else:
            i += 2 if s[i] == "\\" and s[i + 1 : i + 2] not in ("{", "}") else 1
    return -1 if spec else i


def _hole(s: str, i: int, out: list[str]) -> int:
    """Position behind the hole whose expression begins at ``i``, or -1."""
    start, depth = i, 0
    while i < len(s):
        c = s[i]
        if c in "\"'":
            q = s[i : i + 3] if s[i : i + 3] in ('"""', "'''") else c
            i = s.find(q, i + len(q))
            if i < 0:
                return -1
            i += len(q)
            continue
        if c in "([{":
            depth += 1
        elif c in ")]}" and depth:
            depth -= 1
        elif c == "}" or depth == 0 and (c == ":" or c == "!" and s[i + 1 : i + 2] != "="):
            break
        i += 1
    else:
        return -1
    out.append(re.sub(r"(?<![=!<>:])=\s*$", "", s[start:i]))
    if s[i] == "!":
        m = re.compile(r"!\s*[rsa]\s*").match(s, i)
        if not m or s[m.end() : m.end() + 1] not in ("}", ":"):
            return -1
        i = m.end()
    if s[i] == ":":
        i = _literal(s, i + 1, out, True)
        if i < 0:
            return -1
    return i + 1


_PIECES = {
    "python": re.compile(rf"(?P<c>#[^\n]*)|(?P<s>{_PRE}(?:{_TRIPLE})|{_PRE}(?:{_DQ}|{_SQ}))"),
    "javascript": re.compile(rf"(?P<c>{_SLASH})|(?P<s>{_DQ}|{_SQ}|{_TPL}|`[^`]*`)"),
    "go": re.compile(rf"(?P<c>{_SLASH})|(?P<s>{_DQ}|{_GO_RAW}|'(?:[^'\\\n]|\\.)')"),
    "rust": re.compile(rf"(?P<c>{_SLASH})|(?P<s>b?r(?P<h>#+)\"[\s\S]*?\"(?P=h)|b?r\"[^\"]*\"|\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[^'\n]+|\\')')"),
    "c": re.compile(rf"(?P<c>{_SLASH})|(?P<s>{_DQ}|{_SQ})"),
}
_PIECES["typescript"] = _PIECES["javascript"]


def pieces(lang: str, text: str):
    """(kind, start, end) of comments ('c') and strings ('s')."""
    for m in _PIECES[lang].finditer(text):
        yield ("c" if m.lastgroup == "c" or m["c"] else "s"), m.start(), m.end()


def kinds_of(lang: str, terminals: set[str]) -> _Kinds:
    return _Kinds(lang, terminals)
