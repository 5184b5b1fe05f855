"""Function headers in token streams with recovery: brackets matched as far as they can be, and GLL over folded groups."""

from __future__ import annotations

import re

from quern.grammars import gll, lexers, pda

GRAMMAR = {"python": "functions_python", "typescript": "functions_js", "javascript": "functions_js", "go": "functions_go", "rust": "functions_rust", "c": "functions_c"}
ORDER = ("typescript", "python", "go", "rust", "c")
# Words that can never name a function in any of the languages.
RESERVED = frozenset(
    "if for while switch catch return else do try match loop with class struct enum interface type impl trait import from package new throw raise case elif except finally".split()
)
_shapes: dict[tuple, tuple | None] = {}
CLOSE = {"(": ")", "[": "]", "{": "}"}
OPEN = {v: k for k, v in CLOSE.items()}
_AGAIN = re.compile(r"(?:async[ \t]+)?def[ \t]+\w+[ \t]*[(\[]|class[ \t]+\w+[ \t]*[:(]|@\w")
_recognisers: dict[str, pda.Recogniser] = {}


class Tokens:
    """Tokens of a text with their brackets matched, the places where statements can begin and the comments before these."""

    def __init__(self, lang: str, text: str, start: int):
        self.lang, self.text = lang, text
        self.base = "javascript" if lang == "typescript" else lang
        python = self.base == "python"
        self.texts: list[str] = []
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.fresh: list[bool] = []
        self.comments: dict[int, list[tuple[int, int]]] = {}
        self.shut: dict[int, int] = {}  # of an opening bracket the closing one; missing if none is left
        stack: list[int] = []
        held: list[tuple[int, int]] = []
        line = True
        last = start
        for m in lexers._LEX[lang].finditer(text, start):
            t = m[1]
            if t is None:
                if not (python and m[0] == "\\\n") and not (self.base == "c" and m[0].lstrip().startswith("#")):
                    held.append((m.start(), m.end()))
                continue
            if t[0] == "\n":
                if not python:
                    continue
                if stack and _AGAIN.match(text, m.end(1)):
                    stack.clear()
                if not stack and self.texts and self.texts[-1][0] != "\n":
                    self._put(t, m, False)
                line = not stack
                continue
            n = len(self.texts)
            if held:
                self.comments[n] = held
                held = []
            self._put(t, m, n == 0 or self.texts[-1] in ";{}" or (line if python else "\n" in text[last : m.start(1)]))
            line, last = False, m.end(1)
            if t in CLOSE:
                stack.append(n)
            elif t in OPEN:
                at = len(stack) - 1
                while at >= 0 and self.texts[stack[at]] != OPEN[t] and (t == "}" or self.texts[stack[at]] != "{"):
                    at -= 1
                if at >= 0 and self.texts[stack[at]] == OPEN[t]:
                    for k in stack[at:]:
                        self.shut[k] = n
                    del stack[at:]

    def _put(self, t, m, fresh):
        self.texts.append(t)
        self.starts.append(m.start(1))
        self.ends.append(m.end(1))
        self.fresh.append(fresh)

    def before(self, i: int) -> list[str]:
        """The comments directly before token ``i``: all for the first, else those with a line of their own."""
        own = self.comments.get(i, [])
        text = self.text
        return [text[a:b] for a, b in own if i == 0 or not text[text.rfind("\n", 0, a) + 1 : a].strip()]


def kind_of(lang: str, words, t: str) -> str:
    if t in words and not t.isupper():
        return t
    if t in RESERVED:
        return "RESERVED"
    if t[0].isidentifier() or t[0] == "$":
        return "STR" if t[-1] in "\"'" else "ID"
    if t[0].isdigit():
        return "NUM"
    if t[0] in "\"'`" and len(t) > 1:
        return "LIFE" if lang == "rust" and t[-1] != t[0] else "STR"
    return t


def angles(tk: Tokens, j: int) -> int | None:
    """Index of the token that closes the angle bracket at ``j``."""
    depth, n = 0, len(tk.texts)
    while j < n:
        t = tk.texts[j]
        if t == "<":
            depth += 1
        elif t in (">", ">>"):
            depth -= len(t)
            if depth <= 0:
                return j
        elif t in CLOSE:
            j = tk.shut.get(j, n)
        elif t in OPEN or t == ";":
            return None
        j += 1
    return None


def header(tk: Tokens, i: int, grammar: str | None = None):
    """(terminals, their tokens) from token ``i`` up to a body, as far as the grammar (of functions, if none is given) has a
    parse left. An assignment or the end of a statement also end the header where the grammar has ASSIGN or STOP."""
    lang, base = tk.lang, tk.base
    name = grammar or GRAMMAR[lang]
    g = pda.bundled(name)
    rec = _recognisers.get(name)
    if rec is None or len(rec.states) > rec.LIMIT:
        rec = _recognisers[name] = pda.Recogniser(g, {})
    state = rec.first
    kinds: list[str] = []
    at: list[int] = []
    j, n = i, len(tk.texts)
    while j < n:
        t = tk.texts[j]
        here, nxt = j, j + 1
        if t == "{" and base != "python" or t == "=>" and base == "javascript" or t == ":" and base == "python":
            kind = "BODY"
        elif t == "=" and "ASSIGN" in g.terminals:
            kind = "ASSIGN"
        elif t == ";" and "STOP" in g.terminals:
            kind = "STOP"
        elif t in CLOSE:
            shut = tk.shut.get(j)
            if shut is None or tk.texts[shut] != CLOSE[t]:
                return None
            kind, nxt = {"(": "PARENS", "[": "BRACKETS", "{": "BRACES"}[t], shut + 1
        elif t in OPEN or t == ";":
            return None
        elif t[0] == "\n":
            kind = "NL"
        elif t == "<" and base in ("javascript", "rust") and kinds and kinds[-1] in ("ID", "function", "=", "async", "impl"):
            shut = angles(tk, j)
            if shut is None:
                return None
            kind, nxt = "ANGLES", shut + 1
        else:
            kind = kind_of(lang, g.terminals, t)
        state = state[kind]
        if state is None:
            return None
        kinds.append(kind)
        at.append(here)
        if kind in ("BODY", "ASSIGN", "STOP"):
            return kinds, at
        j = nxt
    return None


def body_end(tk: Tokens, i: int, body: int) -> tuple[int, bool]:
    """(end in the text, whether the body is cut off) of the body that begins with token ``body`` of a function at token ``i``."""
    texts, n = tk.texts, len(tk.texts)
    if texts[body] == "=>" and body + 1 < n and texts[body + 1] == "{":
        body += 1
    if texts[body] == "{":
        shut = tk.shut.get(body)
        cut = shut is None or texts[shut] != "}"
        return (len(tk.text) if shut is None else tk.ends[shut] if not cut else tk.starts[shut]), cut
    j = body + 1
    if tk.base == "python":
        if j >= n:
            return len(tk.text), True
        column = tk.starts[i] - (tk.text.rfind("\n", 0, tk.starts[i]) + 1)
        while j < n:
            if texts[j][0] == "\n" and (j + 1 >= n or len(tk.text[tk.text.rfind("\n", 0, tk.starts[j + 1]) + 1 : tk.starts[j + 1]]) <= column):
                return tk.ends[j - 1], j == body + 1
            j = tk.shut.get(j, n - 1) + 1 if texts[j] in CLOSE else j + 1
        return len(tk.text), False
    while j < n:
        t = texts[j]
        if t in OPEN or t in ";," or tk.fresh[j] and j > body + 1 and (t[0].isalnum() or t[0] in "_$@") and (texts[j - 1][-1].isalnum() or texts[j - 1][-1] in "_$)]}\"'`"):
            break
        j = tk.shut.get(j, n - 1) + 1 if t in CLOSE else j + 1
    return (tk.ends[j - 1] if j > body + 1 else tk.ends[body]), j == body + 1


def _names(kinds: list[str], p: int) -> bool:
    """Whether the token at ``p`` stands where a function's name does: after its keyword, or before parameters or ``=``."""
    if p and kinds[p - 1] in ("def", "fn"):
        return True
    if "def" in kinds or "fn" in kinds:
        return False
    q = p + 1
    while q < len(kinds) and kinds[q] in ("?", "ANGLES", "BRACKETS"):
        q += 1
    return q < len(kinds) and (kinds[q] == "PARENS" or kinds[q] == "=" or kinds[q] == ":" and "=" in kinds[q:]) and ("=" not in kinds or q <= kinds.index("="))


def statement_end(tk: Tokens, j: int) -> int:
    """Index of the last token of the statement that goes on with token ``j``: a ``;``, the token before a stray closing bracket,
    or the last one before a line that starts anew."""
    texts, n = tk.texts, len(tk.texts)
    by_line = tk.base in ("javascript", "go")
    first = j
    while j < n:
        t = texts[j]
        if t == ";":
            return j
        if t in OPEN:
            return max(first, j - 1)
        if by_line and j > first and tk.fresh[j] and (t[0].isalnum() or t[0] in "_$@#") and t not in _GOES_ON and (texts[j - 1][-1].isalnum() or texts[j - 1][-1] in "_$)]}\"'`"):
            return j - 1
        j = tk.shut.get(j, n - 1) + 1 if t in CLOSE else j + 1
    return n - 1


_GOES_ON = frozenset(("extends", "implements", "instanceof", "in", "of", "as", "satisfies", "else", "catch", "finally"))


def rule_of(grammar: str, kinds: list[str], names: tuple[str, ...]) -> tuple[str, int] | None:
    """(rule among ``names`` that the whole header is, index of its name token or -1), by GLL."""
    key = (grammar, *kinds)
    if key not in _rules:
        g = pda.bundled(grammar)
        r = gll.parse(g, kinds)
        out = next((n for n in names if len(kinds) in r.ends.get((g.number[n], 0), ())), None)
        at = min((p for (rule, p), ends in r.ends.items() if rule == g.number["name"] and ends), default=-1)
        if len(_rules) > 50_000:
            _rules.clear()
        _rules[key] = (out, at) if out else None
    return _rules[key]


_rules: dict[tuple, tuple[str, int] | None] = {}


def parse_header(lang: str, kinds: list[str]) -> int | None:
    """Index of the function's name token if the header is one of a function, -1 if it has no name."""
    key = (lang == "javascript" and "typescript" or lang, *kinds)
    if key in _shapes:
        return _shapes[key]
    g = pda.bundled(GRAMMAR[lang])
    r = gll.parse(g, kinds)
    at = None
    if len(kinds) in r.ends.get((g.start, 0), ()):
        name = g.number["name"]
        found = [p for (rule, p), ends in r.ends.items() if rule == name and ends]
        at = max((p for p in found if _names(kinds, p)), default=-1)
    if len(kinds) <= 60:  # longer shapes hardly recur
        if len(_shapes) > 50_000:
            _shapes.clear()
        _shapes[key] = at
    return at
