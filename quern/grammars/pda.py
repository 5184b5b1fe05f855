"""Table-driven recognition with bundled grammars.

A grammar text in EBNF is compiled to a predict table: for each rule and terminal the alternatives that can start with
it. The table need not be free of conflicts: a parser state is the *set* of live stacks, stacks are shared lists, and
states are interned and built when first needed, so the table grows into a deterministic automaton over the stacks
that really occur. Every token of a stream then costs one dictionary lookup, whatever the grammar's conflicts.
"""

from __future__ import annotations

import re
from functools import lru_cache
from pathlib import Path

_PART = re.compile(r"'((?:[^'\\]|\\.)+)'|([A-Za-z_]\w*)|([:;|()?*+])")


def read_rules(text: str) -> dict[str, list]:
    """EBNF text as {rule: expression}; expressions are ('alt', ...), ('seq', ...), ('?', x), ('*', x), ('+', x), ('t', s), ('r', s)."""
    toks = []
    for line in text.split("\n"):
        if not line.startswith("#"):
            toks += [("lit", m[1]) if m[1] else ("name", m[2]) if m[2] else ("op", m[3]) for m in _PART.finditer(line)]
    at = 0

    def alt():
        nonlocal at
        out = [seq()]
        while toks[at] == ("op", "|"):
            at += 1
            out.append(seq())
        return ("alt", *out)

    def seq():
        nonlocal at
        out = []
        while toks[at] not in (("op", "|"), ("op", ")"), ("op", ";")):
            kind, v = toks[at]
            at += 1
            if kind == "lit":
                x = ("t", v)
            elif kind == "name":
                x = ("t", v) if v.isupper() else ("r", v)
            else:
                x = alt()
                at += 1
            while toks[at] in (("op", "?"), ("op", "*"), ("op", "+")):
                x = (toks[at][1], x)
                at += 1
            out.append(x)
        return ("seq", *out)

    rules = {}
    while at < len(toks):
        name = toks[at][1]
        at += 2
        rules[name] = alt()
        at += 1
    return rules


class Grammar:
    """Plain alternatives over numbered symbols: terminals are strings, rules are ints."""

    def __init__(self, text: str):
        rules = read_rules(text)
        self.number = {n: i for i, n in enumerate(rules)}
        self.alts: list[list[tuple]] = [[] for _ in rules]
        self.terminals: set[str] = set()
        for n, x in rules.items():
            self.alts[self.number[n]] = self._expand(x)
        plain = self.terminals - {"ANYTOKEN"}
        brackets = set("(){}[]")
        for alts in self.alts:
            if ("ANYTOKEN",) in alts:
                alts.remove(("ANYTOKEN",))
                own = {a[0] for a in alts if len(a) > 1}
                alts.extend((t,) for t in sorted(plain - {b for o, c in ("()", "[]", "{}") if o in own for b in (o, c)} - (brackets if len(own) > 1 else set("()"))))
        self.terminals = plain
        self._first()
        self.start = self.number["start"]

    def _new(self, alts):
        self.alts.append(alts)
        return len(self.alts) - 1

    def _expand(self, x) -> list[tuple]:
        if x[0] == "alt":
            return [a for y in x[1:] for a in self._expand(y)]
        if x[0] == "seq":
            if len(x) == 2 and x[1][0] == "alt":
                return self._expand(x[1])
            return [tuple(self._symbol(y) for y in x[1:])]
        return [(self._symbol(x),)]

    def _symbol(self, x):
        if x[0] == "t":
            self.terminals.add(x[1])
            return x[1]
        if x[0] == "r":
            return self.number[x[1]]
        if x[0] in ("alt", "seq"):
            alts = self._expand(x)
            return alts[0][0] if len(alts) == 1 and len(alts[0]) == 1 else self._new(alts)
        inner = self._symbol(x[1])
        if x[0] == "?":
            return self._new([(inner,), ()])
        me = self._new([])
        self.alts[me] = [(inner, me), ()]
        return me if x[0] == "*" else self._new([(inner, me)])

    def _first(self):
        n = len(self.alts)
        self.nullable = [False] * n
        first: list[set] = [set() for _ in range(n)]
        changed = True
        while changed:
            changed = False
            for i, alts in enumerate(self.alts):
                for a in alts:
                    for s in a:
                        if isinstance(s, str):
                            if s not in first[i]:
                                first[i].add(s)
                                changed = True
                            break
                        if not first[s] <= first[i]:
                            first[i] |= first[s]
                            changed = True
                        if not self.nullable[s]:
                            break
                    else:
                        if not self.nullable[i]:
                            self.nullable[i] = changed = True
        #: predict[rule][terminal]: alternatives to try; those that can be empty are in skip[rule].
        self.predict: list[dict[str, list[tuple]]] = [{} for _ in range(n)]
        self.empty: list[list[tuple]] = [[] for _ in range(n)]
        for i, alts in enumerate(self.alts):
            for a in alts:
                heads, null = set(), True
                for s in a:
                    heads |= {s} if isinstance(s, str) else first[s]
                    if isinstance(s, str) or not self.nullable[s]:
                        null = False
                        break
                if null:
                    self.empty[i].append(a)
                else:
                    for t in heads:
                        self.predict[i].setdefault(t, []).append(a)


class _State(dict):
    """A set of stacks; maps each terminal to the next state (None: no stack survives)."""

    __slots__ = ("stacks", "owner", "_ends")

    def __missing__(self, t):
        nxt = self.owner._step(self, t)
        if len(self) < 4096:
            self[t] = nxt
        return nxt


class Recogniser:
    LIMIT = 200_000  # interned states, then the tables start again: memory stays bounded

    def __init__(self, grammar: Grammar, classes: dict[str, str]):
        self.g = grammar
        self.classes = classes  # first character of a token that is no terminal itself -> terminal
        self.reset()

    def reset(self):
        self.nodes: dict[tuple, tuple] = {}
        self.states: dict[frozenset, _State] = {}
        self.first = self._state({self._push(self.g.start, None)})

    def _push(self, sym, rest):
        key = (sym, id(rest))
        node = self.nodes.get(key)
        if node is None:
            node = self.nodes[key] = (sym, rest)
        return node

    def _state(self, stacks) -> _State | None:
        if not stacks:
            return None
        key = frozenset(map(id, stacks))
        s = self.states.get(key)
        if s is None:
            s = self.states[key] = _State()
            s.stacks, s.owner = tuple(stacks), self
            s[""] = s  # comments
        return s

    def _step(self, state: _State, t: str) -> _State | None:
        if t not in self.g.terminals:
            t = self.classes.get(t, "")
            if not t:
                return None
            return state[t]
        out: dict[int, tuple] = {}
        seen = set()
        todo = list(state.stacks)
        while todo:
            node = todo.pop()
            if node is None or id(node) in seen:
                continue
            seen.add(id(node))
            sym, rest = node
            if isinstance(sym, str):
                if sym == t:
                    if rest is None:
                        rest = self.END
                    out[id(rest)] = rest
                continue
            for a in (*self.g.predict[sym].get(t, ()), *self.g.empty[sym]):
                to = rest
                for s in reversed(a):
                    to = self._push(s, to)
                if to is None:
                    continue
                todo.append(to)
        return self._state(list(out.values()))

    END = ("END", None)

    def accepts_end(self, state: _State) -> bool:
        """Whether the input may end here."""
        try:
            return state._ends
        except AttributeError:
            pass
        todo, seen = list(state.stacks), set()
        ok = False
        while todo and not ok:
            node = todo.pop()
            if node is None or node is self.END:
                ok = True
                break
            if id(node) in seen:
                continue
            seen.add(id(node))
            sym, rest = node
            if isinstance(sym, str):
                continue
            for a in self.g.empty[sym]:
                to = rest
                for s in reversed(a):
                    to = self._push(s, to)
                if to is None:
                    ok = True
                else:
                    todo.append(to)
        state._ends = ok
        return ok


@lru_cache(maxsize=None)
def bundled(*names: str) -> Grammar:
    here = Path(__file__).parent
    return Grammar("\n".join((here / f"{n}.g").read_text() for n in names))
