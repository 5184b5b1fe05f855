"""Generalised LL parsing with a graph-structured stack.

Any context-free grammar of :class:`quern.grammars.pda.Grammar` works, ambiguous or left-recursive. Stack nodes are
(rule, position) and shared by all parses that call the rule there; a node remembers where its rule has ended, so a
later caller goes on at once. The result holds every end of every rule, from which spans can be read.
"""

from __future__ import annotations

from quern.grammars.pda import Grammar


class Gss:
    """Outcome of one parse: ends[rule, start] = positions where the rule can end."""

    def __init__(self):
        self.edges: dict[tuple[int, int], set] = {}
        self.ends: dict[tuple[int, int], set[int]] = {}


def parse(g: Grammar, tokens: list[str], at: int = 0, rule: int | None = None) -> Gss:
    """Parse ``tokens`` from ``at``; prefixes count, so look at ``ends`` of the start rule."""
    gss = Gss()
    todo: list[tuple] = []
    seen: set[tuple] = set()

    def add(node, alt, dot, pos):
        d = (node, alt, dot, pos)
        if d not in seen:
            seen.add(d)
            todo.append(d)

    def call(sym, pos):
        node = (sym, pos)
        if node not in gss.edges:
            gss.edges[node], gss.ends[node] = set(), set()
            t = tokens[pos] if pos < len(tokens) else ""
            for alt in (*g.predict[sym].get(t, ()), *g.empty[sym]):
                add(node, alt, 0, pos)
        return node

    call(g.start if rule is None else rule, at)
    while todo:
        node, alt, dot, pos = todo.pop()
        while dot < len(alt):
            sym = alt[dot]
            if isinstance(sym, str):
                if pos >= len(tokens) or tokens[pos] != sym:
                    break
                dot, pos = dot + 1, pos + 1
                continue
            inner = call(sym, pos)
            edge = (node, alt, dot + 1)
            if edge not in gss.edges[inner]:
                gss.edges[inner].add(edge)
                for end in gss.ends[inner]:
                    add(node, alt, dot + 1, end)
            break
        else:
            if pos not in gss.ends[node]:
                gss.ends[node].add(pos)
                for to, a, d in gss.edges[node]:
                    add(to, a, d, pos)
    return gss
