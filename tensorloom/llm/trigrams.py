"""Boolean trigram queries of regular expressions.

``query(pattern)`` gives a disjunction of conjunctions: a text that matches the pattern contains,
once its letters A-Z are lower-cased, all trigrams of at least one conjunction. ``None`` stands for
a pattern without mandatory trigrams, which every text satisfies.
"""

from __future__ import annotations

import re
from itertools import product

#: More alternatives than this are given up for a weaker query.
MOST = 48

_parser, _c = re._parser, re._constants


def _exact(op, arg) -> set[str] | None:
    """The few strings that a pattern item can stand for, or None."""
    if op is _c.LITERAL:
        return {chr(arg)}
    if op is _c.IN:
        out: set[str] = set()
        for kind, x in arg:
            if kind is _c.LITERAL:
                out.add(chr(x).lower())
            elif kind is _c.RANGE and x[1] - x[0] < 4:
                out |= {chr(i).lower() for i in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is _c.AT:
        return {""}
    return None


def _prune(clauses: set[frozenset[str]]) -> set[frozenset[str]]:
    """Without the clauses that follow from a shorter one."""
    return {c for c in clauses if not any(d < c for d in clauses)}


def _both(a: set[frozenset[str]], b: set[frozenset[str]]) -> set[frozenset[str]]:
    made = _prune({x | y for x, y in product(a, b)})
    return made if len(made) <= MOST else max(a, b, key=lambda q: min(map(len, q)))


ALL = {frozenset()}


def _of(strings: set[str]) -> set[frozenset[str]]:
    return _prune({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _walk(items) -> tuple[set[str] | None, set[frozenset[str]]]:
    """The item sequence's strings, if they are few, and its clauses."""
    held: set[str] = {""}  # what the items since the last flush can stand for
    whole, clauses = True, ALL
    for op, arg in items:
        own, more = _exact(op, arg), ALL
        if op is _c.SUBPATTERN:
            own, more = _walk(arg[3])
        elif op is _c.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            more = _prune(set().union(*[p[1] for p in parts]))
            if all(p[0] is not None for p in parts):
                own = set().union(*[p[0] for p in parts])
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT, getattr(_c, "POSSESSIVE_REPEAT", None)):
            low, high, body = arg
            inside, more = _walk(body)
            more = more if low else ALL
            if inside is not None and high == 1:
                own = inside | {""} if low == 0 else inside
            elif inside is not None and low == high and len(inside) ** low <= MOST:
                own = {"".join(x) for x in product(inside, repeat=low)}
        elif op in (_c.ASSERT, _c.ASSERT_NOT):
            own = {""}
        if own is not None:
            own = {s.lower() for s in own}
        if own is not None and len(held) * len(own) <= MOST:
            held = {a + b for a, b in product(held, own)}
        else:
            clauses = _both(clauses, _of(held))
            clauses = _both(clauses, more if own is None else _both(more, _of(own)))
            held, whole = {""}, False
    clauses = _both(clauses, _of(held))
    return (held if whole else None), clauses


def query(pattern: str) -> list[frozenset[str]] | None:
    """The pattern's trigram query, or None where nothing is mandatory."""
    clauses = _walk(_parser.parse(pattern))[1]
    return None if frozenset() in clauses else sorted(clauses, key=sorted)


def finder(grams: list[str]) -> str:
    """A pattern whose first group is, at every place where one starts, one of the trigrams in any case.

    It looks ahead and takes no characters, so overlapping trigrams are all found. Common beginnings
    are tested once.
    """
    either = lambda c: f"[{c}{c.upper()}]" if c != c.upper() else re.escape(c)

    def branch(tails: set[str]) -> str:
        if tails == {""}:
            return ""
        heads: dict[str, set[str]] = {}
        for t in sorted(tails):
            heads.setdefault(t[0], set()).add(t[1:])
        if all(v == {""} for v in heads.values()):
            return "[" + "".join(re.escape(c) if c == c.upper() else c + c.upper() for c in heads) + "]"
        return "(?:" + "|".join(either(c) + branch(v) for c, v in heads.items()) + ")"

    return f"(?=({branch(set(grams))}))"
