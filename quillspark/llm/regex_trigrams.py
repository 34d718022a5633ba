"""Boolean trigram queries that every match of a regular expression satisfies.

The parse tree of the expression is walked with sets of exact strings: a part that can only match a
few strings is carried as those strings, and as soon as it can't, the strings gathered so far are
turned into conditions. Sequences give AND, alternatives OR. Letters are folded to lower case, so the
query must be put to lower-cased text. ``None`` means that nothing is mandatory.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

_FEW = 64


@dataclass(frozen=True)
class All:
    parts: tuple

    def trigrams(self) -> set[str]:
        return {t for p in self.parts for t in ({p} if isinstance(p, str) else p.trigrams())}


@dataclass(frozen=True)
class Any_:
    parts: tuple

    def trigrams(self) -> set[str]:
        return {t for p in self.parts for t in ({p} if isinstance(p, str) else p.trigrams())}


def _both(parts: list):
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else All(tuple(parts))


def _one_of(strings: set[str]):
    """Some one of the strings occurs."""
    grams = {s: frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    if not all(grams.values()):
        return None
    # an option that asks for all that another asks for, and more, adds nothing
    least = sorted(s for s in grams if not any(o < grams[s] for o in grams.values()))
    options = list(dict.fromkeys(_both([s[i : i + 3] for i in range(len(s) - 2)]) for s in least))
    return options[0] if len(options) == 1 else Any_(tuple(options)) if options else None


def _walk(nodes) -> tuple[set[str] | None, object]:
    """The exact strings a sequence can match (None: too many), and a query besides."""
    exact: set[str] | None = {""}
    queries: list = []
    runs: set[str] = {""}  # strings of the latest unbroken run
    for kind, value in nodes:
        strings, query = _node(kind, value)
        queries.append(query)
        if strings is None or len(runs) * len(strings) > _FEW:
            queries.append(_one_of(runs))
            runs, exact = {""} if strings is None else strings, None
        else:
            runs = {a + b for a in runs for b in strings}
            exact = None if exact is None else runs
    if exact is None:
        queries.append(_one_of(runs))
    return exact, _both(queries)


def _node(kind, value) -> tuple[set[str] | None, object]:
    if kind is op.LITERAL:
        return {chr(value).lower()}, None
    if kind is op.IN:
        if any(k is not op.LITERAL for k, _ in value):
            return None, None
        chars = {chr(v).lower() for _, v in value}
        return (chars if len(chars) <= 8 else None), None
    if kind is op.SUBPATTERN:
        return _walk(value[3])
    if kind is op.BRANCH:
        sides = [_walk(side) for side in value[1]]
        if all(s is not None for s, _ in sides):
            strings = set().union(*(s for s, _ in sides))
            if len(strings) <= _FEW:
                return strings, None
        parts = [_both([q, _one_of(s) if s is not None else None]) for s, q in sides]
        return None, None if any(p is None for p in parts) else Any_(tuple(dict.fromkeys(parts)))
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        least, most, body = value
        strings, query = _walk(body)
        if (least, most) == (0, 1) and strings is not None:
            return strings | {""}, None
        if least == 0:
            return None, None
        return None, _both([query, _one_of(strings) if strings is not None else None])
    return None, None


def trigram_query(pattern: str):
    """The query of a pattern, or None if it has no mandatory trigram."""
    exact, query = _walk(parser.parse(pattern))
    return _both([query, _one_of(exact) if exact is not None else None])
