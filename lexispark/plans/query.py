"""The query language: two dialects are read into one tree, which becomes one boolean column over a document's positions.

Dialect F has phrases and ordered proximity; B is boolean only. Both have juxtaposition as AND, ``!`` above ``&&`` above ``||``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexispark.functions.text import stem_text


@dataclass(frozen=True)
class Nothing:
    """Matches no document."""


@dataclass(frozen=True)
class Near:
    """Terms in order, the last at most ``distance`` after the first; as many as there are terms means side by side."""

    terms: tuple[str, ...]
    distance: int


@dataclass(frozen=True)
class Not:
    of: Node


@dataclass(frozen=True)
class And:
    left: Node
    right: Node


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node


@dataclass(frozen=True)
class Term:
    term: str


Node = Nothing | Term | Near | Not | And | Or

# What the two dialects take for phrases, numbers, operators and words.
_F_TOKEN = re.compile(r'"([^"]+)"|(\d+)|(&&|\|\||[!()/])|([^\s"&|!()/]+)')
_B_TOKEN = re.compile(r"(&&|\|\||[()]|!(?!=))|([A-Za-z0-9]+)")


def _term(words: list[str]) -> Node:
    return Term(words[0]) if words else Nothing()


def _near(words: list[str], distance: int | None) -> Node:
    if not words:
        return Nothing()
    if len(words) == 1:
        return Term(words[0])
    return Near(tuple(words), len(words) if distance is None else distance)


def _read_f(query: str) -> list[Node | str]:
    """Operands and operators. ``/ n`` binds to the phrase or word before it; other numbers and slashes are dropped."""
    found = [m.groups() for m in _F_TOKEN.finditer(query.replace("«", '"').replace("»", '"'))]
    out: list[Node | str] = []
    i = 0
    while i < len(found):
        phrase, number, sign, word = found[i]
        i += 1
        if phrase is None and word is None:
            if sign and sign != "/":
                out.append(sign)
            continue
        words = stem_text(phrase if phrase is not None else word)
        if i + 1 < len(found) and found[i][2] == "/" and found[i + 1][1] is not None:
            out.append(_near(words, int(found[i + 1][1])))
            i += 2
        else:
            out.append(_near(words, None) if phrase is not None else _term(words))
    return out


@dataclass(frozen=True)
class Policy:
    """What a dialect makes of queries that are not well formed. missing: what stands for an operand that is not there, if anything does;
    else an operator that lacks one is left out. closes: whether a closing bracket without an opening one closes all before it, or ends the query."""

    missing: Node | None
    closes: bool


def _descend(items: list[Node | str], policy: Policy) -> Node:
    """By precedence; juxtaposition is AND, and a bracket that is not closed is closed at the end."""
    at = 0

    def peek() -> Node | str | None:
        return items[at] if at < len(items) else None

    def took(sign: str) -> bool:
        nonlocal at
        if peek() != sign:
            return False
        at += 1
        return True

    def join(kind: type[And] | type[Or], left: Node | None, right: Node | None) -> Node | None:
        return kind(left, right) if left is not None and right is not None else right if left is None else left

    def factor() -> Node | None:
        nonlocal at
        if took("!"):
            inner = factor()
            return None if inner is None else Not(inner)
        if took("("):
            inner = either(None)
            took(")")
            return inner
        if isinstance(peek(), Node):
            at += 1
            return items[at - 1]
        return policy.missing

    def both(left: Node | None) -> Node | None:
        left = factor() if left is None else left
        while took("&&") or peek() in ("(", "!") or isinstance(peek(), Node):
            left = join(And, left, factor())
        return left

    def either(left: Node | None) -> Node | None:
        left = both(left)
        while took("||"):
            left = join(Or, left, both(None))
        return left

    out = either(None) if items else None
    while policy.closes and took(")"):
        # What was read so far is one operand of what follows.
        out = either(out)
    return Nothing() if out is None else out


def parse_f(query: str) -> Node:
    return _descend(_read_f(query), Policy(missing=None, closes=True))


def parse_b(query: str) -> Node:
    items = [s or Term(stem_text(w)[0]) for s, w in _B_TOKEN.findall(query)]
    return _descend(items, Policy(missing=Nothing(), closes=False))


def parse(query: str, dialect: str = "F") -> Node:
    return {"F": parse_f, "B": parse_b}[dialect](query)


def terms_of(node: Node) -> set[str]:
    match node:
        case Term(t):
            return {t}
        case Near(ts, _):
            return set(ts)
        case Not(x):
            return terms_of(x)
        case And(a, b) | Or(a, b):
            return terms_of(a) | terms_of(b)
    return set()


#: Operators of a postfix program; numbers from 0 put a leaf on the stack.
NOT, AND, OR, NOTHING = -1, -2, -3, -4


def postfix(node: Node) -> tuple[list[int], list[Term | Near]]:
    """A tree as a program for a stack, and its leaves, each once."""
    program: list[int] = []
    leaves: dict[Term | Near, int] = {}

    def put(x: Node) -> None:
        match x:
            case Term() | Near():
                program.append(leaves.setdefault(x, len(leaves)))
            case Not(of):
                put(of)
                program.append(NOT)
            case And(a, b) | Or(a, b):
                put(a)
                put(b)
                program.append(AND if isinstance(x, And) else OR)
            case _:
                program.append(NOTHING)

    put(node)
    return program, list(leaves)


def leaf_name(leaf: Term | Near) -> str:
    """A word is its term; a window has a name that no word has."""
    return leaf.term if isinstance(leaf, Term) else f"{leaf.distance} {' '.join(leaf.terms)}"


def placed_terms(node: Node) -> set[str]:
    """Terms of phrases and windows, which need positions."""
    match node:
        case Near(ts, _):
            return set(ts)
        case Not(x):
            return placed_terms(x)
        case And(a, b) | Or(a, b):
            return placed_terms(a) | placed_terms(b)
    return set()


def matches_without_terms(node: Node) -> bool:
    """Whether a document that holds none of the terms matches: only then are all documents needed."""
    match node:
        case Not(x):
            return not matches_without_terms(x)
        case And(a, b):
            return matches_without_terms(a) and matches_without_terms(b)
        case Or(a, b):
            return matches_without_terms(a) or matches_without_terms(b)
    return False


def near_column(positions: list[Column], distance: int) -> Column:
    """Whether ascending position lists hold the terms side by side, or in order within the distance; in time near linear in them.

    Side by side: the lists, each moved back by its term's place, have a position in common. In order: one pass over all positions
    keeps, for each number of first terms, the latest position that an ordered run of so many can begin at; that is the best.
    """
    count = len(positions)

    def moved(p: Column, k: int) -> Column:
        return F.transform(p, lambda x: x - k)

    def tagged(p: Column, k: int) -> Column:
        return F.transform(p, lambda x: F.struct(x.alias("at"), F.lit(-k).alias("term")))

    if distance == count:
        common = positions[0]
        for k, other in enumerate(positions[1:], 1):
            common = F.array_intersect(common, moved(other, k))
        return F.coalesce(F.size(common) > 0, F.lit(False))
    if distance < count - 1:
        return F.lit(False)

    # Later terms come first at one position, as no token serves twice.
    events = F.array_sort(F.concat(*(tagged(p, k) for k, p in enumerate(positions))))
    begin = F.struct(*(F.lit(None).cast("int").alias(f"s{k}") for k in range(count - 1)), F.lit(False).alias("hit"))

    def step(runs: Column, e: Column) -> Column:
        starts = [e["at"], *(runs[f"s{k}"] for k in range(count - 1))]  # what a run that gets its k-th term begins at
        kept = [F.when(e["term"] == -k, F.greatest(runs[f"s{k}"], starts[k])).otherwise(runs[f"s{k}"]).alias(f"s{k}") for k in range(count - 1)]
        done = (e["term"] == -(count - 1)) & F.coalesce(e["at"] - starts[-1] <= distance, F.lit(False))
        return F.struct(*kept, (runs["hit"] | done).alias("hit"))

    return F.coalesce(F.aggregate(events, begin, step, lambda runs: runs["hit"]), F.lit(False))


def to_column(node: Node, positions: dict[str, Column]) -> Column:
    match node:
        case Term(t):
            return positions[t].isNotNull()
        case Near(ts, d):
            return near_column([positions[t] for t in ts], d)
        case Not(x):
            return ~to_column(x, positions)
        case And(a, b):
            return to_column(a, positions) & to_column(b, positions)
        case Or(a, b):
            return to_column(a, positions) | to_column(b, positions)
    return F.lit(False)
