"""RCC-5 relations as sets of five bits, and their algebra as column expressions."""

from __future__ import annotations

from functools import reduce
from itertools import chain, combinations, product

from pyspark.sql import Column, functions as F

# One bit for each base relation, and the named unions.
LT, GT, EQ, DISJOINT, OVERLAP = 1, 2, 4, 8, 16
LE, GE, COMPARABLE = LT | EQ, GT | EQ, LT | EQ | GT
INTERSECT = LT | GT | EQ | OVERLAP
NEQ = LT | GT | DISJOINT | OVERLAP
NOINFO = 31
SYMBOLS = {
    LT: "<", GT: ">", EQ: "=", DISJOINT: "!", OVERLAP: "><",
    LE: "<=", GE: ">=", COMPARABLE: "<=>", INTERSECT: "not!", NEQ: "not=", NOINFO: "?",
    0: "⋕", LT | DISJOINT: "<!", GT | DISJOINT: ">!",
}
ALIASES = {"!=": NEQ, "∩": INTERSECT, "{}": 0}
_BASE = (LT, GT, EQ, DISJOINT, OVERLAP)


def symbol_of(code: int) -> str:
    """Text of a relation; unnamed unions list their members in braces."""
    named = SYMBOLS.get(code)
    return named or "{" + " ".join(SYMBOLS[b] for b in _BASE if code & b) + "}"


def relation_of(s: set, t: set) -> int:
    """Relation of two nonempty sets."""
    if s == t:
        return EQ
    return LT if s < t else GT if s > t else OVERLAP if s & t else DISJOINT


def _composition_table() -> list[int]:
    """What A?C can be for every A?B and B?C, by all ways in which three sets can share points.

    A point is told by the sets it is in, so there are seven kinds of points, and a way is a
    choice of kinds that occur.
    """
    base = dict.fromkeys(product(_BASE, repeat=2), 0)
    kinds = [k for k in product((False, True), repeat=3) if any(k)]
    for n in range(1, len(kinds) + 1):
        for points in combinations(kinds, n):
            a, b, c = ({p for p in points if p[i]} for i in range(3))
            if a and b and c:
                base[relation_of(a, b), relation_of(b, c)] |= relation_of(a, c)
    return [reduce(int.__or__, (base[r, s] for r in _BASE for s in _BASE if i & r and j & s), 0) for i in range(32) for j in range(32)]


COMPOSE = _composition_table()


def _lookup(pairs: dict) -> Column:
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(pairs.items())])


def symbol(relation: Column) -> Column:
    return F.try_element_at(_lookup({c: symbol_of(c) for c in range(32)}), relation)


def parse(text: Column) -> Column:
    """Relation code of a symbol; NULL when the text is none."""
    names = {symbol_of(c): c for c in range(32)} | ALIASES
    return F.try_element_at(_lookup(names), text)


def reverse(relation: Column) -> Column:
    less, more = relation.bitwiseAND(F.lit(LT)), relation.bitwiseAND(F.lit(GT))
    rest = relation.bitwiseAND(F.lit(EQ | DISJOINT | OVERLAP))
    return (rest + less * 2 + F.shiftright(more, 1)).cast("int")


def compose(first: Column, second: Column) -> Column:
    """What x?z can be when x-first-y and y-second-z."""
    table = F.array(*[F.lit(c) for c in COMPOSE])
    return F.element_at(table, (first * 32 + second + 1).cast("int"))


def both(first: Column, second: Column) -> Column:
    """Relation supported by two pieces of evidence."""
    return first.bitwiseAND(second)


def members(relation: Column) -> Column:
    """Base relations in a union, in the order < > = ! ><."""
    return F.filter(F.array(*[F.lit(b) for b in _BASE]), lambda b: relation.bitwiseAND(b) != 0)


def within(relation: Column, union: int) -> Column:
    """True when every base relation of ``relation`` is in ``union``."""
    return relation.bitwiseAND(F.lit(NOINFO ^ union)) == 0


# -- labelled edges (predicates): relation, target, number of steps, note --


def predicate(relation: Column, target: Column, span: Column, note: Column) -> Column:
    return F.struct(relation.alias("relation"), target.alias("target"),
                    span.alias("span"), note.alias("note"))


def reverse_note(note: Column) -> Column:
    back = F.lit("←")
    return (F.when(note == "", note)
            .when(note.startswith("←"), F.substr(note, F.lit(2)))
            .otherwise(F.concat(back, note)))


def reverse_predicate(origin: Column, p: Column) -> Column:
    return predicate(reverse(p["relation"]), origin, p["span"], reverse_note(p["note"]))


def compose_notes(a: Column, b: Column) -> Column:
    return F.when(a == "", b).when((b == "") | (a == b), a).otherwise(F.concat_ws("; ", a, b))


def _is_identity(p: Column) -> Column:
    return (p["relation"] == EQ) & (p["note"] == "")


def compose_predicates(p: Column, q: Column) -> Column:
    joined = predicate(compose(p["relation"], q["relation"]), q["target"],
                       p["span"] + q["span"], compose_notes(p["note"], q["note"]))
    return F.when(_is_identity(p), q).when(_is_identity(q), p).otherwise(joined)
