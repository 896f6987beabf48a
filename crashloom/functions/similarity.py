"""Similarity of traces as a column expression, and a bound on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import DEPTH, SHIFT


def similarity(first: str, second: str) -> Column:
    return F.expr(similarity_sql(first, second))


def similarity_sql(first: str, second: str) -> str:
    """Position-dependent alignment of two array<string> columns, 1 for equal traces; null if one is empty.

    The best common subsequence, where a match at places i and j weighs
    exp(-(DEPTH * min(i, j) + SHIFT * |i - j|)), over the weight of a full match of the shorter.
    A row of the table is carried through an aggregate, so it runs in the JVM. If no frame is repeated within a trace and the
    common ones are in the same order, the best one has all of them, and their sum in that order is what the table comes to.
    """
    places = f"transform({first}, x -> coalesce(array_position({second}, x), 0L))"
    once = f"size(array_distinct({first})) = size({first}) and size(array_distinct({second})) = size({second})"
    ordered = f"aggregate({places}, 0L, (last, p) -> if(p = 0, last, if(last >= 0 and p > last, p, -1L))) >= 0"
    total = f"""aggregate(transform({first}, (x, i) -> named_struct('i', i + 1, 'p', coalesce(array_position({second}, x), 0L))), 0D, (s, y) ->
            if(y.p = 0, s, s + exp(-(least(y.i, y.p) * {DEPTH}D + abs(y.i - y.p) * {SHIFT}D))))"""
    return f"""if(size({first}) > 0 and size({second}) > 0,
        if({once} and {ordered}, {total}, aggregate(sequence(1, size({second})), array_repeat(0D, size({first}) + 1), (prev, i) ->
            aggregate(sequence(1, size({first})), array(0D), (cur, j) -> array_append(cur, greatest(
                element_at(cur, -1), element_at(prev, j + 1),
                element_at(prev, j) + if(element_at({first}, j) = element_at({second}, i), exp(-(least(i, j) * {DEPTH}D + abs(i - j) * {SHIFT}D)), 0D)))),
            r -> element_at(r, -1)))
        / aggregate(sequence(1, least(size({first}), size({second}))), 0D, (a, i) -> a + exp(-{DEPTH}D * i)), null)"""


def distance(first: str, second: str) -> Column:
    return 1 - similarity(first, second)


def upper_bound(first: str, second: str) -> Column:
    """A bound on the similarity that needs no table: each place of the shorter trace counts as if matched best, which is at its only place if the longer one repeats no frame."""
    sh, lo = f"if(size({first}) <= size({second}), {first}, {second})", f"if(size({first}) <= size({second}), {second}, {first})"
    shift = f"if(size(array_distinct({lo})) = size({lo}), {SHIFT}D, 0D)"
    return F.expr(f"""aggregate(sequence(1, size({sh})), named_struct('s', 0D, 'shift', {shift}), (acc, i) -> named_struct('s', acc.s + if(array_position({lo}, element_at({sh}, i)) > 0,
        exp(-({DEPTH}D * least(i, array_position({lo}, element_at({sh}, i))) + acc.shift * abs(i - array_position({lo}, element_at({sh}, i))))), 0D), 'shift', acc.shift), acc -> acc.s)
        / aggregate(sequence(1, size({sh})), 0D, (acc, i) -> acc + exp(-{DEPTH}D * i))""")
