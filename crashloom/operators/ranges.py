"""Range join of addresses with mapped intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Half of the unsigned 64-bit numbers: with it taken off, addresses are signed ones in the same order.
HALF = str(1 << 63)


def _signed(c: Column) -> Column:
    return (c.cast("decimal(20,0)") - F.lit(HALF).cast("decimal(20,0)")).cast("long")


#: Cells that are joined by sorting at least; below, the optimizer may send them to all tasks.
MANY = 100_000

#: The largest even power of two that is no longer than [_lowest, _highest); a length beyond signed numbers has the largest, 62.
_LEVEL = "coalesce(least(62, (length(bin(try_subtract(_highest, _lowest))) - 1) div 2 * 2), 62)"


def dyadic(intervals: DataFrame, start: str, stop: str, level: str = "_level", cell: str = "_cell") -> DataFrame:
    """``intervals`` with a row for each aligned cell of 2^level that one meets, the level being even and 2^level no longer than the interval: five rows at most."""
    ends = intervals.withColumns({"_lowest": _signed(F.col(start)), "_highest": _signed(F.col(stop))}).where("_lowest < _highest")
    ends = ends.withColumn(level, F.expr(f"cast({_LEVEL} as int)"))
    cells = F.explode(F.expr(f"sequence(shiftright(_lowest, {level}), shiftright(_highest - 1, {level}))"))
    return ends.withColumn(cell, cells).select(*intervals.columns, level, cell)


def interval_join(points: DataFrame, intervals: DataFrame, point: str, start: str, stop: str, by: Sequence[str] = ()) -> DataFrame:
    """Pairs with start <= point < stop and equal columns ``by``, such as a program; intervals may overlap and be of any width.

    An interval meets five aligned cells at most, of the largest even power of two that is no longer than it. A point is in one cell of each length, so it is listed once
    for each length that occurs (32 at most) and meets the intervals of its cells, of which those that hold it stay: no width has to be known,
    and a large interval is as cheap as a small one. Ends are unsigned 64-bit numbers; an interval without a length, and nulls, meet nothing.
    """
    cells = dyadic(intervals.withColumns({"_from": _signed(F.col(start)), "_to": _signed(F.col(stop))}), start, stop)
    # one row of 32 numbers at most; a size that the optimizer guesses from files misses what explode makes of them
    levels, n = cells.agg(F.sort_array(F.collect_set("_level")), F.count("*")).first()
    cells = cells.hint("merge") if n >= MANY else cells
    listed = points.where(F.col(point).isNotNull()).withColumn("_level", F.explode(F.lit(levels).cast("array<int>"))).withColumn("_p", _signed(F.col(point)))
    listed = listed.withColumn("_cell", F.expr("shiftright(_p, _level)")).drop("_p")
    at = _signed(listed[point])
    return listed.join(cells, [*by, "_level", "_cell"]).where((F.col("_from") <= at) & (at < F.col("_to"))).drop("_level", "_cell", "_from", "_to")


def module_offset(address: Column, start: Column) -> Column:
    return address - start
