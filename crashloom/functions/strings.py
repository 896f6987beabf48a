"""White-space trimming: Spark's own trim only takes spaces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+\z", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` uses it: the optimizer copies plain expressions into each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
