"""Deduplication, set differences and finding keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores in front as keep it apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def first_of(df: DataFrame, key: Sequence[str], order: Sequence[str], flag: str = "keep") -> DataFrame:
    """``df`` with ``flag``: whether a row is the first of its key in ``order``.

    The first row of each key is found by an aggregate, which is combined before the
    shuffle, and joined back, so a key that most rows share isn't sorted in one task.
    Null keys are keys too; ``order`` must be unique within a key.
    """
    first, *names = free_names(df, "_first", *(f"_k{i}" for i in range(len(key))))
    low = df.groupBy(*(F.col(k).alias(n) for k, n in zip(key, names))).agg(F.min(F.struct(*order)).alias(first))
    on = F.lit(True)
    for k, n in zip(key, names):
        on = on & df[k].eqNullSafe(F.col(n))
    return df.join(low, on).withColumn(flag, F.struct(*order).eqNullSafe(F.col(first))).drop(first, *names)


def dedup(df: DataFrame, key: Sequence[str] = ("fingerprint",), order: Sequence[str] = ("file_name",)) -> DataFrame:
    """The first row of each key."""
    (keep,) = free_names(df, "keep")
    return first_of(df, key, order, keep).where(F.col(keep)).drop(keep)


def dedup_counts(df: DataFrame, scope: str, key: str, order: Sequence[str]) -> DataFrame:
    """(scope, before, after) of a dedup within each scope, such as a folder."""
    return df.groupBy(scope, key).agg(F.count("*").alias("n")).groupBy(scope).agg(F.sum("n").alias("before"), F.count("*").alias("after"))


def merge_new(new: DataFrame, old: DataFrame, key: str = "fingerprint", name: str = "file_name") -> DataFrame:
    """The first new row of each key that the old ones don't have, unless an old row has its name."""
    fresh = new.join(old.select(key).distinct(), key, "left_anti")
    return dedup(fresh, (key,), (name,)).join(old.select(name).distinct(), name, "left_anti").select(*new.columns)


def diff(new: DataFrame, old: DataFrame, key: str = "fingerprint", name: str = "file_name") -> DataFrame:
    """The first new row of each key that the old ones don't have."""
    return dedup(new.join(old.select(key).distinct(), key, "left_anti"), (key,), (name,)).select(*new.columns)


def dedup_crash_lines(df: DataFrame, cluster: str = "cluster", line: str = "crashline", order: Sequence[str] = ("file_name",)) -> DataFrame:
    """``df`` with cluster 0 for rows whose crash line an earlier row of the cluster has; empty lines are never repeats."""
    (keep,) = free_names(df, "keep")
    flagged = first_of(df, (cluster, line), order, keep)
    return flagged.withColumn(cluster, F.when((F.col(line) != "") & ~F.col(keep), F.lit(0)).otherwise(F.col(cluster))).drop(keep)


def ubsan_key(line: Column) -> Column:
    """file:line of a warning's crash line."""
    return F.regexp_extract(line, r"(.+:\d+):\d", 1)


def finding_key(ubsan: Column, line: Column, fingerprint: Column) -> Column:
    """A tracker's key: the place of an undefined-behaviour warning, else the trace's fingerprint."""
    return F.when(ubsan, F.concat(F.lit("u:"), F.substring_index(line, ":", 2))).otherwise(F.concat(F.lit("t:"), fingerprint))


def new_findings(found: DataFrame, known: DataFrame, key: str = "finding_key", order: Sequence[str] = ("report_id",)) -> DataFrame:
    """Of what the tracker doesn't know, the first report of each key."""
    return dedup(found.join(known.select(key).distinct(), key, "left_anti"), (key,), order).select(*found.columns)


def pair_reports(san: DataFrame, gdb: DataFrame, stem: str = "stem") -> DataFrame:
    """Sanitizer and debugger reports of the same input side by side."""
    left = san.select(stem, F.struct(*(c for c in san.columns if c != stem)).alias("san"))
    return left.join(gdb.select(stem, F.struct(*(c for c in gdb.columns if c != stem)).alias("gdb")), stem, "full_outer")


def without_sibling(seeds: DataFrame, reports: DataFrame, stem: str = "stem") -> DataFrame:
    """Crash inputs that no report is about."""
    return seeds.join(reports.select(stem).distinct(), stem, "left_anti")

