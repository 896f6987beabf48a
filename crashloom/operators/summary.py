"""Counts of crash classes, unique crash lines and results of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import without_column
from .dedup import first_of, free_names, ubsan_key


def class_summary(reports: DataFrame, cluster: str = "cluster", kind: str = "class") -> DataFrame:
    """(cluster, class, reports): counts for each class of each cluster, for each cluster (class null) and in all (both null)."""
    return reports.rollup(cluster, kind).agg(F.count("*").alias("reports"), F.grouping_id().alias("level"))


def similar_crashes(pairs: DataFrame) -> DataFrame:
    """(cluster, key, crashes): reports of a cluster whose sanitizer and debugger findings read the same.

    ``pairs``: cluster, san_desc, san_line, gdb_desc, gdb_line.
    """
    key = F.concat(*(F.coalesce(c, F.lit("")) for c in ("san_desc", "san_line", "gdb_desc", "gdb_line")))
    return pairs.groupBy("cluster", key.alias("key")).agg(F.count("*").alias("crashes"))


def unique_lines(reports: DataFrame, order: tuple[str, ...] = ("cluster", "file_name")) -> DataFrame:
    """The first report of each crash line (without its column) over all clusters; reports without a line stay."""
    line, keep = free_names(reports, "_line", "keep")
    keyed = reports.withColumn(line, without_column(F.col("crashline")))
    return first_of(keyed, (line,), order, keep).where(F.col(keep) | (F.col(line) == "")).drop(keep, line)


def _warning_key(warnings: DataFrame) -> Column:
    return F.coalesce(F.nullif(ubsan_key(F.col("crashline")), F.lit("")), F.col("crashline"))


def ubsan_dedup(warnings: DataFrame, order: tuple[str, ...] = ("input", "nth")) -> DataFrame:
    """The first warning of each file and line; warnings without a place stay."""
    key, keep = free_names(warnings, "_key", "keep")
    return first_of(warnings.withColumn(key, _warning_key(warnings)), (key,), order, keep).where(F.col(keep)).drop(keep, key)


def ubsan_dedup_counts(warnings: DataFrame) -> DataFrame:
    """(before, after): warnings in all, and those that a dedup leaves. Warnings of a key are counted before the shuffle."""
    return warnings.groupBy(_warning_key(warnings).alias("key")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("before"), F.count("*").alias("after"))


def run_results(outcomes: DataFrame) -> DataFrame:
    """(outcome, crashes) of a triage run."""
    return outcomes.groupBy("outcome").agg(F.count("*").alias("crashes"))


def corrupted(reports: DataFrame) -> DataFrame:
    """(corrupted): files that are no reports; a debugger's file counts only if the sanitizer's of the same stem is missing."""
    bad = reports.where("_corrupt is not null").withColumn("gdb", F.col("file_name").endswith(".gdb.casrep")).withColumn("stem", F.regexp_replace("file_name", r"(\.gdb)?\.casrep$", ""))
    siblings = reports.where(~F.col("file_name").endswith(".gdb.casrep")).select(F.regexp_replace("file_name", r"\.casrep$", "").alias("stem")).distinct()
    alone = bad.where("gdb").join(siblings, "stem", "left_anti").select("stem").union(bad.where("not gdb").select("stem"))
    return alone.agg(F.count("*").alias("corrupted"))
