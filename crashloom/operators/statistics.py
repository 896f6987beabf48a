"""The text that tells about a clustering: crashes of each cluster, how many are alike, and classes.

The text is a DataFrame of lines with their places, so no task or driver holds all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_prefix, summary_line, without_column
from .dedup import first_of

ORDER = ["part", "cluster", "key", "nth"]


def crashes(reports: DataFrame, prefix: str = "") -> DataFrame:
    """(cluster, stem, first, path, san, gdb): a row for each input, with what its sanitizer's and its debugger's report say.

    ``reports``: cluster, file_name, file_path, CrashSeverity, CrashLine, UbsanReport, _corrupt. A stem has one report of either
    kind; corrupt ones are none. san and gdb are struct<line, short, place, ubsan>, null without a report.
    """
    gdb = F.col("file_name").endswith(".gdb.casrep")
    path = strip_prefix(F.col("file_path"), prefix) if prefix else F.col("file_path")
    ubsan = F.coalesce(F.size("UbsanReport"), F.lit(0)) > 0
    line = F.when(F.trim("CrashLine") != "", F.col("CrashLine")).otherwise("")
    said = F.struct(
        summary_line(F.when(gdb, "gdb.casrep").otherwise("casrep"), F.col("CrashSeverity.Type"), F.col("CrashSeverity.ShortDescription"), line, path, ubsan).alias("line"),
        F.col("CrashSeverity.ShortDescription").alias("short"), line.alias("place"), ubsan.alias("ubsan"),
    )
    rows = reports.select("cluster", F.regexp_replace("file_name", r"(\.gdb)?\.casrep$", "").alias("stem"), "file_name", path.alias("path"), gdb.alias("g"), F.when(F.col("_corrupt").isNull(), said).alias("said"))
    return rows.groupBy("cluster", "stem").agg(F.min(F.struct("file_name", "path")).alias("x"), F.min(F.when(~F.col("g"), F.col("said"))).alias("san"), F.min(F.when(F.col("g"), F.col("said"))).alias("gdb")).select("cluster", "stem", F.col("x.file_name").alias("first"), F.col("x.path").alias("path"), "san", "gdb")


def statistics(reports: DataFrame, unique: bool = False, prefix: str = "") -> DataFrame:
    """(part, cluster, key, nth, line): the text, in order of these columns.

    Part 0 has for each cluster a heading (key null), its crashes, alike ones as one with their number, and its classes (in part 1 of
    the same cluster's ``nth``); part 1 the classes of all. With ``unique``, of crashes with one crash line, column
    aside, only the first counts over all clusters. Clusters of nothing but undefined-behaviour warnings are a line a warning.
    Inputs none of whose reports can be read are left out; see ``summary.corrupted``.
    """
    seen = crashes(reports, prefix).where("san is not null or gdb is not null")
    plain = seen.groupBy("cluster").agg(F.min(F.coalesce("san.ubsan", F.lit(True)) & F.col("gdb").isNull()).alias("ubsan"))
    if unique:
        place = F.coalesce(F.nullif("san.place", F.lit("")), F.col("gdb.place"), F.lit(""))
        seen = first_of(seen.withColumn("_line", without_column(place)), ("_line",), ("cluster", "first")).where("keep or _line = ''").drop("keep", "_line")
    text = lambda c: F.coalesce(c, F.lit(""))
    key = F.concat(text("san.short"), text("san.place"), text("gdb.short"), text("gdb.place"))
    shown = F.filter(F.array("san.line", "gdb.line"), lambda x: x.isNotNull())
    alike = seen.groupBy("cluster", key.alias("key")).agg(F.min(F.struct("first", "path", shown.alias("shown"))).alias("x"), F.count("*").alias("n")).join(plain, "cluster")
    one = F.array(F.concat_ws(": ", "x.path", F.get("x.shown", F.lit(0))))
    full = F.concat(F.array(F.concat(F.lit("Crash: "), "x.path")), F.transform("x.shown", lambda s: F.concat(F.lit("  "), s)), F.array(F.concat(F.lit("  Similar crashes: "), "n")))
    body = alike.select(F.lit(0).alias("part"), "cluster", F.concat(F.lit("1"), "key").alias("key"), F.posexplode(F.when(F.col("ubsan"), one).otherwise(full)).alias("nth", "line"))
    head = alike.select("cluster").distinct().select(F.lit(0).alias("part"), "cluster", F.lit("0").alias("key"), F.lit(0).alias("nth"), F.concat(F.lit("==> <cl"), "cluster", F.lit(">")).alias("line"))
    classes = seen.select("cluster", F.explode(F.filter(F.array("san.short", "gdb.short"), lambda x: x.isNotNull() & (x != ""))).alias("class")).groupBy("cluster", "class").agg(F.count("*").alias("n"))
    # a list has an entry for each class, whose number doesn't grow with the reports
    listed = lambda df, *by: df.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("class", "n"))), lambda x: F.concat(F.lit(" "), x["class"], F.lit(": "), x["n"])), "").alias("l"))
    foot = listed(classes, "cluster").join(plain.where("not ubsan"), "cluster").select(F.lit(0).alias("part"), "cluster", F.lit("2").alias("key"), F.lit(0).alias("nth"), F.concat(F.lit("Cluster summary ->"), "l").alias("line"))
    total = listed(classes.groupBy("class").agg(F.sum("n").alias("n"))).select(F.lit(1).alias("part"), F.lit(0).alias("cluster"), F.lit("").alias("key"), F.lit(0).alias("nth"), F.concat(F.lit("SUMMARY ->"), F.when(F.col("l") != "", F.col("l")).otherwise(" No crashes found")).alias("line"))
    return head.union(body).union(foot).union(total)


def write_statistics(lines: DataFrame, path: str) -> None:
    """The text's lines as text files whose names keep their order."""
    lines.orderBy(*ORDER).select("line").write.text(path)
