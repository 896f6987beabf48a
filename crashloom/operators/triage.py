"""Whole steps of a triage run over tables of reports: dedup by folder, clusters with their counts, findings of a tracker, seeds and sources beside reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import clustering
from .dedup import dedup, dedup_crash_lines, finding_key


def dedup_folders(traced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, counts): of each folder the first report, by file name, of each trace; and (dir, before, after, errors).

    ``traced`` is what ``sources.reports.traces`` gives, as a table: it is read twice. Reports with an error are no repeats
    of each other and aren't kept; they are counted as errors.
    """
    good = traced.where("parse_error is null")
    each = traced.groupBy("dir", "fingerprint", F.col("parse_error").isNotNull().alias("bad")).agg(F.count("*").alias("n"))
    counts = each.groupBy("dir").agg(F.sum(F.when(~F.col("bad"), F.col("n")).otherwise(0)).alias("before"), F.count_if(~F.col("bad")).alias("after"), F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("errors"))
    return dedup(good, ("dir", "fingerprint"), ("file_name",)), counts


def cluster_reports(traced: DataFrame, offset: int = 0, unique_lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(clustered, counts): reports with their cluster, numbered from ``offset`` + 1; and (clusters, before, after).

    With ``unique_lines`` a report whose crash line an earlier one of its cluster has goes to cluster 0. Fewer than two
    reports, or fewer than two without an error, can't be clustered.
    """
    good = traced.where("parse_error is null")
    if good.limit(2).count() < 2:
        raise ValueError("clustering needs two reports that can be parsed")
    found = clustering.cluster(good, id="file_path", keys="keys").select(F.col("id").alias("file_path"), (F.col("cluster") + offset).alias("cluster"))
    out = good.join(found, "file_path")
    if unique_lines:
        out = dedup_crash_lines(out, "cluster", "CrashLine", ("file_name", "file_path"))
    return out, out.agg(F.count_distinct(F.nullif("cluster", F.lit(0))).alias("clusters"), F.count("*").alias("before"), F.count_if(F.col("cluster") > 0).alias("after"))


def snapshot_without_repeats(traced: DataFrame, path: str) -> DataFrame:
    """Writes the reports that ``dedup_folders`` keeps as a new snapshot under ``path``, a folder for each input folder; the input stays as it is. Returns the counts."""
    kept, counts = dedup_folders(traced)
    kept.write.partitionBy("dir").json(path)
    return counts


def known_findings(findings: DataFrame, reports: DataFrame, product: str) -> DataFrame:
    """(finding_key) of a product's active, false-positive and out-of-scope findings that a report is attached to.

    ``findings``: finding_id, product, active, false_p, out_of_scope; ``reports``: finding_id, UbsanReport, CrashLine, fingerprint.
    """
    own = findings.where(F.col("product") == product)
    kinds = [own.where("active"), own.where("not active and false_p"), own.where("not active and out_of_scope")]
    ids = kinds[0].select("finding_id").unionByName(kinds[1].select("finding_id")).unionByName(kinds[2].select("finding_id")).distinct()
    key = finding_key(F.size("UbsanReport") > 0, F.col("CrashLine"), F.col("fingerprint"))
    return reports.join(ids, "finding_id", "left_semi").select(key.alias("finding_key")).where("finding_key is not null").distinct()


def seeds_of(reports: DataFrame, seeds: DataFrame) -> DataFrame:
    """(dir, name, seed_path): the crash inputs that belong beside reports, by the reports' stems. ``reports``: dir, file_name; ``seeds``: name, seed_path."""
    stems = reports.select("dir", F.regexp_replace("file_name", r"(\.gdb)?\.casrep$", "").alias("name")).distinct()
    return stems.join(seeds.select("name", "seed_path"), "name").select("dir", "name", "seed_path")


def locate_sources(places: DataFrame, files: DataFrame) -> DataFrame:
    """``places`` (file, ...) with ``file`` as the first path in ``files`` (path, nth of its source folder) of the same base name, where there is one."""
    base = lambda c: F.regexp_extract(c, "([^/]+)$", 1)
    known = files.where(F.col("path").endswith(".java")).groupBy(base("path").alias("_base")).agg(F.min(F.struct("nth", "path")).alias("_x"))
    out = places.join(known, base(F.col("file")) == F.col("_base"), "left")
    return out.withColumn("file", F.coalesce("_x.path", "file")).drop("_base", "_x")
