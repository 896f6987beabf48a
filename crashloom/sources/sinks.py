"""Writers: reports, clusters, errors, triage outcomes and tracker payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import finding_description, finding_title, outcome_name, reproduction, security_tagged, tracker_severity


def write_reports(df: DataFrame, path: str) -> None:
    """Reports as JSON, a line each."""
    df.write.mode("errorifexists").json(path)


def write_clusters(df: DataFrame, path: str) -> None:
    """Members under cluster=<N>; cluster 0 holds repeats and is left out. A large cluster is several tasks' work and files."""
    df.where("cluster > 0").hint("rebalance", F.col("cluster")).write.partitionBy("cluster").json(path)


def write_split(df: DataFrame, good: str, bad: str, error: str = "parse_error") -> None:
    """Rows with an error go to a folder of their own, so none is lost. ``df`` should be a table: it is read twice."""
    df.where(F.col(error).isNull()).write.parquet(good)
    df.where(F.col(error).isNotNull()).write.json(bad)


def write_outcomes(df: DataFrame, path: str) -> None:
    """Crashes by where they go after triage."""
    df.write.partitionBy("outcome").parquet(path)


def tracker_payloads(findings: DataFrame, product: str, test: int, gdb_run: bool = False) -> DataFrame:
    """(finding_key, payload): what a tracker's upload would send; sending it is not a query.

    ``findings``: a report's columns and finding_key, and gdb, the class of the debugger's report, where there is one.
    """
    place = F.split("CrashLine", ":")
    ubsan = F.coalesce(F.size("UbsanReport"), F.lit(0)) > 0
    level = tracker_severity(F.col("CrashSeverity.Type"), ubsan)
    payload = F.struct(
        finding_title(F.lit(product), F.col("ExecutablePath"), F.col("CrashSeverity.ShortDescription"), F.col("CrashLine")).alias("title"),
        F.lit(True).alias("active"), F.lit(False).alias("verified"), F.lit(False).alias("static_finding"), F.lit(True).alias("dynamic_finding"), F.lit(test).alias("test"),
        level["number"].alias("numerical_severity"), level["name"].alias("severity"),
        F.when(security_tagged(F.col("ProcCmdline"), F.col("Stdin")), F.array(F.lit("security"))).alias("tags"), reproduction(F.col("ProcCmdline"), F.col("Stdin")).alias("steps_to_reproduce"),
        place[0].alias("file_path"), F.get(place, F.lit(1)).try_cast("int").alias("line"), F.array(F.lit(1)).alias("found_by"), F.substring_index("Date", "T", 1).alias("date"),
        finding_description(F.col("gdb") if "gdb" in findings.columns else None, gdb_run).alias("description"),
    )
    return findings.select("finding_key", F.to_json(payload).alias("payload"))


def write_seeds(seeds: DataFrame, path: str) -> None:
    """(name, content, outcome) under outcome=<where>, named after it where it has a folder of its own. The content comes last, as a file's bytes."""
    seeds.withColumn("name", outcome_name(F.col("name"), F.col("outcome"))).write.partitionBy("outcome").parquet(path)
