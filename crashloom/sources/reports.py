"""Readers: crash reports, cluster folders, logs, fuzzer output folders, ignore lists."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import StringType, StructField, StructType

from ..functions import fixed, frames
from ..functions.strings import strip
from .schemas import REPORT

_EMPTY_TEXT = {"string": "''", "array<string>": "array()"}


def with_defaults(df: DataFrame) -> DataFrame:
    """Missing text as '', missing lists as empty ones, a missing class as the undefined one."""
    undefined = F.struct(*(F.lit(v).alias(n) for v, n in zip(fixed.UNDEFINED, ("Type", "ShortDescription", "Description", "Explanation"))))
    out = {}
    for f in REPORT:
        kind = f.dataType.simpleString()
        if f.name == "CrashSeverity":
            out[f.name] = F.coalesce(f.name, undefined)
        elif kind in _EMPTY_TEXT:
            out[f.name] = F.coalesce(f.name, F.expr(f"cast({_EMPTY_TEXT[kind]} as {kind})"))
        else:
            out[f.name] = F.coalesce(f.name, F.expr(f"cast(map() as {kind})"))
    return df.withColumns(out)


def read_reports(spark: SparkSession, path: str, recursive: bool = False, suffix: str = "*.casrep") -> DataFrame:
    """One row per JSON report with file_path, file_name, dir and _corrupt, the text of a file that is no report.

    The schema is given, so files aren't read twice, and unknown keys are ignored.
    """
    schema = StructType([*REPORT.fields, StructField("_corrupt", StringType())])
    read = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", suffix).option("recursiveFileLookup", recursive)
    df = read.json(path).withColumns({"file_path": F.col("_metadata.file_path"), "file_name": F.col("_metadata.file_name")})
    return with_defaults(df.withColumn("dir", F.regexp_replace("file_path", "/[^/]*$", "")))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Reports in folders cl<N> with their cluster's number; other folders, such as those of errors, are left out."""
    df = read_reports(spark, path, recursive=True)
    number = F.regexp_extract("file_path", r"/cl(\d+)/[^/]*$", 1)
    return df.withColumn("cluster", F.when(number != "", number.cast("int"))).where("cluster is not null")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(log_id, text): a row for each file."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("log_id"), F.col("value").alias("text"))


def read_fuzzer_crashes(spark: SparkSession, path: str) -> DataFrame:
    """(node, name, seed_path, cmdline, vanilla) of ``<node>/crashes*/id*`` with the node's command line from ``<node>/cmdline``.

    A fuzzer that runs by itself has its crashes directly in the folder (vanilla): the folder is its node then. Empty files are no rows.
    """
    seeds = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "id*").load(path).select("path")
    p = r"/([^/]+)/crashes[^/]*/(id[^/]*)$"
    alone = F.col("path").rlike(re.escape(re.sub(r"^\w+:/*(?=/)", "", path).rstrip("/")) + r"/crashes[^/]*/id[^/]*$")
    seeds = seeds.where(F.col("path").rlike(p)).select(F.regexp_extract("path", p, 1).alias("node"), F.regexp_extract("path", p, 2).alias("name"), F.col("path").alias("seed_path"), alone.alias("vanilla"))
    lines = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="cmdline").select(F.regexp_extract("_metadata.file_path", r"/([^/]+)/cmdline$", 1).alias("node"), strip(F.col("value")).alias("cmdline"))
    return seeds.join(lines, "node", "left").select("node", "name", "seed_path", "cmdline", "vanilla")


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(name, seed_path) of ``crash-*`` and ``leak-*`` files, or of all visible files if the folder holds ``.metadata`` files."""
    files = spark.read.format("binaryFile").load(path).select("path").withColumn("name", F.regexp_extract("path", "([^/]+)$", 1))
    tracked = files.where(F.col("name").endswith(".metadata")).limit(1).select(F.lit(True).alias("tracked"))
    # at most one row, so that the broadcast's size doesn't depend on the folder
    both = files.join(F.broadcast(tracked), F.lit(True), "left")
    keep = F.when(F.col("tracked"), ~F.col("name").startswith(".")).otherwise(F.col("name").rlike("^(crash|leak)-"))
    return both.where(keep).select("name", F.col("path").alias("seed_path"))


def read_ignore_list(spark: SparkSession, path: str) -> DataFrame:
    """(kind, regex) of a file with FUNCTIONS and FILES sections, in either order.

    A section's own heading counts as one of its expressions. The file is one row, so
    order needs no shuffle.
    """
    lines = spark.read.text(path, wholetext=True).select(F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("l"))
    marks = F.transform(F.col("l"), lambda x, i: F.element_at(F.filter(F.slice("l", 1, i + 1), lambda y: y.isin("FUNCTIONS", "FILES")), -1))
    rows = lines.select(F.explode(F.arrays_zip(F.col("l").alias("regex"), marks.alias("kind"))).alias("x")).select("x.kind", "x.regex")
    return rows.where("kind is not null").select(F.when(F.col("kind") == "FUNCTIONS", "function").otherwise("file").alias("kind"), "regex")


def traces(reports: DataFrame, langs=fixed.CLUSTER_LANGS, functions=(), files=()) -> DataFrame:
    """``reports`` with lang, frames (filtered and folded), keys, fingerprint and parse_error.

    A report that can't be parsed, or of whose trace nothing is left, keeps its row with
    parse_error set, so that it can be put aside.
    """
    # each step is a column of its own: what is used more than once is not worked out again
    df = reports.withColumn("lang", frames.dispatch(reports.columns)).withColumn("_maps", frames.mappings(F.col("ProcMaps")))
    df = df.withColumn("_maps", frames.based(F.col("_maps"))).withColumn("_p", frames.parse_dispatched(F.col("Stacktrace"), F.col("lang")))
    df = df.withColumn("_e", frames.first_error(F.col("_p"))).withColumn("_f", frames.parsed_frames(F.col("_p")))
    df = df.withColumn("_f", frames.with_modules(F.col("_f"), F.col("_maps"))).withColumn("_f", frames.filtered(F.col("_f"), langs, functions, files))
    df = fold(df, "_f")
    error = F.when(F.col("_corrupt").isNotNull(), "not a report").otherwise(F.coalesce("_e", F.when(F.size("_f") == 0, "Current stack trace length is null")))
    return df.withColumn("parse_error", error).drop("_p", "_f", "_e", "_maps")


def fold(df: DataFrame, column: str) -> DataFrame:
    """``df`` with frames (recursion folded), keys and fingerprint of the frames in ``column``."""
    keys = frames.frame_keys(F.col(column))
    # filters on what follows must not pull the Python function into an expression's lambda
    df = df.withColumn("_m", frames.fold_mask.asNondeterministic()(keys)).withColumn("frames", frames.apply_mask(F.col(column), F.col("_m"))).drop("_m")
    df = df.withColumn("keys", frames.frame_keys(F.col("frames")))
    return df.withColumn("fingerprint", frames.fingerprint(F.col("keys")))


def anonymised(environ: Column) -> Column:
    """Environment entries without those that may tell who or where."""
    return F.filter(environ, lambda e: ~e.rlike("|".join(fixed.SENSITIVE_ENV)))
