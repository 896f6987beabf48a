"""The operators for SQL users: functions and a table function registered with a session."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import formats
from .functions.fixed import NEAR_NULL
from .functions.frames import fold_mask
from .operators.instructions import classified
from .functions.severity import catalog
from .functions.similarity import similarity_sql
from .functions.text import crash_line
from .sources import reports


def _text(value: str) -> str:
    """A text as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: SQL functions by name: parameters, result and body.
FUNCTIONS = {
    "crash_similarity": ("first ARRAY<STRING>, second ARRAY<STRING>", "DOUBLE", similarity_sql("first", "second")),
    "crash_fingerprint": ("keys ARRAY<STRING>", "STRING", "sha2(to_json(keys), 256)"),
    "crash_line_without_column": ("line STRING", "STRING", r"regexp_replace(line, '(\\d+):\\d+$', '$1')"),
    "crash_ubsan_key": ("line STRING", "STRING", r"regexp_extract(line, '(.+:\\d+):\\d', 1)"),
    "crash_stem": ("name STRING", "STRING", r"regexp_replace(name, '(\\.gdb)?\\.casrep$', '')"),
    "crash_ubsan_count": ("log STRING", "INT", f"size(regexp_extract_all(log, {_text(formats.UBSAN_WARNING)}, 0))"),
    "crash_near_null": ("address DECIMAL(20,0)", "BOOLEAN", f"address < {NEAR_NULL}"),
}

#: Table functions by name: parameters, columns and body. They run in the JVM, and take columns of a table by LATERAL.
TABLES = {
    "crash_ubsan_warnings": ("log STRING", "nth INT, warning STRING", f"SELECT pos, col FROM (SELECT posexplode(regexp_extract_all(log, {_text(formats.UBSAN_WARNING)}, 0)))"),
    "crash_frames": ("keys ARRAY<STRING>", "nth INT, frame STRING", "SELECT pos, col FROM (SELECT posexplode(keys))"),
}


def register(spark: SparkSession) -> None:
    """crash_fold_mask, crash_instruction_class, those of FUNCTIONS and TABLES and the view severity_catalog."""
    spark.udf.register("crash_fold_mask", fold_mask)
    spark.udf.register("crash_instruction_class", classified)
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, (parameters, columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {body}")
    catalog(spark).createOrReplaceTempView("severity_catalog")


def report_views(spark: SparkSession, path: str, name: str = "reports", recursive: bool = False) -> None:
    """Views of the reports below a folder for SQL users, parsed and filtered: ``name`` with a row for each report and ``name``_frames with one for each frame.

    Reports have lang, keys, fingerprint, crash_line, environment (without entries that may tell who or where) and parse_error beside their own columns.
    """
    t = reports.traces(reports.read_reports(spark, path, recursive))
    t = t.withColumn("crash_line", crash_line(F.col("frames"))).withColumn("environment", reports.anonymised(F.col("ProcEnviron")))
    t.createOrReplaceTempView(name)
    each = t.select("file_path", F.posexplode("frames").alias("nth", "f"), "keys")
    each.select("file_path", "nth", F.get("keys", F.col("nth")).alias("key"), "f.address", "f.function", "f.module", "f.offset", "f.debug.file", "f.debug.line", "f.debug.column").createOrReplaceTempView(f"{name}_frames")
