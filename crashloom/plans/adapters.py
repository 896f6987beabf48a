"""Views of the driver's tables as crash data: orders as traces, events as logs. Each has its DuckDB SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ordered(name: str) -> str:
    return f"transform(sort_array(collect_list(struct(l_linenumber, l_partkey, l_suppkey))), x -> {name})"


def coarse_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, keys): an order's lines as frames of twenty functions, so that many orders have equal traces."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.expr(_ordered("concat('f', x.l_partkey % 20)")).alias("keys"))


COARSE = "SELECT l_orderkey AS id, list('f' || (l_partkey % 20) ORDER BY l_linenumber, l_partkey, l_suppkey) AS keys FROM lineitem GROUP BY 1"


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, keys): an order's lines as frames named by their parts."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.expr(_ordered("concat('p', x.l_partkey)")).alias("keys"))


TRACES = "SELECT l_orderkey AS id, list('p' || l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS keys FROM lineitem GROUP BY 1"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, cluster, keys): orders clustered by customer."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("int").alias("cluster")).dropDuplicates(["id"])
    return traces(spark, sf_dir).join(orders, "id")


MEMBERS = f"SELECT id, cluster, keys FROM ({TRACES}) JOIN (SELECT o_orderkey AS id, min(o_custkey)::INT AS cluster FROM orders GROUP BY 1) USING (id)"


def frames(spark: SparkSession, sf_dir: str, distinct: bool = False) -> DataFrame:
    """(id, frames): an order's lines as frames with source positions; some lines occur twice."""
    one = "named_struct('address', cast(x.l_partkey as decimal(20,0)), 'function', concat('f', x.l_partkey % 20), 'module', '', 'offset', cast(0 as decimal(20,0)), 'debug', named_struct('file', concat('/src/part', x.l_partkey, '.c'), 'line', cast(x.l_linenumber as bigint), 'column', cast(x.l_suppkey as bigint)))"
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return (lines.distinct() if distinct else lines).groupBy(F.col("l_orderkey").alias("id")).agg(F.expr(_ordered(one)).alias("frames"))


#: The kinds of findings that events stand for, in order of their number.
KINDS = ["SEGV", "heap-buffer-overflow", "stack-overflow", "memcpy-param-overlap", "alloc-dealloc-mismatch", "BUS"]
ACCESS = ["READ of size 4 at", "WRITE of size 8 at", "The signal is caused by an"]


def sanitizer_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, log): each event as a sanitizer's report between other output."""
    kinds = "element_at(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), cast(event_id % 6 + 1 as int))"
    access = "element_at(array(" + ", ".join(f"'{k}'" for k in ACCESS) + "), cast(event_id % 3 + 1 as int))"
    log = f"""concat('started ', event_type, '\\n==7==ERROR: AddressSanitizer: ', {kinds}, ' on unknown address 0x', lower(hex(event_id * 97)), ' (pc 0x1)\\n', {access}, ' 0x1\\n    #0 0x1 in f',
        user_id % 10, '(int) const /src/', event_type, '.c:', user_id % 500 + 1, ':', event_id % 80 + 1, '\\n    #1 0x2 in main /src/main.c:3\\n\\nSUMMARY: AddressSanitizer: ', {kinds}, ' /src/', event_type, '.c in f\\n')"""
    return table(spark, sf_dir, "events").select("event_id", F.expr(log).alias("log"))


LOGS = f"""SELECT event_id, 'started ' || event_type || chr(10) || '==7==ERROR: AddressSanitizer: ' || {KINDS}[event_id % 6 + 1] || ' on unknown address 0x' || lower(to_hex(event_id * 97)) || ' (pc 0x1)' || chr(10)
    || {ACCESS}[event_id % 3 + 1] || ' 0x1' || chr(10) || '    #0 0x1 in f' || (user_id % 10) || '(int) const /src/' || event_type || '.c:' || (user_id % 500 + 1) || ':' || (event_id % 80 + 1) || chr(10)
    || '    #1 0x2 in main /src/main.c:3' || chr(10) || chr(10) || 'SUMMARY: AddressSanitizer: ' || {KINDS}[event_id % 6 + 1] || ' /src/' || event_type || '.c in f' || chr(10) AS log FROM events"""


def ubsan_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, log): a user's events as one log of warnings."""
    one = "concat('/src/', x.event_type, '.c:', x.event_id % 7 + 1, ':', x.event_id % 5 + 1, ': runtime error: bad ', x.event_type, '\\nnoise\\nSUMMARY: UndefinedBehaviorSanitizer: undefined-behavior ', x.event_type, '\\n')"
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.expr(f"array_join(transform(array_sort(collect_list(struct(event_id, event_type))), x -> {one}), '')").alias("log"))


UBSAN = """SELECT user_id, string_agg('/src/' || event_type || '.c:' || (event_id % 7 + 1) || ':' || (event_id % 5 + 1) || ': runtime error: bad ' || event_type || chr(10) || 'noise' || chr(10)
    || 'SUMMARY: UndefinedBehaviorSanitizer: undefined-behavior ' || event_type || chr(10), '' ORDER BY event_id, event_type) AS log FROM events GROUP BY user_id"""


def tracebacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, log): a conversation's turns as the calls of a Python traceback."""
    one = "concat('  File \"/app/', x.role, '.py\", line ', x.turn + 1, ', in turn_', x.turn, '\\n    call()\\n')"
    calls = f"array_join(transform(array_sort(collect_list(struct(turn, role))), x -> {one}), '')"
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.coalesce("turn", F.lit(0)).alias("turn"), F.coalesce("role", F.lit("none")).alias("role"))
    return turns.groupBy("conv_id").agg(F.expr(f"concat('Traceback (most recent call last):\\n', {calls}, 'ValueError: turns ', count(*), '\\n')").alias("log"))


TRACEBACKS = """SELECT conv_id, 'Traceback (most recent call last):' || chr(10) || string_agg('  File "/app/' || role || '.py", line ' || (turn + 1) || ', in turn_' || turn || chr(10) || '    call()' || chr(10), '' ORDER BY turn, role)
    || 'ValueError: turns ' || count(*) || chr(10) AS log FROM (SELECT conv_id, coalesce(turn, 0) AS turn, coalesce(role, 'none') AS role FROM conversations) GROUP BY conv_id"""
