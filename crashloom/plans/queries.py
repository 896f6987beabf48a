"""Registered queries of the crash operators over the adapter views, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, frames, severity, similarity, text, traces
from ..operators import clustering, dedup, incremental, ranges, sarif, summary
from ..operators.graph import cut
from ..operators.instructions import instruction_class
from ..sources.reports import anonymised, fold
from . import adapters as A
from .registry import ORACLE_SQL, QUERIES, query

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces without repeats, counted by their first frame."""
    kept = trace_dedup(spark, sf_dir)
    return kept.groupBy(F.substring_index("keys", ",", 1).alias("frame")).agg(F.count("*").alias("traces"))


def _fingerprinted(df: DataFrame) -> DataFrame:
    return df.withColumn("fingerprint", frames.fingerprint(F.col("keys")))


@query(f"SELECT min(id) AS id, array_to_string(keys, ',') AS keys, count(*) AS copies FROM ({A.COARSE}) GROUP BY keys")
def trace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _fingerprinted(A.coarse_traces(spark, sf_dir))
    copies = t.groupBy("fingerprint").agg(F.count("*").alias("copies"))
    return dedup.dedup(t, ("fingerprint",), ("id",)).join(copies, "fingerprint").select("id", F.array_join("keys", ",").alias("keys"), "copies")


@query("""SELECT l_orderkey AS id, sum(l_linenumber % 3 + 1)::BIGINT AS n_before, string_agg('d|/src/part' || l_partkey || '.c|' || l_linenumber || '|' || l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS folded
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem) GROUP BY 1""")
def trace_fold_period1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that call themselves once or twice are folded to one; an order's frames differ otherwise."""
    t = A.frames(spark, sf_dir, distinct=True).select("id", F.expr("flatten(transform(frames, f -> array_repeat(f, cast(f.debug.line % 3 as int) + 1)))").alias("calls"))
    return fold(t, "calls").select("id", F.size("calls").cast("long").alias("n_before"), F.array_join("keys", ",").alias("folded"))


@query()
def trace_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursion of any period folded in orders' traces."""
    t = fold(A.frames(spark, sf_dir).withColumn("frames", F.transform("frames", lambda f: F.struct(f["address"].alias("address"), f["function"].alias("function"), f["module"].alias("module"), f["offset"].alias("offset"), F.struct(F.regexp_extract(f["function"], r"(\d+)", 1).alias("file"), F.lit(0).cast("bigint").alias("line"), F.lit(0).cast("bigint").alias("column")).alias("debug")))), "frames")
    return t.select("id", F.size("frames").cast("long").alias("n_frames"), F.array_join("keys", ",").alias("keys"))


_CUT = r"^[A-Z][a-z]*ing |^Th"


@query(f"""WITH l AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
c AS (SELECT doc_id, source, CASE WHEN list_position([contains(x, 'sesame') FOR x IN l], true) > 0 THEN l[:list_position([contains(x, 'sesame') FOR x IN l], true)] ELSE l END AS l FROM l),
f AS (SELECT doc_id, [x FOR x IN l IF (x = '' OR NOT regexp_matches(x, '{_CUT}')) AND source <> 'src3'] AS l FROM c)
SELECT doc_id, len(l)::BIGINT AS n_frames, coalesce(l[1], '') AS first FROM f""")
def frame_filter_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as traces: lines are functions and sources are modules."""
    docs = A.table(spark, sf_dir, "documents").select("doc_id", "source", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("l"))
    f = docs.withColumn("frames", F.transform("l", lambda x: frames.frame(function=x, module=F.col("source"))))
    # no language's list applies here, so the user's expressions are all there is
    kept = frames.filtered(F.col("frames"), (), [_CUT], ["^src3$"], "sesame")
    return f.select("doc_id", kept.alias("k")).select("doc_id", F.size("k").cast("long").alias("n_frames"), F.coalesce(F.get("k", F.lit(0))["function"], F.lit("")).alias("first"))


@query("""WITH t AS (SELECT l_orderkey AS id, list('/src/part' || l_partkey || '.c:' || l_linenumber || CASE WHEN l_suppkey <> 0 THEN ':' || l_suppkey ELSE '' END ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem GROUP BY 1)
SELECT id, k[1] AS crashline, regexp_replace(k[1], '(\\d+):\\d+$', '\\1') AS short FROM t""")
def crash_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = text.crash_line(F.col("frames"))
    return A.frames(spark, sf_dir).select("id", line.alias("crashline"), text.without_column(line).alias("short"))


_CATALOG_SQL = ", ".join(f"('{s[1]}', '{s[0]}')" for s in fixed.SEVERITIES)


@query(f"""WITH l AS ({A.LOGS}), p AS (SELECT event_id, regexp_extract(log, 'SUMMARY: *(AddressSanitizer|libFuzzer): ([A-Za-z_()-]+)', 2) AS s,
    regexp_extract(string_split(log, chr(10))[3], '(READ|WRITE|ACCESS)', 1) AS rw, (event_id * 97) < 65536 AS nul, regexp_extract(log, '    #0 0x[0-9a-f]+ in ([^ ]+ const) ([^:]+):([0-9]+):([0-9]+)', ['f', 'file', 'l', 'c']) AS g FROM l),
k(n, t) AS (VALUES {_CATALOG_SQL}),
c AS (SELECT event_id, g, CASE WHEN s LIKE '%-param-overlap' THEN 'param-overlap' WHEN s IN ('SEGV', 'BUS') THEN CASE WHEN rw = 'READ' THEN 'SourceAv' || CASE WHEN nul THEN 'NearNull' ELSE '' END
    WHEN rw = 'WRITE' THEN 'DestAv' || CASE WHEN nul THEN 'NearNull' ELSE '' END ELSE 'AccessViolation' END WHEN s = 'stack-overflow' THEN 'StackOverflow'
    WHEN rw IN ('READ', 'WRITE') AND (s || '(' || lower(rw) || ')') IN (SELECT n FROM k) THEN s || '(' || lower(rw) || ')' ELSE s END AS short FROM p)
SELECT event_id, short, t AS kind, g['file'] || ':' || g['l'] || ':' || g['c'] AS crashline, 2::BIGINT AS n_frames FROM c LEFT JOIN k ON n = short""")
def san_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's report: carved out of its log, classified, its trace parsed and its crash line taken."""
    logs = A.sanitizer_logs(spark, sf_dir).withColumn("r", traces.sanitizer_report(F.col("log")))
    logs = logs.withColumn("short", severity.sanitizer_short(F.col("r.lines")))
    parsed = logs.withColumn("p", frames.parse(traces.asan_trace_of(F.col("r.lines")), "asan"))
    out = severity.with_class(parsed, "short")
    return out.select("event_id", "short", F.col("severity.Type").alias("kind"), text.crash_line(F.col("p.frames")).alias("crashline"), F.size("p.frames").cast("long").alias("n_frames"))


@query("""SELECT event_id, CASE WHEN event_id % 32 IN (4, 31) THEN 'BadInstruction' WHEN event_id % 32 = 5 THEN 'TrapSignal' WHEN event_id % 32 = 6 THEN 'AbortSignal' WHEN event_id % 32 IN (7, 11) THEN 'AccessViolation' ELSE 'Undefined' END AS short FROM events""")
def signal_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "events").select("event_id", severity.signal_class(F.col("event_id") % 32).alias("short"))


@query("SELECT l_suppkey, l_partkey, (l_partkey * l_suppkey) < 65536 AS near_null, count(*) AS frames FROM lineitem GROUP BY ALL")
def near_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey", severity.near_null(F.col("l_partkey") * F.col("l_suppkey")).alias("near_null")).agg(F.count("*").alias("frames"))


#: Similarity in SQL: each row of the table is a fold over the one before it.
_SIM = """list_reduce(list_prepend(list_transform(range(0, len(ka) + 1), lambda z: 0.0::DOUBLE), list_transform(range(1, len(kb) + 1), lambda i: list_transform(range(1, len(ka) + 1), lambda j:
    CASE WHEN ka[j] = kb[i] THEN exp(-(least(i, j) * 0.04::DOUBLE + abs(i - j) * 0.13::DOUBLE)) ELSE 0.0::DOUBLE END))),
    lambda prev, cost: list_reduce(list_prepend([0.0::DOUBLE], list_transform(range(1, len(cost) + 1), lambda j: [prev[j + 1], prev[j] + cost[j]])), lambda cur, e: list_append(cur, greatest(cur[len(cur)], e[1], e[2]))))[len(ka) + 1]
    / list_sum(list_transform(range(1, least(len(ka), len(kb)) + 1), lambda i: exp(-0.04::DOUBLE * i)))"""
_PAIRS = """f AS (SELECT DISTINCT id, unnest(keys) AS k FROM t), c AS (SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM f a JOIN f b ON a.k = b.k AND a.id < b.id),
p AS (SELECT id_a, id_b, x.keys AS ka, y.keys AS kb FROM c JOIN t x ON x.id = id_a JOIN t y ON y.id = id_b)"""


@query(f"WITH t AS ({A.TRACES}), {_PAIRS}, s AS (SELECT id_a, id_b, {_SIM} AS s FROM p) SELECT id_a, id_b, round(s, 6) AS similarity FROM s WHERE s > 0.500001")
def pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of orders' traces that are similar at more than one half."""
    pairs = clustering.candidate_pairs(cut(A.traces(spark, sf_dir), "traces"), 0.5)
    return pairs.select("id_a", "id_b", clustering.once(similarity.similarity("ka", "kb")).alias("s")).where("s > 0.500001").select("id_a", "id_b", F.round("s", 6).alias("similarity"))


@query(f"""WITH t AS ({A.MEMBERS}), p AS (SELECT a.cluster, a.keys AS ka, b.keys AS kb FROM t a JOIN t b ON a.cluster = b.cluster AND a.id < b.id), d AS (SELECT cluster, max(1 - {_SIM}) AS d FROM p GROUP BY 1)
SELECT cluster, count(*) AS size, round(coalesce(any_value(d), 0), 6) AS diameter FROM t LEFT JOIN d USING (cluster) GROUP BY 1""")
def cluster_diameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.diameters(A.members(spark, sf_dir)).select("cluster", "size", F.round("diameter", 6).alias("diameter"))


@query(f"""WITH m AS ({A.MEMBERS}), t AS (SELECT id, keys FROM m), {_PAIRS}, s AS (SELECT id_a, id_b, {_SIM} AS s FROM p), b AS (SELECT id_a AS i, id_b AS j, s FROM s UNION ALL SELECT id_b, id_a, s FROM s),
n AS (SELECT cluster, count(*) AS n FROM m GROUP BY 1), w AS (SELECT i, m.cluster AS oc, sum(s) AS s FROM b JOIN m ON m.id = j GROUP BY 1, 2),
o AS (SELECT m.id, m.cluster, n.n, (n.n - 1 - coalesce((SELECT w.s FROM w WHERE w.i = m.id AND w.oc = m.cluster), 0)) / nullif(n.n - 1, 0) AS a FROM m JOIN n USING (cluster)),
e AS (SELECT w.i, min(1 - w.s / n.n) AS b FROM w JOIN m ON m.id = w.i JOIN n ON n.cluster = w.oc WHERE w.oc <> m.cluster GROUP BY 1)
SELECT o.id, o.cluster, round(CASE WHEN o.n = 1 THEN 0 ELSE (coalesce(e.b, 1) - o.a) / greatest(o.a, coalesce(e.b, 1)) END, 6) AS silhouette FROM o LEFT JOIN e ON e.i = o.id""")
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.silhouettes(A.members(spark, sf_dir)).select("id", "cluster", F.round("silhouette", 6).alias("silhouette"))


@query()
def cluster_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(A.traces(spark, sf_dir))


@query()
def update_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of odd number are added to the clusters of the others."""
    t = A.traces(spark, sf_dir)
    old = t.where("id % 2 = 0")
    members = old.join(clustering.cluster(old), "id").select("id", "cluster", "keys", F.col("keys")[0].alias("crashline"))
    new = t.where("id % 2 = 1").select(F.col("id").alias("report_id"), "keys", F.col("keys")[0].alias("crashline"))
    return incremental.update(members, new, True)


_SPLIT = f"t AS (SELECT id, keys, CASE WHEN id % 14 = 7 THEN id - 1 ELSE id END AS name FROM ({A.COARSE})), n AS (SELECT * FROM t WHERE id % 2 = 1), o AS (SELECT * FROM t WHERE id % 2 = 0)"


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders of odd and of even number as reports; every seventh of the odd ones has the name of the one before it."""
    name = F.format_string("%012d.casrep", F.when(F.col("id") % 14 == 7, F.col("id") - 1).otherwise(F.col("id")).cast("bigint"))
    t = _fingerprinted(A.coarse_traces(spark, sf_dir)).withColumn("file_name", name)
    return t.where("id % 2 = 1"), t.where("id % 2 = 0")


@query(f"""WITH {_SPLIT}, k AS (SELECT min_by(id, name) AS id, min(name) AS name, keys FROM n WHERE keys NOT IN (SELECT keys FROM o) GROUP BY keys)
SELECT id, array_to_string(keys, ',') AS keys FROM k WHERE name NOT IN (SELECT name FROM o)""")
def merge_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = _halves(spark, sf_dir)
    return dedup.merge_new(new, old).select("id", F.array_join("keys", ",").alias("keys"))


@query(f"WITH {_SPLIT} SELECT min(id) AS id, array_to_string(keys, ',') AS keys FROM n WHERE keys NOT IN (SELECT keys FROM o) GROUP BY keys")
def diff_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = _halves(spark, sf_dir)
    return dedup.diff(new, old).select("id", F.array_join("keys", ",").alias("keys"))


_ROW = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(f"""WITH t AS (SELECT DISTINCT {_ROW}, l_suppkey % 50 + 1 AS cluster, CASE WHEN l_partkey % 7 = 0 THEN '' ELSE 'p' || l_partkey END AS crashline FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster, crashline ORDER BY {_ROW}) AS n FROM t) SELECT {_ROW}, crashline, CASE WHEN crashline <> '' AND n > 1 THEN 0 ELSE cluster END AS cluster FROM r""")
def crashline_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("l_partkey") % 7 == 0, "").otherwise(F.concat(F.lit("p"), F.col("l_partkey")))
    rows = A.table(spark, sf_dir, "lineitem").select(*_ROW.split(", "), (F.col("l_suppkey") % 50 + 1).alias("cluster"), line.alias("crashline")).distinct()
    return dedup.dedup_crash_lines(rows, order=tuple(_ROW.split(", ")))


@query("SELECT l_returnflag AS cluster, l_linestatus AS class, count(*) AS reports, grouping(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def class_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.class_summary(A.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cluster"), F.col("l_linestatus").alias("class")))


@query("""SELECT l_returnflag AS cluster, 'p' || (l_partkey % 9) || CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 's' || (l_suppkey % 4) END AS key, count(*) AS crashes FROM lineitem GROUP BY 1, 2""")
def similar_crashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cluster"), F.expr("concat('p', l_partkey % 9)").alias("san_desc"), F.expr("if(l_linenumber % 2 = 0, null, concat('s', l_suppkey % 4))").alias("san_line"), F.lit("").alias("gdb_desc"), F.lit(None).cast("string").alias("gdb_line"))
    return summary.similar_crashes(rows)


@query("""WITH g AS (SELECT l_orderkey AS stem, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), s AS (SELECT o_orderkey AS stem, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F')
SELECT coalesce(s.stem, g.stem) AS stem, s.status, g.n FROM s FULL OUTER JOIN g ON s.stem = g.stem""")
def pair_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    san = A.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("stem"), F.col("o_orderstatus").alias("status"))
    gdb = A.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("stem")).agg(F.count("*").alias("n"))
    return dedup.pair_reports(san, gdb).select("stem", "san.status", "gdb.n")


_KEYED = f"k AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'u:/src/' || keys[1] || '.c:' || len(keys) ELSE 't:' || sha256(to_json(keys)::VARCHAR) END AS finding_key FROM ({A.COARSE}))"


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _fingerprinted(A.coarse_traces(spark, sf_dir))
    line = F.concat(F.lit("/src/"), F.col("keys")[0], F.lit(".c:"), F.size("keys"), F.lit(":9"))
    return t.select("id", dedup.finding_key(F.col("id") % 3 == 0, line, F.col("fingerprint")).alias("finding_key"))


@query(f"WITH {_KEYED} SELECT id, finding_key FROM k")
def finding_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir)


@query(f"WITH {_KEYED} SELECT min(id) AS id, finding_key FROM k WHERE id % 4 <> 0 AND finding_key NOT IN (SELECT finding_key FROM k WHERE id % 4 = 0) GROUP BY finding_key")
def new_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _findings(spark, sf_dir)
    return dedup.new_findings(f.where("id % 4 <> 0"), f.where("id % 4 = 0"), order=("id",))


@query(f"""WITH l AS ({A.UBSAN}), w AS (SELECT user_id, unnest(regexp_extract_all(log, '.+: runtime error: [\\s\\S]*?SUMMARY: UndefinedBehaviorSanitizer: .*')) AS w, generate_subscripts(regexp_extract_all(log, '.+: runtime error: [\\s\\S]*?SUMMARY: UndefinedBehaviorSanitizer: .*'), 1) - 1 AS nth FROM l),
x AS (SELECT user_id, nth, regexp_extract(w, '^(.+?):(\\d+):(\\d+): runtime error: (.+)', 4) AS description, regexp_extract(w, '^(.+?:\\d+:\\d+): runtime error: ', 1) AS crashline FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY regexp_extract(crashline, '(.+:\\d+):\\d', 1) ORDER BY user_id, nth) AS n FROM x) SELECT user_id, nth::INT AS nth, description, crashline FROM r WHERE n = 1""")
def ubsan_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The warnings of all users' logs, the first of each place."""
    w = A.ubsan_logs(spark, sf_dir).select("user_id", F.posexplode(traces.ubsan_warnings(F.col("log"))).alias("nth", "w")).withColumn("l", F.split("w", "\n"))
    w = w.select("user_id", "nth", severity.ubsan_severity(F.col("l"))["Description"].alias("description"), text.ubsan_crash_line(F.col("l")).alias("crashline"))
    return summary.ubsan_dedup(w, ("user_id", "nth"))


@query("""SELECT event_id, array_to_string([e FOR e IN ['LANG=en', 'USER=' || user_id, upper(event_type) || '_TOKEN=' || event_id, 'HOME=/h/' || event_type, 'CI_' || event_id || '=1', 'PROPS=' || props]
    IF NOT regexp_matches(e, '^CI=|^HOSTNAME=|^LOGNAME=|^USERNAME=|^LANG=|^SESSION_MANAGER=|^XAUTHORITY=|^CI_|^GITLAB_|^FF_|^LC_|^SSH_|^XDG_|^GTK_|^GIO_|^DESKTOP_|^DBUS_|^GNOME_|^TERMINATOR_|^GPG_|^LS_COLORS=|^LESSCLOSE=|^LESSOPEN=|KEY|PASSWORD|TOKEN')], ' ') AS env FROM events""")
def env_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.expr("array('LANG=en', concat('USER=', user_id), concat(upper(event_type), '_TOKEN=', event_id), concat('HOME=/h/', event_type), concat('CI_', event_id, '=1'), concat('PROPS=', props))")
    return A.table(spark, sf_dir, "events").select("event_id", F.array_join(anonymised(entries), " ").alias("env"))


@query("""WITH m AS (SELECT p_partkey, p_partkey * 1000 AS b, p_partkey * 1000 + 100 + p_partkey % 900 AS e FROM part), f AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey * 1000 + (l_suppkey * 37) % 1000 AS address FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_partkey AS module, address - b AS off FROM f JOIN m ON address >= b AND address < e""")
def module_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses within the mappings that parts stand for."""
    maps = A.table(spark, sf_dir, "part").selectExpr("p_partkey as module", "p_partkey * 1000 as start", "p_partkey * 1000 + 100 + p_partkey % 900 as stop")
    points = A.table(spark, sf_dir, "lineitem").selectExpr(*_ROW.split(", "), "l_partkey * 1000 + (l_suppkey * 37) % 1000 as address").distinct()
    found = ranges.interval_join(points, maps, "address", "start", "stop")
    return found.select(*_ROW.split(", "), "module", ranges.module_offset(F.col("address"), F.col("start")).alias("off"))


@query(f"""WITH l AS ({A.TRACEBACKS}), p AS (SELECT conv_id, log, list_reverse(regexp_extract_all(log, 'File ".+", line \\d+, in .+')) AS f FROM l)
SELECT conv_id, len(f)::BIGINT AS n_frames, regexp_extract(f[1], 'in (.+)', 1) AS function, regexp_extract(f[1], '"(.+)"', 1) || ':' || regexp_extract(f[1], 'line (\\d+)', 1) AS crashline, 'ValueError' AS short, regexp_extract(log, 'ValueError: (.+)', 1) AS description FROM p""")
def python_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as Python tracebacks: frames, crash line and exception."""
    t = A.tracebacks(spark, sf_dir)
    t = t.withColumn("p", frames.parse(traces.python_trace(F.col("log")), "python")).withColumn("e", severity.python_exception(F.col("log")))
    return t.select("conv_id", F.size("p.frames").cast("long").alias("n_frames"), F.get("p.frames", F.lit(0))["function"].alias("function"), text.crash_line(F.col("p.frames")).alias("crashline"), F.col("e.ShortDescription").alias("short"), F.col("e.Description").alias("description"))


@query("""WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Error: Timeout' WHEN 1 THEN 'Out of memory: hard_rss_limit_mb exhausted' WHEN 2 THEN 'Program terminated (no crash)' WHEN 3 THEN '' ELSE 'failed on ' || event_type END AS e FROM events)
SELECT CASE WHEN contains(e, 'Timeout') THEN 'timeout' WHEN contains(e, 'Out of memory') THEN 'oom' WHEN contains(e, 'Program terminated (no crash)') THEN 'no_crash' WHEN e <> '' THEN 'error' ELSE 'report' END AS outcome, count(*) AS crashes FROM t GROUP BY 1""")
def triage_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr("case event_id % 5 when 0 then 'Error: Timeout' when 1 then 'Out of memory: hard_rss_limit_mb exhausted' when 2 then 'Program terminated (no crash)' when 3 then '' else concat('failed on ', event_type) end")
    return summary.run_results(A.table(spark, sf_dir, "events").select(text.outcome(said).alias("outcome")))


_CLASS_OF = "CASE l_suppkey % 5 WHEN 0 THEN 'SegFaultOnPc' WHEN 1 THEN 'double-free' WHEN 2 THEN 'Own' || (l_partkey % 3) WHEN 3 THEN 'FPE' ELSE 'GoPanic' END"


@query(f"""WITH t AS (SELECT {_CLASS_OF} AS short, min(l_orderkey) AS first FROM lineitem GROUP BY 1), c(n, pos) AS (VALUES {", ".join(f"('{s[1]}', {i})" for i, s in enumerate(fixed.SEVERITIES))}),
g AS (SELECT short, row_number() OVER (ORDER BY first, short) - 1 AS nth FROM t WHERE short NOT IN (SELECT n FROM c))
SELECT short, first, coalesce('F' || lpad(pos::VARCHAR, 2, '0'), 'G' || nth) AS rule_id FROM t LEFT JOIN c ON n = short LEFT JOIN g USING (short)""")
def sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.struct(F.expr(_CLASS_OF.replace("'Own' || (l_partkey % 3)", "concat('Own', l_partkey % 3)")).alias("ShortDescription")).alias("CrashSeverity"))
    return sarif.rule_ids(rows).select(F.col("ShortDescription").alias("short"), "first", "rule_id")


@query(f"""WITH t AS (SELECT DISTINCT {_ROW}, CASE WHEN l_partkey % 11 = 0 THEN '' ELSE '/src/p' || l_partkey || '.c:' || (l_suppkey % 3 + 1) || ':' || l_linenumber END AS crashline FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY regexp_replace(crashline, '(\\d+):\\d+$', '\\1') ORDER BY {_ROW}) AS n FROM t) SELECT {_ROW}, crashline FROM r WHERE n = 1 OR crashline = ''""")
def unique_crash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("if(l_partkey % 11 = 0, '', concat('/src/p', l_partkey, '.c:', l_suppkey % 3 + 1, ':', l_linenumber))")
    rows = A.table(spark, sf_dir, "lineitem").select(*_ROW.split(", "), line.alias("crashline")).distinct()
    return summary.unique_lines(rows, tuple(_ROW.split(", ")))


@query("""SELECT page_id, regexp_replace(CASE WHEN starts_with(p, '/en/') THEN substr(p, 5) WHEN p = '/en' THEN '' ELSE p END, 'x^', '') AS path FROM (SELECT page_id, coalesce(regexp_extract(url, '://[^/]*(/[^?#]*)', 1), '') AS p FROM pages)""")
def strip_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.coalesce(F.regexp_extract("url", r"://[^/]*(/[^?#]*)", 1), F.lit(""))
    return A.table(spark, sf_dir, "pages").select("page_id", text.strip_prefix(p, "/en").alias("path"))


_NEAR = "user_id * 1024 < 65536"


@query(f"""SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'ReturnAv' WHEN 1 THEN CASE WHEN {_NEAR} THEN 'CallAvNearNull' ELSE 'CallAv' END WHEN 2 THEN CASE WHEN {_NEAR} THEN 'DestAvNearNull' ELSE 'DestAv' END
    WHEN 3 THEN CASE WHEN {_NEAR} THEN 'SourceAvNearNull' ELSE 'SourceAv' END WHEN 4 THEN CASE WHEN {_NEAR} THEN 'SourceAvNearNull' ELSE 'CallAvTainted' END WHEN 5 THEN CASE WHEN {_NEAR} THEN 'BranchAvNearNull' ELSE 'BranchAv' END
    WHEN 6 THEN CASE WHEN {_NEAR} THEN 'SourceAvNearNull' ELSE 'DestAvTainted' END WHEN 7 THEN 'CallAvTainted' WHEN 8 THEN CASE WHEN {_NEAR} THEN 'DestAvNearNull' ELSE 'DestAv' END ELSE 'AccessViolation' END AS short FROM events""")
def instruction_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as memory faults in ten kinds of code: the sixth is for another processor and the seventh raised by the kernel."""
    code = F.expr("""case event_id % 10 when 0 then array('ret') when 1 then array('call rax') when 2 then array('mov dword ptr [rdi], eax') when 3 then array('cmovne eax, dword ptr [rsi]', 'ret')
        when 4 then array('mov rax, qword ptr [rbx]', 'add rax, 8', 'mov rcx, rax', 'call rcx') when 5 then array('jmp rdx') when 6 then array('ldr x0, [x1]', 'add x2, x0, #8', 'str x3, [x2]')
        when 7 then array('mov rax, qword ptr [rbx]', 'call rax') when 8 then array('rep movsb') else array('jmp 0x1234') end""")
    kind = F.col("event_id") % 10
    found = instruction_class(code, F.when(kind == 6, "arm64").otherwise("amd64"), (F.col("user_id") * 1024).cast("decimal(20,0)"), F.lit(1).cast("decimal(20,0)"), F.lit(fixed.SIGSEGV), F.when(kind == 7, fixed.SI_KERNEL).otherwise(1))
    return A.table(spark, sf_dir, "events").select("event_id", found.alias("short"))
