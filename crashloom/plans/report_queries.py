"""Registered queries of log formats, report texts, triage and trackers over the adapter views, with their DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, frames, severity, text, traces
from ..operators import ignored
from ..operators import statistics as S
from ..operators import triage
from ..sources import sinks
from . import adapters as A
from .registry import query

#: The languages that events' logs are in, by event_id % 8, with a log, and the class, its description and the place that it tells; E is the event's number, L a line, C a column.
LOGS = [
    ("python", 'Traceback (most recent call last):\n  File "/lib/b.py", line 1, in main\n    g()\n  File "/app/a.py", line L, in f\n    x()\nValueError: bad E\n', "ValueError", "bad E", "/app/a.py:L", 2),
    ("java", 'Exception in thread "main" java.lang.RuntimeException: bad E\n\tat a.B.c(B.java:L)\n\tat a.B.d(Native Method)\n\tat a.B.main(B.java:7)\n', "java.lang.RuntimeException", "bad E", "B.java:L", 2),
    ("go", "panic: bad E\n\ngoroutine 1 [running]:\nmain.f(0x1)\n\t/src/m.go:L +0x1\nmain.main()\n\t/src/m.go:9 +0x2\n", "GoPanic", "bad E", "/src/m.go:L", 2),
    ("rust", "thread 'main' panicked at 'bad E', src/m.rs:L:C\nstack backtrace:\n   0: 0x55aa - m::f\n             at /src/m.rs:L:C\n   1: 0x55bb - m::main\n             at /src/m.rs:3:1\n", "RustPanic", "bad E", "/src/m.rs:L:C", 2),
    ("js", "/src/m.js:1\nReferenceError: bad E\n    at f (/src/m.js:L:C)\n    at Object.<anonymous> (/src/m.js:2:1)\n\n", "ReferenceError", "bad E", "/src/m.js:L:C", 2),
    ("csharp", "Unhandled exception. System.ArgumentException: bad E\n   at A.B() in /src/m.cs:line L\n   at A.Main() in /src/m.cs:line 4", "System.ArgumentException", "bad E", "/src/m.cs:L", 2),
    ("lua", "lua: m.lua:L: bad E\nstack traceback:\n\tm.lua:L: in function 'f'\n\tm.lua:8: in main chunk\n\t[C]: in ?\n", "bad E", "", "m.lua:L", 2),
    ("cpp", "terminate called after throwing an instance of 'std::runtime_error'\n  what():  bad E\n#0  0x1 in f (x=1) at /src/m.cpp:L\n#1  0x2 in main () at /src/m.cpp:5\n", "std::runtime_error", "bad E", "/src/m.cpp:L", 2),
]


def _literal(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


def _filled(t: str, duck: bool) -> str:
    """SQL of a log with the event's number, line and column; in the shape that the engine reads."""
    t = t.replace("\\", "\\\\") if not duck else t
    body = (_literal(t).replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") if duck else _literal(t).replace("''", "\\'").replace("\n", "\\n").replace("\t", "\\t"))
    for mark, value in (("bad E", "'bad ' || event_id"), ("line L", "'line ' || (user_id % 500 + 1)"), (":L", "':' || (user_id % 500 + 1)"), (":C", "':' || (event_id % 80 + 1)")):
        body = body.replace(mark, f"' || {value} || '")
    return f"({body})"


def _case(k: int, duck: bool) -> str:
    """A case over the language of an event, for the log (1), class (2), description (3) or place (4)."""
    return "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN {_filled(x[k], duck)}" for i, x in enumerate(LOGS)) + " END"


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, lang, log): events as the logs of programs in eight languages."""
    lang = F.element_at(F.array(*(F.lit(x[0]) for x in LOGS)), (F.col("event_id") % 8 + 1).cast("int"))
    return A.table(spark, sf_dir, "events").select("event_id", lang.alias("lang"), F.expr(_case(1, False)).alias("log"))


def _by_language(t: DataFrame, makers: dict, name: str) -> DataFrame:
    """``t`` with a column made of each log by its language's maker. Each language is a branch of its own: all makers in one expression are too long to be compiled."""
    out = None
    for lang, make in makers.items():
        part = t.where(F.col("lang") == lang).withColumn(name, make(F.col("log")))
        out = part if out is None else out.union(part)
    return out


@query(f"SELECT event_id, {_case(2, True)} AS short, {_case(3, True)} AS description FROM events")
def exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uncaught exception or panic that each log ends with."""
    makers = severity.EXCEPTIONS | {"lua": lambda c: severity.lua_severity(traces.lua_exception(c))}
    t = _by_language(logs(spark, sf_dir), {x[0]: makers[x[0]] for x in LOGS}, "e")
    return t.select("event_id", F.col("e.ShortDescription").alias("short"), F.col("e.Description").alias("description"))


@query(f"SELECT event_id, 2::BIGINT AS n_frames, {_case(4, True)} AS crashline FROM events")
def log_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each log's trace, extracted and parsed in its own format, and its crash line."""

    def parsed(lang: str):
        name = "gdb" if lang == "cpp" else lang
        return lambda c: frames.parse(traces.EXTRACTORS[name](c), name)

    t = _by_language(logs(spark, sf_dir), {x[0]: parsed(x[0]) for x in LOGS}, "p")
    return t.select("event_id", F.size("p.frames").cast("long").alias("n_frames"), text.crash_line(F.col("p.frames")).alias("crashline"))


@query("""SELECT event_id, CASE WHEN event_id % 8 = 2 THEN 'go' WHEN event_id % 8 = 3 THEN 'rust' END AS format FROM events""")
def log_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which format a log is in, found by trial."""
    return logs(spark, sf_dir).select("event_id", traces.log_format(F.col("log")).alias("format"))


@query("""SELECT event_id, 'sanitizer' AS run, CASE WHEN event_id % 2 = 0 THEN 'asan' ELSE 'msan' END AS format FROM events
UNION ALL SELECT event_id, 'program', CASE WHEN event_id % 8 = 2 THEN 'go' WHEN event_id % 8 = 3 THEN 'rust' WHEN event_id % 12 <> 0 THEN 'gdb' END FROM events""")
def log_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each run is analysed: by its sanitizer's log, its language's trace, or in the debugger if a signal ended it."""
    log = F.when(F.col("event_id") % 2 == 0, F.col("log")).otherwise(F.replace("log", F.lit("ERROR: AddressSanitizer:"), F.lit("WARNING: MemorySanitizer:")))
    sanitized = A.sanitizer_logs(spark, sf_dir).select("event_id", F.lit("sanitizer").alias("run"), traces.log_format(log, F.lit(6)).alias("format"))
    return sanitized.union(logs(spark, sf_dir).select("event_id", F.lit("program"), traces.log_format(F.col("log"), F.col("event_id") % 12)))


#: Functions and files that the lists of ignored frames do or don't name.
_NAMES = ["abort", "__asan_memcpy", "parse_it", "malloc", "scan_all", "std::process::abort", "my_malloc_user", "__libc_start_main"]
_IGNORED = "(0, 1, 3, 5, 7)"


@query(f"""WITH t AS (SELECT l_orderkey AS id, list(l_partkey % 8 ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem GROUP BY 1)
SELECT id, len(k)::BIGINT AS n_before, array_to_string([{_NAMES}[x + 1] FOR x IN k IF x NOT IN {_IGNORED}], ',') AS kept FROM t""")
def ignored_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' frames without those of runtimes, sanitizers and standard libraries."""
    names = "array(" + ", ".join(f"'{n}'" for n in _NAMES) + ")"
    t = A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.expr("transform(array_sort(collect_list(struct(l_linenumber, l_partkey, l_suppkey))), x -> cast(x.l_partkey % 8 as int))").alias("k"))
    t = t.withColumn("frames", F.transform("k", lambda x: frames.frame(function=F.element_at(F.expr(names), x + 1), file=F.lit("/src/m.c"), line=x)))
    kept = frames.filtered(F.col("frames"), fixed.CLUSTER_LANGS)
    return t.select("id", F.size("k").cast("long").alias("n_before"), F.array_join(F.transform(kept, lambda f: f["function"]), ",").alias("kept"))


def examples(kind: dict[str, list[str]]) -> list[str]:
    """For each expression of the lists a name that it finds: its own text without what stands for other texts."""
    plain = lambda p: re.sub(r"\\(.)", r"\1", re.sub(r"(?<!\\)\[[^\]]*\]", "x", re.sub(r"\(\|([^)]*)\)", r"\1", re.sub(r"\^|\$$|\.\*|(?<=\w)\?|(?<=/)\?", "", p))))
    return sorted({plain(p) for lang in fixed.CLUSTER_LANGS for p in kind.get(lang, [])})


_FUNCTIONS, _FILES = examples(fixed.IGNORED_FUNCTIONS), examples(fixed.IGNORED_FILES)


def _named(names: list[str], by: str, duck: bool) -> str:
    """SQL for a name of a list, chosen by a number: as it is, or with a letter before or behind it."""
    text = "[" + ", ".join(map(_literal, names)) + "]" if duck else "array(" + ", ".join("'" + n.replace("\\", "\\\\").replace("'", "\\'") + "'" for n in names) + ")"
    one = f"({text})[{by} % {len(names)}{' + 1' if duck else ''}]"
    return f"concat(CASE WHEN {by} % 5 = 1 THEN 'q' ELSE '' END, {one}, CASE WHEN {by} % 7 = 2 THEN 'q' ELSE '' END)"


_ALL = {kind: "|".join(f"({x})" for x in ignored.listed(lists, fixed.CLUSTER_LANGS)) for kind, lists in (("function", fixed.IGNORED_FUNCTIONS), ("file", fixed.IGNORED_FILES))}


@query(f"""WITH f AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, {_named(_FUNCTIONS, "(l_partkey * 3 + l_suppkey)", True)} AS fn, CASE WHEN l_partkey % 3 = 0 THEN {_named(_FILES, "(l_partkey + l_suppkey)", True)} ELSE '/app/m.c' END AS fl FROM lineitem),
b AS (SELECT DISTINCT fn, fl FROM f), j AS (SELECT fn, fl, NOT regexp_matches(fn, {_literal(_ALL["function"])}) AND NOT regexp_matches(fl, {_literal(_ALL["file"])}) AS stays FROM b)
SELECT id, count(*) AS n_before, coalesce(string_agg(fn || '@' || fl, ',' ORDER BY n, p, s) FILTER (stays), '') AS kept FROM f JOIN j USING (fn, fl) GROUP BY id""")
def ignored_by_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that are named after every expression of the ignore lists, and a letter beside it, without the ignored ones."""
    lines = A.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f"{_named(_FUNCTIONS, '(l_partkey * 3 + l_suppkey)', False)} as fn", f"if(l_partkey % 3 = 0, {_named(_FILES, '(l_partkey + l_suppkey)', False)}, '/app/m.c') as fl")
    one = "named_struct('function', x.fn, 'module', '', 'debug', named_struct('file', x.fl))"
    t = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.expr(f"transform(array_sort(collect_list(struct(l_linenumber, l_partkey, l_suppkey, fn, fl))), x -> {one})").alias("frames"))
    found = ignored.without_ignored(t.withColumn("n_before", F.size("frames").cast("long")))
    return found.select("id", "n_before", F.array_join(F.transform("frames", lambda f: F.concat(f["function"], F.lit("@"), f["debug"]["file"])), ",").alias("kept"))


@query("""SELECT event_id, CASE WHEN event_id % 8 = 7 THEN 'std::runtime_error' WHEN event_id % 8 = 3 THEN 'RustPanic' ELSE ['Undefined', 'AbortSignal', 'AccessViolation', 'TrapSignal', 'BadInstruction'][event_id % 5 + 1] END AS short,
CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN event_id + 1 WHEN 2 THEN event_id + 2 END AS pc, CASE event_id % 4 WHEN 0 THEN event_id + 3 WHEN 1 THEN event_id + 4 WHEN 2 THEN event_id + 5 END AS sp FROM events""")
def crash_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class that an exception or the signal gives a crash, and where its program counter and stack pointer stood, by processor."""
    t = logs(spark, sf_dir).withColumn("signal", F.element_at(F.array(*map(F.lit, (0, 6, 11, 5, 4))), (F.col("event_id") % 5 + 1).cast("int")))
    short = severity.overridden(severity.own_class(severity.signal_class(F.col("signal")), F.lit("")), F.col("log"))["ShortDescription"]
    t = t.withColumn("arch", F.element_at(F.array(*map(F.lit, ("amd64", "i386", "arm64", "riscv"))), (F.col("event_id") % 4 + 1).cast("int")))
    names = {"amd64": ("rip", "rsp"), "i386": ("eip", "esp"), "arm64": ("pc", "sp"), "riscv": ("ra", "a0")}
    at = lambda n: (F.col("event_id") + n).cast("decimal(20,0)")
    maps = [F.when(F.col("arch") == arch, F.create_map(F.lit(pc), at(i), F.lit(sp), at(i + 3))) for i, (arch, (pc, sp)) in enumerate(names.items())]
    t = t.withColumn("registers", F.coalesce(*maps))
    found = lambda f: f(F.col("arch"), F.col("registers")).cast("long")
    return t.select("event_id", short.alias("short"), found(severity.pc_register).alias("pc"), found(severity.sp_register).alias("sp"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'asan' WHEN 1 THEN 'python' WHEN 2 THEN 'csharp' WHEN 3 THEN 'asan' ELSE 'gdb' END AS lang FROM events""")
def report_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The format of a report's trace, by which of its parts are filled."""
    e, some, none = F.col("event_id") % 5, F.array(F.lit("x")), F.expr("cast(array() as array<string>)")
    filled = lambda *k: F.when(e.isin(*k), some).otherwise(none)
    t = A.table(spark, sf_dir, "events").select("event_id", filled(0).alias("AsanReport"), filled(3).alias("MsanReport"), filled(1, 3).alias("PythonReport"), filled(2).alias("CSharpReport"), F.lit(None).cast("array<string>").alias("GoReport"), filled(4).alias("UbsanReport"))
    return t.select("event_id", frames.dispatch(t.columns).alias("lang"))


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN CASE user_id % 4 WHEN 0 THEN 'HeapError' WHEN 1 THEN 'SafeFunctionCheck' WHEN 2 THEN 'StackGuard' ELSE 'AbortSignal' END WHEN 1 THEN 'TrapSignal' WHEN 2 THEN 'BadInstruction'
    WHEN 3 THEN CASE WHEN user_id * 1024 < 65536 THEN 'SegFaultOnPcNearNull' ELSE 'SegFaultOnPc' END WHEN 4 THEN 'SegFaultOnPc' WHEN 5 THEN 'AccessViolation' ELSE 'FPE' END AS short FROM events""")
def debugger_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the states that a debugger finds a program in."""
    k, at = F.col("event_id") % 7, (F.col("user_id") * 1024).cast("decimal(20,0)")
    signal = F.element_at(F.array(*map(F.lit, (fixed.SIGABRT, fixed.SIGTRAP, fixed.SIGILL, fixed.SIGSEGV, fixed.SIGBUS, fixed.SIGSEGV, fixed.SIGFPE))), (k + 1).cast("int"))
    calls = F.element_at(F.array(*(F.array(F.lit(f"#1 0x1 in {n} ()")) for n in ("__GI___libc_cfree", "__GI___chk_fail", "__stack_chk_fail", "raise"))), (F.col("user_id") % 4 + 1).cast("int"))
    pc, code = F.when(k == 3, at).otherwise(at + 1), F.when(k == 4, fixed.SI_KERNEL).otherwise(1)
    found = severity.debugger_short(signal, code, at, pc, F.when(k == 4, F.lit(b"")).otherwise(F.lit(b"\x90")), calls, F.lit(None).cast("string"))
    return A.table(spark, sf_dir, "events").select("event_id", found.alias("short"))


_SHORTS = ["SegFaultOnPc", "CallAvTainted", "double-free", "FPE", "GoPanic"]


@query(f"""WITH c(n, t, d, e) AS (VALUES {", ".join("(" + ", ".join(_literal(v) for v in (s[1], s[0], s[2], s[3])) + ")" for s in fixed.SEVERITIES)}), t AS (SELECT event_id, {_SHORTS}[event_id % 5 + 1] AS short FROM events)
SELECT event_id, CASE WHEN short = 'SegFaultOnPc' THEN '9.0' WHEN t = 'EXPLOITABLE' THEN '8.0' WHEN t = 'PROBABLY_EXPLOITABLE' THEN '6.0' ELSE '3.0' END AS number,
    'Severity: ' || t || chr(10) || 'Short description: ' || n || chr(10) || 'Description: ' || d || chr(10) || 'Explanation: ' || e AS said FROM t LEFT JOIN c ON n = short""")
def severity_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class's number in rule files and its text in reports, both null for a class that isn't in the catalog."""
    short = F.element_at(F.array(*map(F.lit, _SHORTS)), (F.col("event_id") % 5 + 1).cast("int"))
    t = severity.with_class(A.table(spark, sf_dir, "events").select("event_id", short.alias("short")), "short")
    number = severity.sarif_severity(F.coalesce("severity.Type", F.lit("")), F.col("short"))
    return t.select("event_id", number.alias("number"), severity.rendered(F.col("severity")).alias("said"))


@query("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls, doc_id % 9 + 1 AS pos FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, pos, unnest(ls) AS t, generate_subscripts(ls, 1) AS n FROM d), k AS (SELECT * FROM s WHERE n >= greatest(pos - 5, 1) AND n < greatest(pos - 5, 1) + 10)
SELECT doc_id, string_agg(CASE WHEN n = pos THEN '--->' ELSE '    ' END || rpad(n::VARCHAR, 6, ' ') || t, chr(10) ORDER BY n) AS excerpt FROM k GROUP BY doc_id""")
def source_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files with a crash in one of their first lines."""
    d = A.table(spark, sf_dir, "documents").where("text is not null")
    sources = d.select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("p", "text")).select("file", (F.col("p") + 1).alias("line"), "text")
    found = text.excerpts(d.select(F.col("doc_id").alias("report_id"), F.col("doc_id").alias("file"), (F.col("doc_id") % 9 + 1).alias("line")), sources)
    return found.select(F.col("report_id").alias("doc_id"), F.array_join("excerpt", "\n").alias("excerpt"))


@query("""SELECT p_partkey, 'mov eax, 1 ; at ' || p_partkey AS code, '0x' || lower(to_hex(p_partkey * 4096)) || ' 0x' || lower(to_hex(p_partkey * 4096 + 8192)) || ' 0x2000 0x' || lower(to_hex(p_partkey % 7)) || ' /lib/l' || p_partkey || '.so' AS map FROM part""")
def code_and_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disassembly without its labels, and a process's maps as a debugger shows them."""
    line = F.expr("concat('00', lower(hex(p_partkey * 4096)), '-', lower(hex(p_partkey * 4096 + 8192)), ' r-xp 0000', lower(hex(p_partkey % 7)), ' 08:02 173521   /lib/l', p_partkey, '.so')")
    code = F.expr("array(concat('mov eax, 1 <main+', p_partkey, '>; at ', p_partkey))")
    t = A.table(spark, sf_dir, "part")
    return t.select("p_partkey", text.clean_disassembly(code)[0].alias("code"), text.maps_table(F.array(F.lit("no map"), line))[0].alias("map"))


@query("""SELECT page_id, '/' || page_id || '/a/' || (page_id % 5) AS path, 'cl' || (page_id % 3) || '_in' || page_id || '_/src/a.c_' || page_id || '_2.casrep' AS warning,
    'prog_' || page_id || '.casrep' AS report, page_id::VARCHAR AS stem FROM pages""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of reports, and paths without their dots."""
    i = F.col("page_id").cast("string")
    path = F.concat(F.lit("/"), i, F.lit("/./b/../a/"), F.col("page_id") % 5)
    warning = text.ubsan_name(F.concat(F.lit("cl"), F.col("page_id") % 3), F.concat(F.lit("in"), i), F.concat(F.lit("/src/a.c:"), i, F.lit(":2")))
    name = F.concat(i, F.when(F.col("page_id") % 2 == 0, ".gdb.casrep").otherwise(".casrep"))
    return A.table(spark, sf_dir, "pages").select("page_id", text.normal_path(path).alias("path"), warning.alias("warning"), text.report_name(F.lit("/usr/bin/prog"), i).alias("report"), text.stem(name).alias("stem"))


_ARGV = ["/t/fuzz.py -a", "/opt/jazzer --cp=x @@", "node m.js", "npx jazzer m", "npx other m", "luajit m.lua", "/usr/bin/lua5 m.lua @@", "dotnet m.dll @@x", "/bin/target -f @@ z", "@@"]
_IN_PROCESS = ["python", "java", "js", "js", "S", "lua", "lua", "S", "S", "S"]
_FORKED = ["python", "S", "S", "S", "S", "S", "S", "csharp", "S", "S"]
_SEED = ["NULL", "2", "NULL", "NULL", "NULL", "NULL", "2", "2", "2", "NULL"]


def _sql_tool(names: list[str]) -> str:
    return "CASE event_id % 10 " + " ".join(f"WHEN {i} THEN " + ("CASE WHEN event_id % 3 = 0 THEN 'san' ELSE 'gdb' END" if n == "S" else f"'{n}'") for i, n in enumerate(names)) + " END"


@query(f"""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'san' WHEN event_id % 11 = 1 THEN 'gdb' ELSE {_sql_tool(_IN_PROCESS)} END AS in_process, {_sql_tool(_FORKED)} AS forked,
    (CASE event_id % 10 {" ".join(f"WHEN {i} THEN {n}" for i, n in enumerate(_SEED))} END)::INT AS seed FROM events""")
def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which analysis a crash gets by its command line, and where its seed goes."""
    argv = F.split(F.element_at(F.array(*map(F.lit, _ARGV)), (F.col("event_id") % 10 + 1).cast("int")), " ")
    symbols = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("__asan"))).otherwise(F.array(F.lit("main")))
    hint = F.when(F.col("event_id") % 11 == 0, "san").when(F.col("event_id") % 11 == 1, "gdb").otherwise("auto")
    return A.table(spark, sf_dir, "events").select("event_id", text.libfuzzer_tool(argv, symbols, hint).alias("in_process"), text.afl_tool(argv, symbols, F.lit("auto")).alias("forked"), text.seed_argument(argv).alias("seed"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'timeout-' || event_id WHEN 1 THEN 'oom-a-' || event_id ELSE 'crash-a-' || event_id END AS name FROM events""")
def outcome_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds renamed after their outcome."""
    i, k = F.col("event_id").cast("string"), F.col("event_id") % 3
    name = F.when(k == 0, F.concat(F.lit("id:1-"), i)).otherwise(F.concat(F.lit("crash-a-"), i))
    return A.table(spark, sf_dir, "events").select("event_id", text.outcome_name(name, F.when(k == 0, "timeout").when(k == 1, "oom").otherwise("error")).alias("name"))


def _tracker_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reports of a tracker's findings."""
    kinds = F.element_at(F.array(*map(F.lit, ("EXPLOITABLE", "PROBABLY_EXPLOITABLE", "NOT_EXPLOITABLE", "UNDEFINED"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    none, key = F.expr("cast(array() as array<string>)"), F.col("o_orderkey").cast("string")
    rows = A.table(spark, sf_dir, "orders").select("o_orderkey").distinct()
    return rows.select(
        key.alias("finding_key"), F.concat(F.lit("/src/f"), key, F.lit(".c:"), key, F.lit(":1")).alias("CrashLine"), F.lit("2024-05-06T07:08:09.000001+00:00").alias("Date"), F.lit("/bin/prog").alias("ExecutablePath"),
        F.concat(F.lit("/bin/prog "), F.when(F.col("o_orderkey") % 5 == 0, "-c out_of_bounds").otherwise("-x")).alias("ProcCmdline"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("/in/"), key)).otherwise("").alias("Stdin"),
        F.struct(kinds.alias("Type"), F.lit("SourceAv").alias("ShortDescription"), F.lit("d").alias("Description"), F.lit("e").alias("Explanation")).alias("CrashSeverity"),
        F.when(F.col("o_orderkey") % 7 == 0, F.array(F.lit("u1"), F.lit("u2"))).otherwise(none).alias("UbsanReport"), F.lit("Linux").alias("OS"), F.lit("6").alias("OSRelease"), F.lit("amd64").alias("Architecture"),
        *(none.alias(c) for c in ("Source", "AsanReport", "PythonReport", "GoReport", "RustReport")), F.array(F.lit("#0 f"), F.lit("#1 g")).alias("Stacktrace"), F.array(F.lit("A=1")).alias("ProcEnviron"),
    )


@query("""WITH t AS (SELECT DISTINCT o_orderkey AS k, ['EXPLOITABLE', 'PROBABLY_EXPLOITABLE', 'NOT_EXPLOITABLE', 'UNDEFINED'][o_orderkey % 4 + 1] AS kind, '/bin/prog ' || CASE WHEN o_orderkey % 5 = 0 THEN '-c out_of_bounds' ELSE '-x' END || CASE WHEN o_orderkey % 3 = 0 THEN ' < /in/' || o_orderkey ELSE '' END AS run FROM orders)
SELECT k::VARCHAR AS finding_key, '[shop] [prog] SourceAv in /src/f' || k || '.c:' || k || ':1' AS title, CASE WHEN k % 4 = 0 THEN 'S0' WHEN k % 4 = 1 THEN 'S1' WHEN k % 4 = 2 AND k % 7 <> 0 THEN 'S2' ELSE 'S3' END AS number,
    CASE WHEN k % 4 = 0 THEN 'Critical' WHEN k % 4 = 1 THEN 'High' WHEN k % 4 = 2 AND k % 7 <> 0 THEN 'Medium' ELSE 'Low' END AS level, CASE WHEN k % 5 = 0 THEN '["security"]' END AS tags, run AS steps, '/src/f' || k || '.c' AS file, k::VARCHAR AS line, '2024-05-06' AS date,
    '**Crash line:** /src/f' || k || '.c:' || k || ':1' || chr(10) || '**Severity:** ' || kind || ': SourceAv: d' || chr(10) || 'e' || chr(10) || '**Command:** ' || run || chr(10) || '**OS:** Linux 6' || chr(10) || '**Architecture:** amd64' || chr(10) || chr(10)
    || CASE WHEN k % 7 = 0 THEN '# UBSAN report' || chr(10) || chr(10) || '```' || chr(10) || 'u1' || chr(10) || 'u2' || chr(10) || '```' || chr(10) || chr(10) ELSE '' END
    || '# Stack trace' || chr(10) || chr(10) || '```' || chr(10) || '#0 f' || chr(10) || '#1 g' || chr(10) || '```' || chr(10) || chr(10) || '# Environment variables' || chr(10) || chr(10) || '```' || chr(10) || 'A=1' || chr(10) || '```' || chr(10) AS description FROM t""")
def tracker_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a tracker would be sent, read back from its JSON."""
    p = sinks.tracker_payloads(_tracker_reports(spark, sf_dir), "shop", 3)
    of = lambda path, name: F.get_json_object("payload", f"$.{path}").alias(name)
    return p.select("finding_key", of("title", "title"), of("numerical_severity", "number"), of("severity", "level"), of("tags", "tags"), of("steps_to_reproduce", "steps"), of("file_path", "file"), of("line", "line"), of("date", "date"), of("description", "description"))


@query("""WITH t AS (SELECT DISTINCT o_orderkey AS k, o_custkey % 2 AS p, o_orderkey % 4 AS s FROM orders) SELECT DISTINCT 'u:/src/f' || (k % 50) || '.c:' || (k % 7) AS finding_key FROM t WHERE p = 0 AND s <> 3""")
def known_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a tracker's findings that count as known: those that are active, false positives or out of scope."""
    t = A.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").distinct()
    state = F.col("o_orderkey") % 4
    findings = t.select(F.col("o_orderkey").alias("finding_id"), F.when(F.col("o_custkey") % 2 == 0, "a").otherwise("b").alias("product"), (state == 0).alias("active"), (state == 1).alias("false_p"), (state == 2).alias("out_of_scope"))
    reports = t.select(F.col("o_orderkey").alias("finding_id"), F.array(F.lit("u")).alias("UbsanReport"), F.concat(F.lit("/src/f"), F.col("o_orderkey") % 50, F.lit(".c:"), F.col("o_orderkey") % 7, F.lit(":3")).alias("CrashLine"), F.lit("f").alias("fingerprint"))
    return triage.known_findings(findings, reports, "a")


_DIRS = "t AS (SELECT DISTINCT l_orderkey AS id, '/d' || (l_orderkey % 9) AS dir, l_orderkey % 100 // 9 AS f, l_orderkey % 13 = 0 AS bad FROM lineitem)"


@query(f"WITH {_DIRS} SELECT dir, count(*) FILTER (NOT bad) AS before, count(DISTINCT f) FILTER (NOT bad) AS after, count(*) FILTER (bad) AS errors FROM t GROUP BY dir")
def folder_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a dedup within folders."""
    return triage.dedup_folders(_traced(spark, sf_dir))[1]


@query(f"WITH {_DIRS} SELECT dir, min(id) AS id FROM t WHERE NOT bad GROUP BY dir, f")
def folder_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a dedup within folders keeps: the first report of each trace."""
    return triage.dedup_folders(_traced(spark, sf_dir))[0].select("dir", F.expr("cast(substring(file_name, 1, 12) as bigint)").alias("id"))


def _traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    return t.select(F.concat(F.lit("/d"), F.col("id") % 9).alias("dir"), F.format_string("%012d.casrep", "id").alias("file_name"), F.floor(F.col("id") % 100 / 9).cast("string").alias("fingerprint"), F.when(F.col("id") % 13 == 0, "bad").alias("parse_error"))


@query("""WITH s AS (SELECT DISTINCT 'c' || o_orderkey AS name, '/seeds/c' || o_orderkey AS seed_path FROM orders WHERE o_orderkey % 2 = 0), r AS (SELECT DISTINCT 'cl' || (l_suppkey % 3) AS dir, 'c' || l_orderkey AS name FROM lineitem)
SELECT dir, name, seed_path FROM r JOIN s USING (name)""")
def seeds_beside_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inputs that belong beside the reports of each cluster."""
    reports = A.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("cl"), F.col("l_suppkey") % 3).alias("dir"), F.concat(F.lit("c"), F.col("l_orderkey"), F.when(F.col("l_linenumber") % 2 == 0, ".gdb.casrep").otherwise(".casrep")).alias("file_name"))
    name = F.concat(F.lit("c"), F.col("o_orderkey"))
    seeds = A.table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(name.alias("name"), F.concat(F.lit("/seeds/"), name).alias("seed_path")).distinct()
    return triage.seeds_of(reports, seeds)


@query("""SELECT doc_id, CASE WHEN doc_id % 10 < 7 THEN '/s' || CASE WHEN doc_id % 10 < 4 THEN 0 ELSE 1 END || '/p/C' || (doc_id % 10) || '.java' ELSE 'C' || (doc_id % 10) || '.java' END AS file FROM documents""")
def java_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files named in traces looked up in folders of sources, in order of the folders."""
    numbers = A.table(spark, sf_dir, "documents").select((F.col("doc_id") % 10).alias("k"))
    both = numbers.where("k < 4").select(F.lit(0).alias("nth"), "k").union(numbers.where("k < 7").select(F.lit(1), "k")).distinct()
    files = both.select(F.concat(F.lit("/s"), "nth", F.lit("/p/C"), "k", F.lit(".java")).alias("path"), "nth")
    return triage.locate_sources(A.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("C"), F.col("doc_id") % 10, F.lit(".java")).alias("file")), files)


_PLACE = "'/src/' || event_type || '.c:' || (event_id % 7 + 1) || ':' || (event_id % 3 + 1)"


@query(f"""WITH e AS (SELECT event_id, user_id % 12 + 1 AS cluster, lpad(event_id::VARCHAR, 12, '0') AS stem, event_type, {_PLACE} AS place, event_id % 4 <> 1 AS san, event_id % 3 = 0 OR event_id % 4 = 1 AS gdb, user_id % 12 = 5 AS ub FROM events),
c AS (SELECT cluster, stem, stem || CASE WHEN san THEN '.casrep' ELSE '.gdb.casrep' END AS first, '/r/' || stem || CASE WHEN san THEN '.casrep' ELSE '.gdb.casrep' END AS path, san, gdb AND NOT ub AS gdb, ub, event_type AS short, place FROM e WHERE san OR NOT ub),
l AS (SELECT *, CASE WHEN san THEN CASE WHEN ub THEN short || ': ' || place ELSE 'casrep: UNDEFINED: ' || short || ': ' || place END END AS sl, CASE WHEN gdb THEN 'gdb.casrep: UNDEFINED: ' || short || ': ' || place END AS gl FROM c),
k AS (SELECT cluster, ub, CASE WHEN san THEN short || place ELSE '' END || CASE WHEN gdb THEN short || place ELSE '' END AS key, min_by(path, first) AS path, min_by([x FOR x IN [sl, gl] IF x IS NOT NULL], first) AS shown, count(*) AS n FROM l GROUP BY 1, 2, 3),
b AS (SELECT cluster, '1' || key AS key, CASE WHEN ub THEN [path || ': ' || shown[1]] ELSE list_concat(list_concat(['Crash: ' || path], ['  ' || x FOR x IN shown]), ['  Similar crashes: ' || n]) END AS ls FROM k),
n AS (SELECT cluster, ub, short, sum(san::INT + gdb::INT) AS n FROM c GROUP BY 1, 2, 3 HAVING sum(san::INT + gdb::INT) > 0)
SELECT 0 AS part, cluster::BIGINT AS cluster, '0' AS key, 0 AS nth, '==> <cl' || cluster || '>' AS line FROM (SELECT DISTINCT cluster FROM c)
UNION ALL SELECT 0, cluster, key, generate_subscripts(ls, 1) - 1, unnest(ls) FROM b
UNION ALL SELECT 0, cluster, '2', 0, 'Cluster summary ->' || string_agg(' ' || short || ': ' || n, '' ORDER BY short) FROM n WHERE NOT ub GROUP BY cluster
UNION ALL SELECT 1, 0, '', 0, 'SUMMARY ->' || string_agg(' ' || short || ': ' || n, '' ORDER BY short) FROM (SELECT short, sum(n) AS n FROM n GROUP BY 1)""")
def cluster_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text about a clustering, for events as reports of sanitizers and debuggers; one cluster holds undefined-behaviour warnings only."""
    e = A.table(spark, sf_dir, "events").withColumn("cluster", F.col("user_id") % 12 + 1)
    san = e.where("event_id % 4 <> 1").withColumn("suffix", F.lit(".casrep"))
    gdb = e.where("(event_id % 3 = 0 or event_id % 4 = 1) and cluster <> 6").withColumn("suffix", F.lit(".gdb.casrep"))
    name = F.concat(F.lpad(F.col("event_id").cast("string"), 12, "0"), "suffix")
    place = F.concat(F.lit("/src/"), "event_type", F.lit(".c:"), F.col("event_id") % 7 + 1, F.lit(":"), F.col("event_id") % 3 + 1)
    kind = F.struct(F.lit("Undefined").alias("Type"), F.col("event_type").alias("ShortDescription"), F.lit("").alias("Description"), F.lit("").alias("Explanation"))
    rows = san.union(gdb).select("cluster", name.alias("file_name"), F.concat(F.lit("/r/"), name).alias("file_path"), kind.alias("CrashSeverity"), place.alias("CrashLine"), F.when(F.col("cluster") == 6, F.array(F.lit("u"))).otherwise(F.expr("cast(array() as array<string>)")).alias("UbsanReport"), F.lit(None).cast("string").alias("_corrupt"))
    return S.statistics(rows)


@query("""SELECT event_id, 'Date: 2024-05-06' || chr(10) || 'ExecutablePath: /bin/p' || (event_id % 3) || chr(10) || 'CrashLine: /src/m.c:' || (event_id % 9) || chr(10) || chr(10) || '===CrashSeverity===' || chr(10) || 'Severity: UNDEFINED' || chr(10) || 'Short description: ' || event_type || chr(10)
    || chr(10) || '===Stacktrace===' || chr(10) || '#0 f' || chr(10) || '#1 g' || event_id || CASE WHEN event_id % 2 = 0 THEN chr(10) || chr(10) || '===Registers===' || chr(10) || 'pc=0x' || lower(to_hex(event_id)) || chr(10) || 'sp=0x10' ELSE '' END
    || CASE WHEN event_id % 3 = 0 THEN chr(10) || chr(10) || '===Source===' || chr(10) || 's' ELSE '' END AS said FROM events""")
def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as text, with the parts that they have."""
    e = F.col("event_id")
    none = F.expr("cast(array() as array<string>)")
    registers = F.when(e % 2 == 0, F.create_map(F.lit("sp"), F.lit(16).cast("decimal(20,0)"), F.lit("pc"), e.cast("decimal(20,0)"))).otherwise(F.expr("cast(map() as map<string,decimal(20,0)>)"))
    t = A.table(spark, sf_dir, "events").select(
        "event_id", F.lit("2024-05-06").alias("Date"), F.lit("").alias("Uname"), F.concat(F.lit("/bin/p"), e % 3).alias("ExecutablePath"), F.concat(F.lit("/src/m.c:"), e % 9).alias("CrashLine"),
        F.struct(F.lit("UNDEFINED").alias("Type"), F.col("event_type").alias("ShortDescription"), F.lit("").alias("Description"), F.lit("").alias("Explanation")).alias("CrashSeverity"),
        F.array(F.lit("#0 f"), F.concat(F.lit("#1 g"), e)).alias("Stacktrace"), registers.alias("Registers"), F.when(e % 3 == 0, F.array(F.lit("s"))).otherwise(none).alias("Source"), none.alias("AsanReport"),
    )
    return t.select("event_id", text.report_text(t.columns).alias("said"))
