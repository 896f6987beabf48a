"""Crash lines, excerpts, names and other text of reports, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import formats
from .frames import PARSERS
from .strings import let, strip


def crash_line(frames: Column) -> Column:
    """``file[:line[:column]]`` or ``module+0xoffset`` of the first frame; null if it has neither."""
    return let(F.get(frames, F.lit(0)), frame_line)


def frame_line(f: Column) -> Column:
    d = f["debug"]
    source = F.concat(d["file"], F.when(d["line"] != 0, F.concat(F.lit(":"), d["line"], F.when(d["column"] != 0, F.concat(F.lit(":"), d["column"])).otherwise(""))).otherwise(""))
    return F.when(d["file"] != "", source).when((f["module"] != "") & (f["offset"] != 0), F.concat(f["module"], F.lit("+0x"), F.lower(F.conv(f["offset"].cast("string"), 10, 16))))


def without_column(line: Column) -> Column:
    """A crash line cut after its line number."""
    return F.regexp_replace(line, r"(\d+):\d+$", "$1")



def ubsan_crash_line(lines: Column) -> Column:
    """A warning's place: the file of its first frame, with line and column of its header where it has them."""
    number = lambda c: F.coalesce(c.try_cast("bigint"), F.lit(0))
    place = lambda file, l, c: F.concat(file, F.when(l != 0, F.concat(F.lit(":"), l, F.when(c != 0, F.concat(F.lit(":"), c)).otherwise(""))).otherwise(""))

    def read(ls: Column) -> Column:
        head = F.get(ls, F.lit(0))
        top = F.filter(F.slice(ls, 2, F.greatest(F.size(ls), F.lit(1))), lambda x: x.startswith("    #0 "))
        return F.struct(
            head.rlike(formats.UBSAN_PLACE).alias("known"), F.regexp_extract(head, formats.UBSAN_PLACE, 1).alias("file"), number(F.regexp_extract(head, formats.UBSAN_PLACE, 2)).alias("line"), number(F.regexp_extract(head, formats.UBSAN_PLACE, 3)).alias("column"),
            F.get(PARSERS["asan"](F.slice(top, 1, 1)), F.lit(0)).alias("top"),
        )

    def choose(x: Column) -> Column:
        frame = F.when(x["top"]["e"].isNull(), x["top"]["f"])
        d = frame["debug"]
        own = F.when(x["known"], place(x["file"], x["line"], x["column"]))
        both = place(d["file"], F.when(x["known"] & (x["line"] != 0), x["line"]).otherwise(d["line"]), F.when(x["known"] & (x["column"] != 0), x["column"]).otherwise(d["column"]))
        return F.when(d["file"] != "", both).otherwise(F.coalesce(own, crash_line(F.array(frame))))

    return let(let(lines, read), choose)


def lua_crash_line(exception: Column) -> Column:
    lines = F.transform(F.split(exception, "\n"), lambda x: strip(x))
    p = r"(.+):(\d+):"
    head = F.get(lines, F.lit(0))
    direct = F.when(head.rlike(r"\S+: (.+):(\d+):"), F.concat_ws(":", F.regexp_extract(head, r"\S+: (.+):(\d+):", 1), F.regexp_extract(head, r"\S+: (.+):(\d+):", 2)))
    mark = F.size(lines) - F.array_position(F.reverse(F.transform(lines, lambda x: x.endswith("stack traceback:"))), True).cast("int") + 1
    after = F.get(F.filter(F.slice(lines, mark + 1, F.size(lines)), lambda x: x.rlike(p)), F.lit(0))
    return F.coalesce(direct, F.when(after.isNotNull(), F.concat_ws(":", F.regexp_extract(after, p, 1), F.regexp_extract(after, p, 2))))


def excerpts(places: DataFrame, sources: DataFrame) -> DataFrame:
    """(report_id, excerpt): ten lines around a crash, the crash's own marked. ``places``: report_id, file, line; ``sources``: file, line, text."""
    s = sources.select(F.col("file").alias("f"), F.col("line").alias("l"), "text")
    begin = F.greatest(F.col("line") - 5, F.lit(1))
    near = places.join(s, F.col("f") == F.col("file")).where((F.col("l") >= begin) & (F.col("l") < begin + 10))
    shown = F.concat(F.when(F.col("l") == F.col("line"), "--->").otherwise("    "), F.format_string("%-6d", F.col("l").cast("int")), F.coalesce("text", F.lit("Corrupted line")))
    return near.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("l", shown.alias("t")))).alias("x")).select("report_id", F.transform("x", lambda y: y["t"]).alias("excerpt"))


def clean_disassembly(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.regexp_replace(x, "<.*?>", ""))


def strip_prefix(path: Column, prefix: str) -> Column:
    """A path without its leading components ``prefix``; a partial component doesn't count."""
    root = prefix.rstrip("/")
    return F.when(path.startswith(root + "/"), F.substring(path, len(root) + 2, 1 << 30)).when(path == root, "").otherwise(path)


def maps_table(lines: Column) -> Column:
    """Lines of a process's maps file as a debugger's table: start, end, size, offset and name."""
    p = r"^([0-9a-f]+)-([0-9a-f]+)\s+\S+\s+([0-9a-f]+)\s+\S+\s+\S+\s*(.*)$"
    value = lambda x, k: F.conv(F.regexp_extract(x, p, k), 16, 10).cast("decimal(20,0)")
    hexed = lambda c: F.concat(F.lit("0x"), F.lower(F.conv(c.cast("string"), 10, 16)))
    return F.transform(F.filter(lines, lambda x: x.rlike(p)), lambda x: F.concat_ws(" ", hexed(value(x, 1)), hexed(value(x, 2)), hexed(value(x, 2) - value(x, 1)), hexed(value(x, 3)), F.regexp_extract(x, p, 4)))


def normal_path(path: Column) -> Column:
    """A path without ``.`` and ``..`` components, which are resolved as text."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    stack = F.aggregate(parts, F.expr("cast(array() as array<string>)"), lambda acc, x: F.when((x == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == "..", F.when(path.startswith("/"), acc).otherwise(F.array_append(acc, x))).otherwise(F.array_append(acc, x)))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(stack, "/"))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(\.gdb)?\.casrep$", "")


def report_name(executable: Column, rest: Column) -> Column:
    return F.concat(F.regexp_extract(executable, "([^/]+)$", 1), F.lit("_"), rest, F.lit(".casrep"))


def ubsan_name(folder: Column, seed: Column, line: Column) -> Column:
    return F.concat(F.concat_ws("_", folder, seed, F.replace(line, F.lit(":"), F.lit("_"))), F.lit(".casrep"))


def summary_line(kind: Column, severity: Column, short: Column, line: Column, path: Column, ubsan: Column | None = None) -> Column:
    """``kind: severity: short: place``, and ``short: place`` for an undefined-behaviour warning; the place is the crash line or else the report's path."""
    place = F.when(F.trim(F.coalesce(line, F.lit(""))) != "", line).otherwise(path)
    known = F.when(severity.isin("EXPLOITABLE", "PROBABLY_EXPLOITABLE", "NOT_EXPLOITABLE"), severity).otherwise("UNDEFINED")
    full = F.concat_ws(": ", kind, known, short, place)
    return full if ubsan is None else F.when(ubsan, F.concat_ws(": ", short, place)).otherwise(full)

#: The sections of a report's text in order: title and column.
SECTIONS = [
    ("CrashSeverity", None), ("Stacktrace", "Stacktrace"), ("Registers", None), ("Disassembly", "Disassembly"), ("Source", "Source"), ("AsanReport", "AsanReport"), ("MsanReport", "MsanReport"),
    ("UbsanReport", "UbsanReport"), ("PythonReport", "PythonReport"), ("JavaReport", "JavaReport"), ("GoReport", "GoReport"), ("RustReport", "RustReport"), ("JsReport", "JsReport"), ("CSharpReport", "CSharpReport"), ("LuaReport", "LuaReport"),
    ("ProcMaps", "ProcMaps"), ("ProcEnviron", "ProcEnviron"), ("ProcStatus", "ProcStatus"), ("ProcFiles", "ProcMaps"), ("NetworkConnections", "ProcFiles"),
]


def report_text(columns: list[str]) -> Column:
    """A report as text: simple fields, then its sections; absent ones are left out."""
    from .severity import rendered

    simple = ("Date", "Uname", "OS", "OSRelease", "Architecture", "ExecutablePath", "ProcCmdline", "Stdin", "Package", "PackageVersion", "PackageArchitecture", "PackageDescription", "CrashLine")
    parts = [F.when(F.col(c) != "", F.concat(F.lit(c + ": "), F.col(c))) for c in simple if c in columns]
    for title, column in SECTIONS:
        head = f"\n==={title}==="
        if title == "CrashSeverity" and title in columns:
            parts.append(F.concat(F.lit(head + "\n"), rendered(F.col(title))))
        elif title == "Registers" and title in columns:
            lines = F.transform(F.array_sort(F.map_entries(title)), lambda e: F.concat(e["key"], F.lit("=0x"), F.lower(F.conv(e["value"].cast("string"), 10, 16))))
            parts.append(F.when(F.size(title) > 0, F.concat(F.lit(head + "\n"), F.array_join(lines, "\n"))))
        elif column in columns:
            parts.append(F.when(F.size(column) > 0, F.concat(F.lit(head + "\n"), F.array_join(column, "\n"))))
    return F.concat_ws("\n", *parts)


def _cut_bytes(text: Column, most: int) -> Column:
    """The longest beginning of at most ``most`` bytes, cut between characters."""
    fits = F.aggregate(F.sequence(F.lit(0), F.least(F.length(text), F.lit(most))), F.lit(0), lambda acc, n: F.when(F.octet_length(F.substring(text, F.lit(1), n)) <= most, n).otherwise(acc))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(text, F.lit(1), fits))


def finding_title(product: Column, executable: Column, short: Column, line: Column) -> Column:
    """``[product] [program] class in place`` in at most 500 bytes."""
    name = F.regexp_extract(executable, "([^/]*)/*$", 1)
    return _cut_bytes(F.concat(F.lit("["), product, F.lit("] ["), name, F.lit("] "), short, F.lit(" in "), line), 500)


def tracker_severity(kind: Column, ubsan: Column) -> Column:
    """struct<number, name>: what a tracker calls a class; an undefined-behaviour warning is low unless it is said to be exploitable."""
    level = lambda number, name: F.struct(F.lit(number).alias("number"), F.lit(name).alias("name"))
    return F.when(kind == "EXPLOITABLE", level("S0", "Critical")).when(kind == "PROBABLY_EXPLOITABLE", level("S1", "High")).when((kind == "NOT_EXPLOITABLE") & ~ubsan, level("S2", "Medium")).otherwise(level("S3", "Low"))

#: Fixed value: words in a command that mark a finding of a security checker.
SECURITY = "null_deref|out_of_bounds|int_overflow|div_by_zero|neg_size|num_trunc"


def reproduction(cmdline: Column, stdin: Column) -> Column:
    return F.when(stdin != "", F.concat(cmdline, F.lit(" < "), stdin)).otherwise(cmdline)


def security_tagged(cmdline: Column, stdin: Column) -> Column:
    return reproduction(cmdline, stdin).rlike(SECURITY)


#: The parts of a finding's description that are left out if they are empty: title and report column.
DESCRIBED = [("Source", "Source"), ("ASAN report", "AsanReport"), ("UBSAN report", "UbsanReport"), ("Python report", "PythonReport"), ("Go report", "GoReport"), ("Rust report", "RustReport")]


def finding_description(gdb: Column | None = None, gdb_run: bool = False) -> Column:
    """Markdown for a tracker over a report's columns; ``gdb`` is the class of the debugger's report, null if it has none."""
    said = lambda head, e: F.concat(F.lit(f"**{head}:** "), F.concat_ws(": ", e["Type"], e["ShortDescription"], e["Description"]), F.lit("\n"), e["Explanation"], F.lit("\n"))
    block = lambda title, c: F.concat(F.lit(f"# {title}\n\n```\n"), F.array_join(c, "\n"), F.lit("\n```\n"))
    filled = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    none = F.when(~filled("UbsanReport"), "**GDB severity (without ASAN):** No crash\n") if gdb_run else F.lit("")
    debugger = none if gdb is None else F.when(gdb.isNotNull(), said("GDB severity (without ASAN)", gdb)).otherwise(none)
    parts = [F.lit("**Crash line:** "), F.col("CrashLine"), F.lit("\n"), said("Severity", F.col("CrashSeverity")), F.coalesce(debugger, F.lit("")), F.lit("**Command:** "), reproduction(F.col("ProcCmdline"), F.col("Stdin"))]
    parts += [F.lit("\n**OS:** "), F.concat_ws(" ", "OS", "OSRelease"), F.lit("\n**Architecture:** "), F.col("Architecture"), F.lit("\n\n")]
    parts += [F.when(filled(c), F.concat(block(title, F.col(c)), F.lit("\n"))).otherwise("") for title, c in DESCRIBED]
    parts += [block("Stack trace", F.col("Stacktrace")), F.lit("\n"), block("Environment variables", F.col("ProcEnviron"))]
    return F.concat(*parts)


def substitute_seed(argv: Column, seed: Column) -> Column:
    """Arguments with ``@@`` replaced by the seed's path."""
    return F.transform(argv, lambda a: F.replace(a, F.lit("@@"), seed))


def seed_argument(argv: Column) -> Column:
    """0-based place of the first argument behind the program that holds ``@@``; null if there is none, and the seed goes to standard input."""
    rest = F.slice(argv, F.lit(2), F.greatest(F.size(argv), F.lit(1)))
    return F.nullif(F.array_position(F.transform(rest, lambda a: a.contains("@@")), True), F.lit(0).cast("bigint")).cast("int")


def with_seed_argument(argv: Column, keep: Column) -> Column:
    """Arguments with ``@@`` appended where none has it, unless ``keep`` holds (seeds of other fuzzers or interpreters go to standard input)."""
    return F.when(seed_argument(argv).isNull() & ~keep, F.array_append(argv, F.lit("@@"))).otherwise(argv)


def _chosen(hint: Column, rules: list[tuple[str, Column]]) -> Column:
    """The first tool that the hint names, or whose condition holds if the hint is ``auto``; else the debugger's."""
    out = None
    for name, test in rules:
        when = (hint == name) | ((hint == "auto") & F.coalesce(test, F.lit(False)))
        out = F.when(when, name) if out is None else out.when(when, name)
    return out.otherwise("gdb")


def libfuzzer_tool(argv: Column, symbols: Column, hint: Column) -> Column:
    """Which analysis the crashes of an in-process fuzzer get, by its command line and the symbols of its program."""
    first, second = F.get(argv, F.lit(0)), F.coalesce(F.get(argv, F.lit(1)), F.lit(""))
    ends = lambda *names: F.greatest(*[first.endswith(n) for n in names], F.lit(False))
    return _chosen(hint, [
        ("python", first.endswith(".py")), ("java", ends("jazzer", "java")), ("js", ends(".js", "node", "jsfuzz") | (first.endswith("npx") & (second == "jazzer"))),
        ("lua", first.endswith(".lua") | first.isin("lua", "luajit") | second.endswith(".lua")), ("san", F.exists(symbols, lambda s: s.isin("__asan", "__msan", "runtime.go"))),
    ])


def afl_tool(argv: Column, symbols: Column, hint: Column) -> Column:
    """Which analysis the crashes of a forking fuzzer get; a program without a command line is the debugger's."""
    first = F.get(argv, F.lit(0))
    return _chosen(hint, [("csharp", first.endswith("dotnet") | first.endswith("mono")), ("python", first.endswith(".py")), ("san", F.exists(symbols, lambda s: s.isin("__asan", "__msan")))])


def out_of_memory(stderr: Column) -> Column:
    return stderr.contains("AddressSanitizer: hard rss limit exhausted") | stderr.contains("AddressSanitizer: out-of-memory")


def outcome(stderr: Column) -> Column:
    """Where a crash goes after its analysis."""
    return F.when(stderr.contains("Timeout"), "timeout").when(stderr.contains("Out of memory"), "oom").when(stderr.contains("Program terminated (no crash)"), "no_crash").when(stderr != "", "error").otherwise("report")


def outcome_name(name: Column, where: Column) -> Column:
    """A seed's file name in its outcome's folder: what stands before the first ``-`` becomes the outcome."""
    return F.when(where.isin("timeout", "oom") & name.contains("-"), F.concat(where, F.regexp_replace(name, "^[^-]*", ""))).otherwise(name)
