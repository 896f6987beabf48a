"""Severity classes from sanitizer reports, signals, exceptions and debugger state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.schemas import SEVERITY
from . import fixed, formats
from .frames import hex_number
from .strings import let, rstrip, strip

LOW = "NOT_EXPLOITABLE"


def catalog(spark: SparkSession) -> DataFrame:
    """(pos, Type, ShortDescription, Description, Explanation): the known classes, a fixed table of 75 rows."""
    return spark.createDataFrame([(i, *s) for i, s in enumerate(fixed.SEVERITIES)], "pos int, " + ", ".join(f"{f.name} string" for f in SEVERITY))


def with_class(df: DataFrame, short: str, out: str = "severity") -> DataFrame:
    """``df`` with the class whose short description is in column ``short``, null if there is none."""
    known = catalog(df.sparkSession).select(F.col("ShortDescription").alias("_short"), F.struct(*(f.name for f in SEVERITY)).alias(out))
    return df.join(F.broadcast(known), df[short] == F.col("_short"), "left").drop("_short")


def own_class(short: Column, description: Column) -> Column:
    """A class that a program's own error names."""
    return F.when(short.isNotNull(), F.struct(F.lit(LOW).alias("Type"), short.alias("ShortDescription"), F.coalesce(description, F.lit("")).alias("Description"), F.lit("").alias("Explanation")))


def undefined() -> Column:
    return F.struct(*(F.lit(v).alias(f.name) for v, f in zip(fixed.UNDEFINED, SEVERITY)))


def _has(text: Column, pattern: str, group: int) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def near_null(address: Column) -> Column:
    return address < fixed.NEAR_NULL



def sanitizer_class(short: Column, access: Column, null: Column) -> Column:
    """Short description of the class of a sanitizer's finding; null if it is not a known one."""
    names = [s[1] for s in fixed.SEVERITIES]
    suffixed = F.when(access == "READ", F.concat(short, F.lit("(read)"))).when(access == "WRITE", F.concat(short, F.lit("(write)")))
    plain = F.when(short.isin(names), short)
    return (
        F.when(short.endswith("-param-overlap"), "param-overlap")
        .when(short.isin("SEGV", "BUS"), F.when(access == "READ", F.when(null, "SourceAvNearNull").otherwise("SourceAv")).when(access == "WRITE", F.when(null, "DestAvNearNull").otherwise("DestAv")).otherwise("AccessViolation"))
        .when(short == "stack-overflow", "StackOverflow")
        .when(short == "deadly", "AbortSignal")
        .when(short == "fuzz", "fuzz target exited")
        .otherwise(F.coalesce(F.when(suffixed.isin(names), suffixed), plain))
    )


def sanitizer_short(lines: Column) -> Column:
    """Short description of the class of a sanitizer report (array<string>)."""
    summary = formats.SUMMARY

    def read(ls: Column) -> Column:
        head, found = F.get(ls, F.lit(0)), F.get(F.filter(ls, lambda x: x.rlike(summary)), F.lit(0))
        access = F.coalesce(_has(F.get(ls, F.lit(1)), "(READ|WRITE|ACCESS)", 1), _has(F.get(ls, F.lit(2)), "(READ|WRITE|ACCESS)", 1), F.lit("UNDEF"))
        null = F.coalesce(near_null(hex_number(_has(head, "on.*address 0x([0-9a-f]+)", 1))), F.lit(False))
        return let(found, lambda f: F.struct(
            head.contains("LeakSanitizer").alias("leak"), head.contains("MemorySanitizer").alias("msan"), f.isNotNull().alias("found"),
            F.regexp_extract(f, summary, 1).alias("kind"), F.regexp_extract(f, summary, 2).alias("short"), access.alias("access"), null.alias("null"),
        ))

    def named(x: Column) -> Column:
        fuzz = x["kind"] == "libFuzzer"
        known = sanitizer_class(x["short"], F.when(fuzz, "UNDEF").otherwise(x["access"]), ~fuzz & x["null"])
        return F.when(x["leak"], "memory-leaks").when(x["msan"], "use-of-uninitialized-value").when(x["found"], known)

    return let(let(lines, read), named)


def ubsan_severity(lines: Column) -> Column:
    """Class of one warning: its description is in the first line, its name in the last."""
    text = _has(F.get(lines, F.lit(0)), formats.UBSAN_TEXT, 1)
    short = _has(F.get(lines, F.size(lines) - 1), formats.UBSAN_SUMMARY, 1)
    return F.when((F.size(lines) > 1) & text.isNotNull(), own_class(short, text))


def lua_severity(exception: Column) -> Column:
    return own_class(_has(strip(F.substring_index(exception, "\n", 1)), formats.LUA_ERROR, 1), F.lit(""))


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda x: rstrip(x))


def cpp_exception(text: Column) -> Column:
    lines = _lines(text)
    p = formats.CPP_ERROR
    at = F.array_position(F.transform(lines, lambda x: x.rlike(p)), True).cast("int")
    name = F.regexp_replace(F.regexp_extract(F.get(lines, at - 1), p, 1), "^'+|'+$", "")
    return F.when(at > 0, own_class(name, strip(F.coalesce(_has(F.get(lines, at), formats.CPP_WHAT, 1), F.lit("")))))


def python_exception(text: Column) -> Column:
    p = formats.PYTHON_ERROR
    found = F.get(F.filter(F.reverse(_lines(text)), lambda x: x.rlike(p)), F.lit(0))
    return own_class(_has(found, p, 1), F.regexp_extract(found, p, 2))


def java_exception(text: Column) -> Column:
    p = formats.JAVA_ERROR
    found = F.get(F.filter(F.reverse(F.split(text, "\n", -1)), lambda x: x.rlike(p)), F.lit(0))
    name, rest = F.regexp_extract(found, p, 1), F.regexp_extract(found, p, 2)
    return F.when(found.isNotNull(), own_class(F.when(name != "", name).otherwise(rest), F.when(name != "", rest).otherwise("")))


def go_panic(text: Column) -> Column:
    p = formats.GO_ERROR
    found = F.get(F.filter(_lines(text), lambda x: x.rlike(p)), F.lit(0))
    return F.when(found.isNotNull(), own_class(F.lit("GoPanic"), F.regexp_extract(found, p, 2)))


def js_exception(text: Column) -> Column:
    p = formats.JS_ERROR
    return F.when(text.rlike(p), own_class(F.regexp_extract(text, p, 1), F.regexp_extract(text, p, 2)))


def csharp_exception(text: Column) -> Column:
    p = formats.CSHARP_ERROR
    body = F.regexp_extract(text, p, 2)
    inner = F.when(F.regexp_extract(text, p, 1) == ":\n", F.element_at(F.split(body, " ---> ", -1), -1)).otherwise(F.element_at(F.split(body, "\n ---> ", -1), -1))
    at = F.instr(inner, ": ")
    return F.when(text.rlike(p) & (at > 0), own_class(F.substring(inner, F.lit(1), at - 1), F.substring(inner, at + 2, F.length(inner))))


def rust_panic(text: Column) -> Column:
    p = formats.RUST_ERROR
    quoted = F.regexp_extract(text, p, 2)
    return F.when(text.rlike(p), own_class(F.lit("RustPanic"), F.when(quoted != "", quoted).otherwise(F.regexp_extract(text, p, 3))))

EXCEPTIONS = {"cpp": cpp_exception, "python": python_exception, "java": java_exception, "go": go_panic, "js": js_exception, "csharp": csharp_exception, "rust": rust_panic}


def overridden(base: Column, text: Column) -> Column:
    """An uncaught C++ exception or a Rust panic says more than the signal it ends with."""
    return F.coalesce(cpp_exception(text), rust_panic(text), base)


def signal_class(signal: Column) -> Column:
    """Short description of the class of a signal when nothing else is known."""
    return F.when(signal.isin(fixed.SIGILL, fixed.SIGSYS), "BadInstruction").when(signal == fixed.SIGTRAP, "TrapSignal").when(signal == fixed.SIGABRT, "AbortSignal").when(signal.isin(fixed.SIGBUS, fixed.SIGSEGV), "AccessViolation").otherwise("Undefined")


def debugger_short(signal: Column, code: Column, address: Column, pc: Column, pc_bytes: Column, trace: Column, instruction: Column) -> Column:
    """Short description of the class of a debugger's context; ``instruction`` is what the faulting code says (see instructions)."""
    some = lambda word: F.exists(trace, lambda x: x.contains(word))
    memory = signal.isin(fixed.SIGSEGV, fixed.SIGBUS)
    return (
        F.when(signal == fixed.SIGABRT, F.when(some("cfree"), "HeapError").when(some("__chk_fail"), "SafeFunctionCheck").when(some("_stack_chk_fail"), "StackGuard").otherwise("AbortSignal"))
        .when(signal == fixed.SIGTRAP, "TrapSignal")
        .when(signal.isin(fixed.SIGILL, fixed.SIGSYS), "BadInstruction")
        .when(memory & (pc == address), F.when(near_null(address), "SegFaultOnPcNearNull").otherwise("SegFaultOnPc"))
        .when(memory & (F.length(pc_bytes) == 0) & (code == fixed.SI_KERNEL), "SegFaultOnPc")
        .when(memory, F.coalesce(instruction, F.lit("AccessViolation")))
        .when(signal == fixed.SIGFPE, "FPE")
    )


def pc_register(arch: Column, registers: Column) -> Column:
    name = F.when(arch == "amd64", "rip").when(arch == "i386", "eip").otherwise("pc")
    return F.try_element_at(registers, name)


def sp_register(arch: Column, registers: Column) -> Column:
    name = F.when(arch == "amd64", "rsp").when(arch == "i386", "esp").otherwise("sp")
    return F.try_element_at(registers, name)


def sarif_severity(kind: Column, short: Column) -> Column:
    """Numeric severity of a class in rules, as text."""
    return F.when(short.isin("SegFaultOnPc", "ReturnAv", "BranchAv", "CallAv"), "9.0").when(kind == "EXPLOITABLE", "8.0").when(kind == "PROBABLY_EXPLOITABLE", "6.0").otherwise("3.0")


def rendered(severity: Column) -> Column:
    extra = lambda title, c: F.when(c != "", F.concat(F.lit(f"\n{title}: "), c)).otherwise("")
    return F.concat(F.lit("Severity: "), severity["Type"], F.lit("\nShort description: "), severity["ShortDescription"], extra("Description", severity["Description"]), extra("Explanation", severity["Explanation"]))
