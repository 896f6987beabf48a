"""From raw log text to trace entries: one column expression for each format.

Each ``*_trace`` takes the log text and gives array<string>, or null where the text holds no
trace of that format. Patterns avoid alternations under a star, which overflow the
stack of the JVM's regular expressions on long logs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import formats
from .strings import let, rstrip, strip

EMPTY = "cast(array() as array<string>)"


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def first_index(items: Column, test) -> Column:
    """0-based place of the first element for which ``test`` holds; null if there is none."""
    return let(F.array_position(F.transform(items, lambda x: F.coalesce(test(x), F.lit(False))), True), lambda p: F.when(p > 0, p.cast("int") - 1))


def last_index(items: Column, test) -> Column:
    n = F.size(items)
    return n - 1 - first_index(F.reverse(items), test)


def part(items: Column, start: Column, stop: Column | None = None) -> Column:
    """items[start:stop]."""
    stop = F.size(items) if stop is None else stop
    return F.slice(items, start + 1, F.greatest(stop - start, F.lit(0)))


def asan_trace(text: Column) -> Column:
    """From the first line with frame 0 up to the next empty line, which must be there."""
    return asan_trace_of(split_lines(text))


def asan_trace_of(lines: Column) -> Column:
    """:func:`asan_trace` of lines."""
    rest = let(lines, lambda ls: part(ls, first_index(ls, lambda x: x.contains(" #0 "))))
    return let(rest, lambda r: let(first_index(r, lambda x: x == ""), lambda end: F.when(end.isNotNull(), F.slice(r, F.lit(1), end))))


def gdb_trace(text: Column) -> Column:
    return F.filter(split_lines(text), lambda x: x.rlike("^ *#[0-9]+"))


def python_trace(text: Column) -> Column:
    """Frames and repeat markers of the last-printed-first traceback, innermost first."""
    lines = split_lines(text)
    begin = first_index(lines, lambda x: x.contains("Traceback "))
    rest = part(lines, begin)
    end = last_index(rest, lambda x: x != "")
    frames = F.transform(F.reverse(F.slice(rest, F.lit(1), end)), lambda x: strip(x))
    return F.when(begin.isNotNull(), F.filter(frames, lambda x: x.rlike(formats.PYTHON_LINE)))


def go_trace(text: Column) -> Column:
    """Pairs of lines of the running goroutine; an odd number of lines is no trace."""
    lines = split_lines(text)
    begin = first_index(F.slice(lines, F.lit(1), F.size(lines) - 1), lambda x: x.rlike(formats.GO_ROUTINE))
    rest = part(lines, begin + 1)
    rest = F.slice(rest, F.lit(1), F.coalesce(first_index(rest, lambda x: x == ""), F.size(rest)))
    rest = F.slice(rest, F.lit(1), F.coalesce(first_index(rest, lambda x: x.rlike(formats.FUZZER_ERROR)), F.size(rest)))
    pairs = F.transform(F.filter(rest, lambda x, i: i % 2 == 0), lambda x, i: F.concat(strip(x), F.lit(" in "), strip(F.get(rest, 2 * i + 1))))
    return F.when(begin.isNotNull() & (F.size(rest) % 2 == 0), pairs)


def java_trace(text: Column) -> Column:
    """The frames of the innermost cause, with the outer causes' frames that ``... N more`` stands for."""
    blocks = F.regexp_extract_all(text, F.lit(formats.JAVA_BLOCK), F.lit(0))

    def shape(b: Column) -> Column:
        tail = F.regexp_extract(b, formats.JAVA_FRAMES, 1)
        more = F.regexp_extract(b, formats.JAVA_MORE, 1)
        return F.struct(F.filter(F.transform(F.split(tail, "\n"), lambda x: strip(x)), lambda x: x != "").alias("body"), F.coalesce(F.nullif(more, F.lit("")).cast("int"), F.lit(0)).alias("more"))

    shaped = F.reverse(F.transform(blocks, shape))
    # from the innermost block outwards, each gives the frames that the one within it left out and that it doesn't leave out itself
    unfolded = F.aggregate(
        shaped,
        F.struct(F.get(shaped, F.lit(0))["body"].alias("out"), F.get(shaped, F.lit(0))["more"].alias("open")),
        lambda acc, b: F.when((acc["open"] == 0) | (acc["open"] < b["more"]), acc).otherwise(F.struct(F.concat(acc["out"], F.slice(b["body"], F.greatest(F.lit(1), F.size(b["body"]) - (acc["open"] - b["more"]) + 1), acc["open"] - b["more"])).alias("out"), b["more"].alias("open"))),
        lambda acc: acc["out"],
    )
    return F.when(F.size(blocks) > 0, unfolded)


def js_trace(text: Column) -> Column:
    block = F.regexp_extract(text, formats.JS_BLOCK, 1)
    return F.when(block != "", F.transform(F.filter(F.split(block, "\n"), lambda x: x != ""), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), " +", " ")))


def csharp_trace(text: Column) -> Column:
    block = F.regexp_extract(text, formats.CSHARP_BLOCK, 1)
    lines = F.transform(F.split(block, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.when(block != "", F.filter(lines, lambda x: (x != "") & (x != "--- End of inner exception stack trace ---")))


def rust_trace(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(formats.RUST_FRAME), F.lit(0))
    return F.when(F.size(found) > 0, F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), "\n", " "), " +", " ")))


def lua_exception(text: Column) -> Column:
    """The message with its traceback, up to the last traceback line; null if there is none."""
    found = F.regexp_extract(text, formats.LUA_BLOCK, 0)
    return F.nullif(found, F.lit(""))


def lua_trace(text: Column) -> Column:
    lines = F.transform(split_lines(text), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    begin = first_index(lines, lambda x: x.endswith("stack traceback:"))
    return F.when(begin.isNotNull(), F.filter(part(lines, begin), lambda x: x.rlike(formats.LUA_LINE)))


def ubsan_warnings(text: Column) -> Column:
    """array<string> of the warnings in a log, each from its header to its summary."""
    return F.regexp_extract_all(text, F.lit(formats.UBSAN_WARNING), F.lit(0))


def sanitizer_report(text: Column) -> Column:
    """struct<kind, lines>: from the sanitizer's header to the last line that isn't empty; kind is asan or msan."""
    lines = F.transform(split_lines(text), lambda x: rstrip(x))
    asan = formats.SANITIZER_HEAD
    msan = formats.MSAN_HEAD

    def carved(ls: Column, begin: Column) -> Column:
        kind = F.when(F.get(ls, begin).rlike(asan), "asan").otherwise("msan")
        return F.when(begin.isNotNull(), F.struct(kind.alias("kind"), part(ls, begin, last_index(ls, lambda x: x != "") + 1).alias("lines")))

    return let(lines, lambda ls: let(first_index(ls, lambda x: x.rlike(asan) | x.rlike(msan)), lambda begin: carved(ls, begin)))


def log_format(text: Column, signal: Column | None = None) -> Column:
    """How a log is analysed: as go or rust if it holds such a trace, else as its sanitizer's (asan or msan), else as the debugger's
    if the program ended by a signal; null if none of these."""
    found = F.when(go_trace(text).isNotNull(), "go").when(rust_trace(text).isNotNull(), "rust").otherwise(sanitizer_report(text)["kind"])
    return found if signal is None else F.coalesce(found, F.when(signal.isNotNull() & (signal != 0), "gdb"))


def python_log(stderr: Column, stdout: Column) -> Column:
    """struct<kind, text> of a Python run: python with the text that holds the traceback, or what the sanitizer's analysis gets.

    A sanitizer's header sends the search for an uncaught exception to stdout. Where there is none, or stderr holds no traceback, kind is san and
    the text is stderr.
    """
    sanitized = stderr.rlike(formats.SANITIZER_HEAD)
    own = F.when(sanitized & stdout.contains("Uncaught Python exception: "), stdout).when(~sanitized & stderr.contains("Traceback "), stderr)
    return let(own, lambda found: F.struct(F.when(found.isNotNull(), "python").otherwise("san").alias("kind"), F.coalesce(found, stderr).alias("text")))


def java_log(text: Column) -> Column:
    """Lines of a Java log before the fuzzer's own output, tabs as spaces, without empty ones."""
    lines = F.transform(split_lines(text), lambda x: rstrip(F.regexp_replace(x, "\t", "    ")))
    end = first_index(lines, lambda x: x.startswith("== libFuzzer crashing input =="))
    return F.filter(F.slice(lines, F.lit(1), F.coalesce(end, F.size(lines))), lambda x: x != "")


def js_log(text: Column) -> Column:
    """Lines of a JS log that are frames or name the error."""
    return F.filter(split_lines(text), lambda x: x.rlike(r"^\s*at ") | x.contains("Error:"))


def csharp_log(text: Column) -> Column:
    """Lines from the unhandled exception to the last that isn't empty; null if there is none, and the log is a sanitizer's."""
    lines = split_lines(text)
    begin = first_index(lines, lambda x: x.rlike(formats.CSHARP_HEAD))
    end = last_index(lines, lambda x: x != "")
    return F.when(begin.isNotNull(), part(lines, begin, end + 1))


def lua_log(text: Column) -> Column:
    """Lines of the exception with its traceback; null if there is none."""
    found = lua_exception(text)
    return F.when(found.isNotNull(), split_lines(found))

EXTRACTORS = {"asan": asan_trace, "gdb": gdb_trace, "python": python_trace, "go": go_trace, "java": java_trace, "rust": rust_trace, "js": js_trace, "csharp": csharp_trace, "lua": lua_trace}
