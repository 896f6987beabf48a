"""Frame parsers, frame identity, filters and recursion folding, as column expressions.

A parsed trace is ``struct<frames: array<FRAME>, error: string>``: the first entry that can't be
parsed makes the whole trace an error, which callers keep as a column instead of dropping the row.
Parsers are chains of ``transform`` over the raw entries, so they run in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType, BooleanType

from ..sources.schemas import FRAME
from . import fixed, formats
from .strings import let, strip

ZERO = "cast(0 as decimal(20,0))"


def _re(text: Column, pattern: str | Column, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group) if isinstance(pattern, str) else F.call_function("regexp_extract", text, pattern, F.lit(group))


def hex_number(text: Column) -> Column:
    """Unsigned 64-bit value of hex digits; null if there are none or too many."""
    return let(F.regexp_replace(text, "^0+(?=.)", ""), lambda digits: F.when(digits.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(digits, 16, 10).cast("decimal(20,0)")))


def _number(text: Column) -> Column:
    return let(text, lambda t: F.when(t.rlike(r"^\+?[0-9]{1,18}$"), F.regexp_replace(t, r"^\+", "").cast("bigint")))


def frame(address=None, function=None, module=None, offset=None, file=None, line=None, column=None) -> Column:
    text = lambda c: F.coalesce(c, F.lit("")) if c is not None else F.lit("")
    number = lambda c: F.coalesce(c, F.expr(ZERO)).cast("decimal(20,0)") if c is not None else F.expr(ZERO)
    long = lambda c: F.coalesce(c, F.lit(0)).cast("bigint") if c is not None else F.lit(0).cast("bigint")
    return F.struct(
        number(address).alias("address"), text(function).alias("function"), text(module).alias("module"), number(offset).alias("offset"),
        F.struct(text(file).alias("file"), long(line).alias("line"), long(column).alias("column")).alias("debug"),
    )


def _parsed(value: Column, ok: Column, entry: Column) -> Column:
    return F.struct(value.alias("f"), F.when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit("Couldn't parse stack trace entry: "), entry)).alias("e"))


def _source(location: Column) -> Column:
    """struct<file, line, column, ok> of file[:line[:column]]; the last two colons count."""
    p = r"^(.*?)(?::([^:]*)(?::([^:]*))?)?$"

    def read(x: Column) -> Column:
        ok = (x["file"] != "") & ((x["colons"] < 1) | x["line"].isNotNull()) & ((x["colons"] < 2) | x["column"].isNotNull())
        return F.struct(strip(x["file"]).alias("file"), x["line"].alias("line"), x["column"].alias("column"), (x["empty"] | ok).alias("ok"))

    split = lambda t: F.struct((t == "").alias("empty"), _re(t, p, 1).alias("file"), _number(_re(t, p, 2)).alias("line"), _number(_re(t, p, 3)).alias("column"), (F.length(t) - F.length(F.replace(t, F.lit(":"), F.lit("")))).alias("colons"))
    return let(let(location, split), read)


def asan_entry(entries: Column) -> Column:
    """``#N 0xADDR [in function[(arguments)][ const]] [file[:line[:column]]] [(module+0xOFFSET)]``."""
    head = r"^ *#[0-9]+ +0x([0-9a-f]+) *"
    a = F.transform(entries, lambda e: F.struct(e.alias("e"), hex_number(_re(e, head)).alias("address"), strip(F.regexp_replace(e, head, "")).alias("rest")))
    module = lambda x: F.when(x["rest"].startswith("in "), F.lit(r"\(([^()]+)\+0x([0-9a-f]+)\)")).otherwise(F.lit(r"\((.+)\+0x([0-9a-f]+)\)"))
    b = F.transform(a, lambda x: F.struct(
        x["e"].alias("e"), x["address"].alias("address"), x["rest"].startswith("in ").alias("named"),
        strip(_re(x["rest"], module(x), 1)).alias("module"), _re(x["rest"], module(x), 2).alias("offset"),
        strip(F.split(x["rest"], module(x), 2)[0]).alias("rest"),
    ))
    c = F.transform(b, lambda x: F.struct(
        x["e"].alias("e"), x["address"].alias("address"), x["named"].alias("named"), x["module"].alias("module"), x["offset"].alias("offset"),
        F.when(x["named"], strip(F.regexp_replace(strip(F.substring(x["rest"], 4, 1 << 30)), "^.*? for ", ""))).otherwise(x["rest"]).alias("rest"),
    ))
    name = lambda x: F.when(x["rest"].endswith(") const"), F.lit("^(.*)()$")).when(x["rest"].contains(")"), F.lit(r"^(.*\)(?: const(?= ))?[^ ]*)(?: (.*))?$")).otherwise(F.lit("^([^ ]*)(?: (.*))?$"))
    d = F.transform(c, lambda x: F.struct(
        x["e"].alias("e"), x["address"].alias("address"), (~x["named"] | (x["rest"] != "")).alias("named_well"), x["module"].alias("module"), x["offset"].alias("offset"),
        F.when(x["named"], _re(x["rest"], name(x), 1)).otherwise("").alias("function"),
        F.when(x["named"], strip(_re(x["rest"], name(x), 2))).otherwise(x["rest"]).alias("location"),
    ))

    f = F.transform(d, lambda x: F.struct(x.alias("x"), _source(x["location"]).alias("at"), hex_number(x["offset"]).alias("offset")))

    def last(y: Column) -> Column:
        x, at = y["x"], y["at"]
        ok = at["ok"] & x["address"].isNotNull() & x["named_well"] & ((x["offset"] == "") | y["offset"].isNotNull())
        return _parsed(frame(x["address"], x["function"], x["module"], y["offset"], at["file"], at["line"], at["column"]), ok, x["e"])

    return F.transform(f, last)


def gdb_entry(entries: Column) -> Column:
    """``#N [0xADDR in ]function (arguments)[ at file[:line[:column]] | from module]``."""
    p = r"^ *#[0-9]+ +(?:0x([0-9a-f]+) +in +)?(.*?)(?: +(?:at|from) +(\S.*))?$"

    def one(e: Column) -> Column:
        where = _re(e, p, 3)
        at = e.rlike(r" +at +\S[^()]*$")
        function = strip(F.regexp_replace(_re(e, p, 2), r" \(.*$", ""))
        known = hex_number(_re(e, p, 1))
        return let(_source(F.when(at, where).otherwise("")), lambda s: _parsed(frame(known, function, F.when(at, "").otherwise(where), None, s["file"], s["line"], s["column"]), e.rlike(r"^ *#[0-9]+ ") & s["ok"], e))

    seen = F.transform(entries, one)
    # a frame without source and without address says nothing about where it is
    return F.filter(seen, lambda x: x["e"].isNotNull() | (x["f"]["debug"]["file"] != "") | (x["f"]["address"] != 0))


def _simple(pattern: str, make: Callable[[Callable[[int], Column]], Column], numbers: Sequence[int]) -> Callable[[Column], Column]:
    def parse(entries: Column) -> Column:
        def one(e: Column) -> Column:
            ok = e.rlike(pattern)
            for k in numbers:
                ok = ok & ((_re(e, pattern, k) == "") | _number(_re(e, pattern, k)).isNotNull())
            return _parsed(make(lambda k: _re(e, pattern, k)), ok, e)

        return F.transform(entries, one)

    return parse



def python_entry(entries: Column) -> Column:
    """``File "file", line N, in function``; a marker of repeats copies the frame before it as often as it says."""
    times = F.transform(entries, lambda e: F.when(e.rlike(formats.PYTHON_REPEATS), _number(_re(e, formats.PYTHON_REPEATS)).cast("int")).otherwise(F.when(e.startswith("["), F.lit(-1)).otherwise(F.lit(1))))
    parsed = F.transform(entries, lambda e: _parsed(frame(function=_re(e, formats.PYTHON_FRAME, 3), file=_re(e, formats.PYTHON_FRAME, 1), line=_number(_re(e, formats.PYTHON_FRAME, 2))), e.rlike(formats.PYTHON_FRAME), e))
    # the frame a marker refers to is the last one before it that isn't a marker
    source = F.transform(entries, lambda e, i: F.when(~e.startswith("["), i).otherwise(F.coalesce(F.array_max(F.filter(F.transform(F.slice(entries, 1, i), lambda p, k: F.when(~p.startswith("["), k)), lambda k: k.isNotNull())), F.lit(-1))))
    copies = F.transform(F.arrays_zip(times.alias("n"), source.alias("s"), entries.alias("e")), lambda x: F.when(
        (x["n"] < 0) | (x["s"] < 0), F.array(_parsed(frame(), F.lit(False), x["e"]))
    ).otherwise(F.array_repeat(F.get(parsed, x["s"]), x["n"])))
    return F.flatten(copies)


def _java(entries: Column) -> Column:
    p = r"\s*at (.*)\((.*)\)"
    known = F.filter(entries, lambda e: ~e.contains("Unknown Source") & ~e.contains("Native Method"))

    def one(e: Column) -> Column:
        parts = F.split(_re(e, p, 2), ":", -1)
        line = _number(F.get(parts, F.lit(1)))
        return _parsed(frame(function=_re(e, p, 1), file=parts[0], line=line), e.rlike(p) & ((F.size(parts) < 2) | line.isNotNull()), e)

    return F.transform(known, one)


def _lua(entries: Column) -> Column:
    p = r"(.+):(\d+): in (\S+ )(\S+)"
    known = F.filter(entries, lambda e: ~e.startswith("[C]:"))

    def one(e: Column) -> Column:
        name = F.regexp_replace(F.regexp_replace(F.regexp_replace(_re(e, p, 4), "^'+|'+$", ""), "^<+", ""), ">+$", "")
        kind = _re(e, p, 3)
        return _parsed(frame(function=F.when(kind.startswith("main"), F.concat(kind, name)).otherwise(name), file=_re(e, p, 1), line=_number(_re(e, p, 2))), e.rlike(p), e)

    return F.transform(known, one)



def _csharp(entries: Column) -> Column:
    def one(e: Column) -> Column:
        g = lambda k: _re(e, formats.CSHARP_FRAME, k)
        number = lambda c: F.when(c.rlike("^0x"), hex_number(F.substring(c, 3, 64)))
        absent = lambda c: c == ""
        base, more, il = number(g(4)), number(g(5)), number(g(6))
        address = F.when(~absent(g(4)), base + F.when(absent(g(5)), F.expr(ZERO)).otherwise(more)).when(~absent(g(6)), il)
        ok = e.rlike(formats.CSHARP_FRAME) & ((absent(g(4)) & absent(g(6))) | (address.isNotNull() & (address < F.expr("cast(18446744073709551616 as decimal(20,0))")))) & (absent(g(9)) | _number(g(9)).isNotNull())
        return _parsed(frame(address, F.concat(g(1), g(2), g(3)), file=F.when(~absent(g(8)), g(8)).otherwise(g(7)), line=_number(g(9))), ok, e)

    return F.transform(entries, one)


def _js_location(loc: Column) -> tuple[Column, Column, Column, Column]:
    """file, line, column, validity. Files that aren't absolute belong to the runtime."""
    parts = F.split(loc, ":", -1)
    long = F.size(parts) > 3
    p = r"^(.*):([^:]*):([^:]*)$"
    file = F.when(long, _re(loc, p, 1)).otherwise(parts[0])
    file = F.regexp_replace(file, r"^.*://", "")
    second = F.when(long, _re(loc, p, 2)).otherwise(F.get(parts, F.lit(1)))
    third = F.when(long, _re(loc, p, 3)).otherwise(F.get(parts, F.lit(2)))
    ok = (loc != "") & (second.isNull() | _number(second).isNotNull()) & (third.isNull() | _number(third).isNotNull())
    return F.when(file.startswith("/"), file).otherwise("<anonymous>"), F.coalesce(_number(second), F.lit(0)), F.coalesce(_number(third), F.lit(0)), ok



def _js(entries: Column) -> Column:
    """``at function [as method] (location)``, ``at location`` and calls from evaluated text."""
    known = F.filter(entries, lambda e: ~e.contains("unknown location"))

    def one(e: Column) -> Column:
        method = lambda c: F.when(c != "", F.concat(F.lit(" "), c)).otherwise("")
        f1, l1, c1, ok1 = _js_location(_re(e, formats.JS_FULL, 3))
        full = _parsed(frame(function=F.concat(_re(e, formats.JS_FULL, 1), method(_re(e, formats.JS_FULL, 2))), file=f1, line=l1, column=c1), ok1, e)
        f2, l2, c2, ok2 = _js_location(_re(e, formats.JS_BARE, 1))
        bare = _parsed(frame(file=f2, line=l2, column=c2), ok2 & e.rlike(formats.JS_BARE), e)
        caller, inner, direct = _re(e, formats.JS_EVAL, 1), _re(e, formats.JS_EVAL, 3), _re(e, formats.JS_EVAL, 4)
        f3, l3, c3, ok3 = _js_location(F.when(caller != "", inner).otherwise(direct))
        _, l4, c4, ok4 = _js_location(_re(e, formats.JS_EVAL, 5))
        name = F.when(caller == "", "eval").when(caller == "<anonymous>", F.concat(F.lit("eval"), method(_re(e, formats.JS_EVAL, 2)))).otherwise(F.concat(F.lit("eval at "), caller, method(_re(e, formats.JS_EVAL, 2))))
        nested = (caller != "") & inner.rlike("[()]")
        # evaluated text begins in line 3 of what the runtime wraps around it
        shifted = F.when(l4 >= 3, l3 + l4 - 3).otherwise(l3)
        column = F.when((l4 >= 3) & (c4 != 0), c4).otherwise(c3)
        from_eval = F.when(nested, _parsed(frame(function=F.lit("<anonymous>")), e.rlike(formats.JS_EVAL), e)).otherwise(_parsed(frame(function=name, file=f3, line=shifted, column=column), e.rlike(formats.JS_EVAL) & ok3 & ok4, e))
        return F.when(e.rlike(formats.JS_FULL) & e.startswith("at eval") & e.contains("eval at"), from_eval).when(e.rlike(formats.JS_FULL), full).otherwise(bare)

    return F.transform(known, one)


PARSERS: dict[str, Callable[[Column], Column]] = {
    "asan": asan_entry,
    "gdb": gdb_entry,
    "python": python_entry,
    "go": _simple(r"(.+) in (.+):([0-9]+)", lambda g: frame(function=g(1), file=g(2), line=_number(g(3))), [3]),
    "java": _java,
    "rust": _simple(
        r" *[0-9]+: +0x([0-9a-f]+) - (.+?)(?: *at (.+?):([0-9]+)(?::([0-9]+))?|$)",
        lambda g: frame(hex_number(g(1)), g(2), file=g(3), line=_number(g(4)), column=_number(g(5))), [4, 5],
    ),
    "js": _js,
    "csharp": _csharp,
    "lua": _lua,
}


def parsed_entries(entries: Column, lang: str) -> Column:
    """array<struct<f: FRAME, e: string>> of raw entries in one format."""
    return PARSERS[lang](F.coalesce(entries, F.expr("cast(array() as array<string>)"))).cast(f"array<struct<f:{FRAME},e:string>>")


def first_error(parsed: Column) -> Column:
    return F.get(F.filter(F.transform(parsed, lambda x: x["e"]), lambda x: x.isNotNull()), F.lit(0))


def parsed_frames(parsed: Column) -> Column:
    """The frames of a trace all of whose entries were parsed, else none."""
    return F.when(F.exists(parsed, lambda x: x["e"].isNotNull()), F.expr(f"cast(array() as array<{FRAME}>)")).otherwise(F.transform(parsed, lambda x: x["f"]))


def parse(entries: Column, lang: str) -> Column:
    """struct<frames, error> of raw entries in one format."""
    return let(parsed_entries(entries, lang), lambda seen: F.struct(parsed_frames(seen).alias("frames"), first_error(seen).alias("error")))


def dispatch(report_columns: Sequence[str]) -> Column:
    """The format of a report's trace: that of the first report column with lines, else the debugger's."""
    out = None
    for lang, names in fixed.FORMATS:
        filled = F.lit(False)
        for n in names:
            if n in report_columns:
                filled = filled | (F.coalesce(F.size(n), F.lit(0)) > 0)
        out = F.when(filled, lang) if out is None else out.when(filled, lang)
    return out.otherwise("gdb")


def parse_dispatched(entries: Column, lang: Column) -> Column:
    """Parsed entries in the format that ``lang`` names."""
    out = None
    for name in PARSERS:
        out = F.when(lang == name, parsed_entries(entries, name)) if out is None else out.when(lang == name, parsed_entries(entries, name))
    return out


def with_modules(frames: Column, maps: Column) -> Column:
    """Frames whose address lies in a mapping (array<struct<start, stop, name, base>>) get its module and the offset into it."""

    def hit(f: Column) -> Column:
        return F.struct(f.alias("f"), F.get(F.filter(maps, lambda m: (f["address"] >= m["start"]) & (f["address"] < m["stop"])), F.lit(0)).alias("m"))

    def one(x: Column) -> Column:
        f, m = x["f"], x["m"]
        found = m.isNotNull() & (f["address"] != 0)
        return F.struct(
            f["address"].alias("address"), f["function"].alias("function"), F.when(found, m["name"]).otherwise(f["module"]).alias("module"),
            F.when(found, f["address"] - m["base"]).otherwise(f["offset"]).cast("decimal(20,0)").alias("offset"), f["debug"].alias("debug"),
        )

    return F.when(F.coalesce(F.size(maps), F.lit(0)) > 0, F.transform(F.transform(frames, hit), one)).otherwise(frames)



def mappings(lines: Column) -> Column:
    """array<struct<start, stop, name>> of a debugger's table of mapped files."""
    named = F.filter(F.coalesce(lines, F.expr("cast(array() as array<string>)")), lambda x: x.rlike(formats.MAP_LINE))
    return F.transform(named, lambda x: F.struct(hex_number(_re(x, formats.MAP_LINE, 1)).alias("start"), hex_number(_re(x, formats.MAP_LINE, 2)).alias("stop"), strip(_re(x, formats.MAP_LINE, 4)).alias("name")))


def based(maps: Column) -> Column:
    """Mappings with the base of their file."""
    return F.transform(maps, lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), m["name"].alias("name"), F.array_min(F.transform(F.filter(maps, lambda o: o["name"] == m["name"]), lambda o: o["start"])).alias("base")))


def frame_key(f: Column) -> Column:
    """A frame's identity: its source position, else its place in a module, else its address."""
    d = f["debug"]
    return F.when(d["file"] != "", F.concat_ws("|", F.lit("d"), d["file"], d["line"], d["column"])).when((f["module"] != "") & (f["offset"] != 0), F.concat_ws("|", F.lit("m"), f["module"], f["offset"])).otherwise(F.concat_ws("|", F.lit("a"), f["address"]))


def frame_keys(frames: Column) -> Column:
    return F.transform(frames, frame_key)


def fingerprint(keys: Column) -> Column:
    return F.sha2(F.to_json(keys), 256)


def ignore_pattern(kind: dict[str, list[str]], langs: Sequence[str], more: Sequence[str] = ()) -> str:
    """One alternation of the languages' expressions and the user's; without any, one that fits single characters."""
    found = [x for lang in langs for x in kind.get(lang, ["^[^.]$"])] + list(more)
    return "|".join(f"({x})" for x in found) or "^[^.]$"


def to_entry(frames: Column, entry: str = fixed.FUZZ_ENTRY) -> Column:
    """Frames down to the first one of the fuzzer's entry point."""
    at = F.array_position(F.transform(frames, lambda f: f["function"].contains(entry)), True).cast("int")
    return F.when(at > 0, F.slice(frames, F.lit(1), at)).otherwise(frames)


def filtered(frames: Column, langs: Sequence[str] = fixed.CLUSTER_LANGS, functions: Sequence[str] = (), files: Sequence[str] = (), entry: str = fixed.FUZZ_ENTRY) -> Column:
    """Frames down to the fuzzer's entry point without those of runtimes; recursion is not folded yet."""
    cut = to_entry(frames, entry)
    fn, path = ignore_pattern(fixed.IGNORED_FUNCTIONS, langs, functions), ignore_pattern(fixed.IGNORED_FILES, langs, files)
    kept = lambda text, p: (text == "") | ~text.rlike(p)
    return F.filter(cut, lambda f: kept(f["function"], fn) & kept(f["module"], path) & kept(f["debug"]["file"], path))


def repeat_mask(keys: list) -> list[bool]:
    """For each element whether it stays when runs of a repeated interval keep their last copy only.

    For every period, maximal runs of elements equal to the one a period later are looked at;
    whole periods in a run are dropped, shortest periods first, in one pass.
    """
    n = len(keys)
    stays = [True] * n
    for period in range(1, n // 2 + 1):
        run = 0
        for i in range(n - period + 1):
            if i < n - period and keys[i] == keys[i + period]:
                run += 1
                continue
            whole = run - run % period
            for k in range(i - run, i - run + whole):
                stays[k] = False
            run = 0
    return stays


def folded(keys: list) -> list[bool]:
    """The elements that are left when :func:`repeat_mask` is applied until nothing more goes."""
    left = list(range(len(keys)))
    while True:
        mask = repeat_mask([keys[i] for i in left])
        if all(mask):
            break
        left = [i for i, m in zip(left, mask) if m]
    kept = set(left)
    return [i in kept for i in range(len(keys))]


@F.pandas_udf(ArrayType(BooleanType()))
def fold_mask(keys: pd.Series) -> pd.Series:
    """Of array<string>: which frames stay when recursion is folded."""
    return keys.map(lambda k: None if k is None else folded(list(k)))


def apply_mask(frames: Column, mask: Column) -> Column:
    return F.filter(frames, lambda f, i: F.get(mask, i))
