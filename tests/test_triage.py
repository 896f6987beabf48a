"""Triage steps over tables: folders, clusters, statistics, findings, ELF files, and queries against plain Python."""

from __future__ import annotations

import os
import struct
import sys

import pytest
from pyspark.sql import functions as F

from crashloom.functions import text, traces
from crashloom.operators import clustering, statistics, triage
from crashloom.operators.graph import cut
from crashloom.sources import elf, sinks
from crashloom.functions.similarity import similarity


def traced(spark, rows):
    return spark.createDataFrame(rows, "dir string, file_name string, keys array<string>, CrashLine string, parse_error string").withColumn("file_path", F.concat_ws("/", "dir", "file_name")).withColumn("fingerprint", F.array_join("keys", ","))


ROWS = [("a", "1", list("xyz"), "f:1", None), ("a", "2", list("xyz"), "f:1", None), ("a", "3", list("pqr"), "g:1", None), ("b", "1", list("xyz"), "f:2", None), ("b", "2", None, "", "bad"), ("b", "3", list("xyzw"), "", None)]


def test_folders(spark, tmp_path):
    t = cut(traced(spark, ROWS), "traced")
    kept, counts = triage.dedup_folders(t)
    assert sorted((r.dir, r.file_name) for r in kept.collect()) == [("a", "1"), ("a", "3"), ("b", "1"), ("b", "3")]
    assert sorted(tuple(r) for r in counts.collect()) == [("a", 3, 2, 0), ("b", 2, 2, 1)]
    triage.snapshot_without_repeats(t, str(tmp_path / "new"))
    assert spark.read.json(str(tmp_path / "new")).count() == 4 and t.count() == len(ROWS)


def test_report_clusters(spark):
    t = cut(traced(spark, ROWS), "traced")
    got, counts = triage.cluster_reports(t, 10, True)
    by = {r.file_path: r.cluster for r in got.collect()}
    # a proper prefix is at distance 0; an empty crash line repeats nothing
    assert by["a/3"] == 11 and by["a/1"] == by["b/1"] == by["b/3"] == 12 and by["a/2"] == 0
    assert tuple(counts.first()) == (2, 5, 4)
    with pytest.raises(ValueError):
        triage.cluster_reports(t.limit(1))


def test_statistics_text(spark, tmp_path):
    kind = lambda s, t="EXPLOITABLE": (t, s, "", "")
    rows = [
        (1, "a.casrep", kind("SegFaultOnPc"), "/m.c:1:2", [], None), (1, "a.gdb.casrep", kind("Own", "odd"), "", [], None), (1, "b.casrep", kind("SegFaultOnPc"), "/m.c:1:2", [], None), (1, "b.gdb.casrep", kind("Own"), "", [], None),
        (2, "c.casrep", kind("SegFaultOnPc"), "/m.c:1:9", [], None), (2, "d.casrep", None, None, None, "{"), (3, "e.casrep", kind("undefined", "NOT_EXPLOITABLE"), "/u.c:3", ["x"], None),
    ]
    df = spark.createDataFrame(rows, "cluster int, file_name string, CrashSeverity struct<Type:string,ShortDescription:string,Description:string,Explanation:string>, CrashLine string, UbsanReport array<string>, _corrupt string").withColumn("file_path", F.concat(F.lit("/r/"), "file_name"))
    lines = [r.line for r in statistics.statistics(df, prefix="/r").orderBy(*statistics.ORDER).collect()]
    assert lines == [
        "==> <cl1>", "Crash: a.casrep", "  casrep: EXPLOITABLE: SegFaultOnPc: /m.c:1:2", "  gdb.casrep: UNDEFINED: Own: a.gdb.casrep", "  Similar crashes: 2", "Cluster summary -> Own: 2 SegFaultOnPc: 2",
        "==> <cl2>", "Crash: c.casrep", "  casrep: EXPLOITABLE: SegFaultOnPc: /m.c:1:9", "  Similar crashes: 1", "Cluster summary -> SegFaultOnPc: 1",
        "==> <cl3>", "e.casrep: undefined: /u.c:3", "SUMMARY -> Own: 2 SegFaultOnPc: 3 undefined: 1",
    ]
    unique = [r.line for r in statistics.statistics(df, True, "/r").orderBy(*statistics.ORDER).collect()]
    assert "==> <cl2>" not in unique and "  Similar crashes: 1" in unique and unique[-1] == "SUMMARY -> Own: 1 SegFaultOnPc: 1 undefined: 1"
    statistics.write_statistics(statistics.statistics(df, prefix="/r"), str(tmp_path / "text"))
    assert "".join(open(os.path.join(tmp_path, "text", p)).read() for p in sorted(os.listdir(tmp_path / "text")) if p.startswith("part")).splitlines() == lines
    assert [r.line for r in statistics.statistics(df.limit(0)).collect()] == ["SUMMARY -> No crashes found"]


def test_titles_are_cut_between_characters(spark):
    row = spark.createDataFrame([("é" * 300,)], "s string").select(text.finding_title(F.lit("p"), F.lit("/b/x"), F.col("s"), F.lit("l")).alias("t")).first()
    assert len(row.t.encode()) in (499, 500) and row.t.startswith("[p] [x] é")


def test_seeds_are_renamed(spark, tmp_path):
    sinks.write_seeds(spark.createDataFrame([("crash-1-2", b"a", "oom"), ("id:3", b"b", "timeout"), ("crash-4", b"c", "error")], "name string, content binary, outcome string"), str(tmp_path / "seeds"))
    assert sorted((r.name, r.outcome) for r in spark.read.parquet(str(tmp_path / "seeds")).collect()) == [("crash-4", "error"), ("id:3", "timeout"), ("oom-1-2", "oom")]


def test_logs_to_reports(spark):
    csharp = "noise\nUnhandled exception. System.E: bad\n   at A.B() in /m.cs:line 3\n\n"
    lua = "x\nlua: m.lua:3: bad\nstack traceback:\n\tm.lua:3: in main chunk\n\nrest"
    row = spark.createDataFrame([(csharp, lua)], "c string, l string").select(traces.csharp_log(F.col("c")).alias("c"), traces.lua_log(F.col("l")).alias("l"), traces.csharp_log(F.col("l")).alias("n"), traces.lua_log(F.col("c")).alias("m")).first()
    assert row.c == ["Unhandled exception. System.E: bad", "   at A.B() in /m.cs:line 3"] and row.l[0] == "lua: m.lua:3: bad" and row.l[-1].endswith("in main chunk") and row.n is None and row.m is None


def core(width, order, machine, command, kind=4):
    o = "<" if order == 1 else ">"
    desc = bytes(elf.COMMAND[width]) + command + b"\0\0\0"
    note = struct.pack(o + "III", 5, 2, 1) + b"CORE\0\0\0\0" + b"zz\0\0" + struct.pack(o + "III", 5, len(desc), elf.PROCESS) + b"CORE\0\0\0\0" + desc
    ident = b"\x7fELF" + bytes([width // 4, order, 1]) + bytes(9)
    if width == 8:
        head = ident + struct.pack(o + "HHIQQQIHHHHHH", kind, machine, 1, 0, 64, 0, 0, 64, 56, 1, 0, 0, 0)
        return head + struct.pack(o + "IIQQQQQQ", elf.NOTES, 0, 120, 0, 0, len(note), 0, 4) + note
    head = ident + struct.pack(o + "HHIIIIIHHHHHH", kind, machine, 1, 0, 52, 0, 0, 52, 32, 1, 0, 0, 0)
    return head + struct.pack(o + "IIIIIIII", elf.NOTES, 84, 0, 0, len(note), 0, 0, 4) + note


def test_core_dumps(spark):
    rows = [("a", core(8, 1, 62, b"/bin/x -a")), ("b", core(4, 2, 40, b"run")), ("c", b"junk"), ("d", core(8, 1, 62, b"x", 2)), ("e", None), ("f", core(8, 1, 62, b"x")[:130])]
    got = {r.path: r for r in elf.cores(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert tuple(got["a"])[1:] == ("amd64", "little", 8, "/bin/x -a", None) and tuple(got["b"])[1:] == ("arm", "big", 4, "run", None)
    assert got["c"].error == got["e"].error == "not an ELF file" and got["d"].error == "not a core dump" and got["f"].error


def test_symbols(spark):
    names = b"\0main\0__asan_init\0__interceptor___msan_x\0"
    table = b"".join(struct.pack("<IBBHQQ", at, 0, 0, 0, 0, 0) for at in (0, 1, 6, 18))
    sections = bytes(64) + struct.pack("<IIQQQQIIQQ", 0, elf.SYMBOLS, 0, 0, 64, len(table), 2, 0, 8, 24) + struct.pack("<IIQQQQIIQQ", 0, 3, 0, 0, 64 + len(table), len(names), 0, 0, 1, 0)
    head = b"\x7fELF\x02\x01\x01" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 2, 62, 1, 0, 0, 64 + len(table) + len(names), 0, 64, 56, 0, 64, 3, 0)
    own = open(os.path.realpath(sys.executable), "rb").read()
    got = {r.path: r for r in elf.symbols(spark.createDataFrame([("a", head + table + names + sections), ("b", b"text"), ("c", own)], "path string, content binary")).collect()}
    assert got["a"].symbols == ["__asan", "__msan"] and got["b"].error and got["c"].error is None


def test_candidate_pairs_lose_nothing(spark):
    """Pairs by rare frames hold all pairs that are similar enough, also where most traces share frames."""
    import random

    rng = random.Random(3)
    rows = [(i, [rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))] + ["main"] * rng.randint(0, 2)) for i in range(60)]
    t = spark.createDataFrame(rows, "id long, keys array<string>")
    for least in (0.0, 0.5, 0.7):
        pairs = clustering.candidate_pairs(t, least)
        got = {(r.id_a, r.id_b) for r in pairs.select("id_a", "id_b", similarity("ka", "kb").alias("s")).where(F.col("s") > least).collect()}
        a, b = t.select(F.col("id").alias("a"), F.col("keys").alias("ka")), t.select(F.col("id").alias("b"), F.col("keys").alias("kb"))
        want = {(r.a, r.b) for r in a.crossJoin(b).where("a < b").select("a", "b", similarity("ka", "kb").alias("s")).where(F.col("s") > least).collect()}
        assert got == want


def test_distances_of_reports(spark):
    members = spark.createDataFrame([(1, 1, list("abc")), (2, 1, list("abd")), (3, 2, list("xyz"))], "id long, cluster int, keys array<string>")
    got = {(r.report_id, r.cluster): r.dist for r in clustering.report_distances(members, spark.createDataFrame([(9, list("abc")), (8, list("cq"))], "report_id long, keys array<string>")).collect()}
    assert set(got) == {(9, 1), (8, 1)} and got[8, 1] == 1.0 and 0 < got[9, 1] < 0.5


def test_clusters_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, f"r{i}") for i in range(30)], "cluster int, name string")
    sinks.write_clusters(rows, str(tmp_path / "out"))
    got = spark.read.json(str(tmp_path / "out"))
    assert sorted(r.cluster for r in got.select("cluster").distinct().collect()) == [1, 2] and got.count() == 20
