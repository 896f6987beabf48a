"""Fuzzer folders, ignore lists, contexts of crashes, and small operators that have no query."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from crashloom.functions import fixed, frames, severity, text, traces
from crashloom.operators import dedup, ignored, summary
from crashloom.plans import report_queries
from crashloom.sources import reports


def write(path, content="x"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content)


def test_folders_of_several_fuzzers(spark, tmp_path):
    for name in ("main/crashes/id:0", "main/crashes/README.txt", "second/crashes.2024/id:1", "second/queue/id:9"):
        write(tmp_path / name)
    write(tmp_path / "main" / "cmdline", " /bin/x -a @@\n")
    got = {r.name: (r.node, r.cmdline, r.vanilla) for r in reports.read_fuzzer_crashes(spark, str(tmp_path)).collect()}
    assert got == {"id:0": ("main", "/bin/x -a @@", False), "id:1": ("second", None, False)}


def test_folder_of_one_fuzzer(spark, tmp_path):
    write(tmp_path / "out" / "crashes" / "id:0")
    write(tmp_path / "out" / "cmdline", "./x @@")
    got = reports.read_fuzzer_crashes(spark, str(tmp_path / "out")).first()
    assert (got.node, got.cmdline, got.vanilla) == ("out", "./x @@", True)


def test_artifacts(spark, tmp_path):
    for name in ("crash-1", "leak-2", "timeout-3", "other", ".hidden"):
        write(tmp_path / "a" / name)
        write(tmp_path / "b" / name)
    write(tmp_path / "b" / "x.metadata")
    names = lambda d: {r.name for r in reports.read_artifacts(spark, str(tmp_path / d)).collect()}
    assert names("a") == {"crash-1", "leak-2"} and names("b") == {"crash-1", "leak-2", "timeout-3", "other", "x.metadata"}


def test_seeds_without_reports(spark):
    seeds, found = (spark.createDataFrame([(x,) for x in v], "stem string") for v in (["a", "b", "b", "c"], ["b", "d", "b"]))
    assert sorted(r.stem for r in dedup.without_sibling(seeds, found).collect()) == ["a", "c"]


def test_a_cluster_keeps_the_first_of_each_line(spark):
    rows = spark.createDataFrame([(1, "c", "f:1"), (1, "a", "f:1"), (1, "b", ""), (1, "d", ""), (2, "e", "f:1")], "cluster int, file_name string, crashline string").withColumn("keep", F.lit("mine")).withColumn("_k0", F.lit(0))
    got = dedup.dedup_crash_lines(rows)
    assert {(r.file_name, r.cluster, r.keep) for r in got.collect()} == {("a", 1, "mine"), ("c", 0, "mine"), ("b", 1, "mine"), ("d", 1, "mine"), ("e", 2, "mine")} and got.columns == rows.columns
    assert sorted(r.file_name for r in dedup.dedup(rows, ("crashline",)).collect()) == ["a", "b"]
    unique = summary.unique_lines(rows.withColumn("_line", F.lit(1)))
    assert sorted(r.file_name for r in unique.collect()) == ["a", "b", "d"] and unique.columns == [*rows.columns, "_line"]


def test_warning_counts(spark):
    rows = spark.createDataFrame([("a", 1, "/m.c:3:1"), ("a", 2, "/m.c:3:9"), ("b", 1, "/m.c:4:1"), ("b", 2, "")], "input string, nth int, crashline string")
    assert tuple(summary.ubsan_dedup_counts(rows).first()) == (4, 3) and summary.ubsan_dedup(rows).count() == 3
    assert tuple(summary.ubsan_dedup_counts(rows.limit(0)).first()) == (0, 0)


def test_out_of_memory(spark):
    logs = ["==1==AddressSanitizer: hard rss limit exhausted (2048Mb vs 2050Mb)", "==1==ERROR: AddressSanitizer: out-of-memory", "==1==ERROR: AddressSanitizer: SEGV", ""]
    assert [r.x for r in spark.createDataFrame([(i, x) for i, x in enumerate(logs)], "i int, t string").orderBy("i").select(text.out_of_memory(F.col("t")).alias("x")).collect()] == [True, True, False, False]


def test_overrides_and_registers(spark):
    cpp = "terminate called after throwing an instance of 'A'\n  what():  b\n"
    rust = "thread 'main' panicked at 'bad', m.rs:1:2\n"
    base = severity.own_class(F.lit("SourceAv"), F.lit("d"))
    got = spark.createDataFrame([(0, cpp + rust), (1, rust), (2, "x")], "i int, t string").orderBy("i").select(severity.overridden(base, F.col("t"))["ShortDescription"].alias("s")).collect()
    assert [r.s for r in got] == ["A", "RustPanic", "SourceAv"]
    rows = spark.createDataFrame([("amd64", {"rip": 1, "rsp": 2}), ("i386", {"eip": 3, "esp": 4}), ("arm", {"pc": 5, "sp": 6}), ("arm64", {})], "arch string, r map<string,long>")
    found = rows.select(severity.pc_register(F.col("arch"), F.col("r")).cast("int").alias("p"), severity.sp_register(F.col("arch"), F.col("r")).cast("int").alias("s")).collect()
    assert [tuple(x) for x in found] == [(1, 2), (3, 4), (5, 6), (None, None)]


def test_formats_and_python_runs(spark):
    asan, msan = "==1==ERROR: AddressSanitizer: SEGV on x\n    #0 0x1 in f\n", "==1==WARNING: MemorySanitizer: use-of-uninitialized-value\n"
    rows = spark.createDataFrame([(0, asan, 6, ""), (1, msan, 0, ""), (2, "nothing", 11, ""), (3, "nothing", 0, ""), (4, "Traceback (most recent call last):\n", 0, ""), (5, asan, 6, " === Uncaught Python exception: ===\nA: b")], "i int, t string, s int, o string").orderBy("i")
    got = rows.select(traces.log_format(F.col("t"), F.col("s")).alias("f"), traces.python_log(F.col("t"), F.col("o")).alias("p")).collect()
    assert [r.f for r in got] == ["asan", "msan", "gdb", None, None, "asan"]
    assert [r.p.kind for r in got] == ["san", "san", "san", "san", "python", "python"] and got[0].p.text == asan and got[5].p.text.endswith("A: b")


@pytest.mark.parametrize("kind", ["IGNORED_FUNCTIONS", "IGNORED_FILES"])
def test_every_expression_of_the_lists(spark, kind):
    """Names after each expression, cut and changed at random, are found as by all expressions one after another."""
    rng = random.Random(7)
    lists = getattr(fixed, kind)
    patterns = ignored.listed(lists, [*lists, "unknown"], ["^my(own|)_", "mine$", r"a\.b", "^x|y"])
    names = report_queries.examples({k: v for k, v in lists.items()}) + ["my_f", "myown_g", "is mine", "a.b", "axb", "zy", "x", ""]
    assert all(any(re.search(p, n) for n in names) for lang in fixed.CLUSTER_LANGS for p in lists.get(lang, []))
    for n in list(names):
        at = rng.randrange(len(n) + 1)
        names += ["q" + n, n + "q", n[:-1], n[:at] + "q" + n[at:]]
    got = {r.name for r in ignored.matched(spark.createDataFrame([(n,) for n in names * 2], "name string"), patterns).collect()}
    assert got == {n for n in names if n and any(re.search(p, n) for p in patterns)}
    heads, whole, others = ignored.sorted_out(patterns)
    assert len(others) < len(patterns) and "^x|y" in others


def test_frames_without_ignored_ones(spark):
    """The same frames as by expressions on each frame, with columns named as the operator's own, nulls and empty traces."""
    rng = random.Random(3)
    names, files = report_queries.examples(fixed.IGNORED_FUNCTIONS) + ["f", "g", "LLVMFuzzerTestOneInput", ""] * 20, report_queries.examples(fixed.IGNORED_FILES) + ["/a.c", ""] * 30
    frame = lambda: (rng.choice(names), rng.choice(["", "", "/lib/x", "/usr/lib/libc.so.6"]), (rng.choice(files),))
    rows = [(i, [frame() for _ in range(rng.randrange(9))]) for i in range(150)] + [(150, None), (150, [])]
    df = spark.createDataFrame(rows, "id int, frames array<struct<function:string,module:string,debug:struct<file:string>>>").withColumn("_row", F.lit("r")).withColumn("_frames", F.lit(0))
    got = ignored.without_ignored(df, functions=["^g$"])
    want = df.withColumn("frames", frames.filtered(F.col("frames"), functions=["^g$"]))
    key = lambda r: (r.id, str(r.frames), r["_row"])
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) and got.columns == df.columns
