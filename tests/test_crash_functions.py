"""Parsers, filters, similarity and clustering against values worked out by hand or by plain Python."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from crashloom.functions import frames, severity, similarity, text, traces
from crashloom.operators import clustering, dedup, incremental, instructions


def parsed(spark, lang, entries):
    row = spark.createDataFrame([(entries,)], "e array<string>").select(frames.parse(F.col("e"), lang).alias("p")).first().p
    return row.error, [(int(f.address), f.function, f.module, int(f.offset), f.debug.file, f.debug.line, f.debug.column) for f in row.frames]


def test_sanitizer_frames(spark):
    error, got = parsed(spark, "asan", [
        "    #0 0x55 in one(int, char) const /src/a b/f.cpp:12:7",
        "    #1 0x7f (/lib/libc.so.6+0x1f) (BuildId: 00)",
        "#2 0x10 in typeinfo name for ns::type (/bin/t+0xa0)",
        "  #3 0x11 in main /src/m.c:3",
        "  #4 0x12 in plain",
    ])
    assert error is None
    assert got == [
        (0x55, "one(int, char) const", "", 0, "/src/a b/f.cpp", 12, 7), (0x7F, "", "/lib/libc.so.6", 0x1F, "", 0, 0), (0x10, "ns::type", "/bin/t", 0xA0, "", 0, 0),
        (0x11, "main", "", 0, "/src/m.c", 3, 0), (0x12, "plain", "", 0, "", 0, 0),
    ]
    assert parsed(spark, "asan", ["#0 no address"])[0] is not None
    assert parsed(spark, "asan", ["#0 0x1 in f /src/m.c:x:1"])[0] is not None


@pytest.mark.parametrize("lang, entry, want", [
    ("python", 'File "/a/b.py", line 7, in run', (0, "run", "", 0, "/a/b.py", 7, 0)),
    ("go", "main.work(0x1) in /g/m.go:41 +0x5", (0, "main.work(0x1)", "", 0, "/g/m.go", 41, 0)),
    ("java", "at org.a.B.c(B.java:9)", (0, "org.a.B.c", "", 0, "B.java", 9, 0)),
    ("rust", "3: 0x55aa - app::go at /r/m.rs:8:2", (0x55AA, "app::go", "", 0, "/r/m.rs", 8, 2)),
    ("js", "at run [as go] (file:///j/a.js:5:3)", (0, "run [as go]", "", 0, "/j/a.js", 5, 3)),
    ("js", "at node:internal/x:1:2", (0, "", "", 0, "<anonymous>", 1, 2)),
    ("js", "at eval (eval at run (/j/a.js:10:4), <anonymous>:5:9)", (0, "eval at run", "", 0, "/j/a.js", 12, 9)),
    ("csharp", "at A.B(System.String) in /c/a.cs:line 4", (0, "A.B(System.String)", "", 0, "/c/a.cs", 4, 0)),
    ("csharp", "at A.B () <0x10 + 0x05> in <ab12>:0", (0x15, "A.B()", "", 0, "ab12", 0, 0)),
    ("lua", "/l/a.lua:6: in function 'go'", (0, "go", "", 0, "/l/a.lua", 6, 0)),
    ("gdb", "#1  0x000000ff in f (x=1) at /g/f.c:2", (0xFF, "f", "", 0, "/g/f.c", 2, 0)),
])
def test_frames_of_other_formats(spark, lang, entry, want):
    assert parsed(spark, lang, [entry]) == (None, [want])


def test_python_repeats(spark):
    marker = "[Previous line repeated 2 more times]"
    error, got = parsed(spark, "python", ['File "a.py", line 1, in f', marker, 'File "a.py", line 2, in g'])
    assert error is None and [f[5] for f in got] == [1, 1, 1, 2]
    assert parsed(spark, "python", [marker, 'File "a.py", line 1, in f'])[0] is not None


def test_extraction(spark):
    logs = {
        "python": "noise\nTraceback (most recent call last):\n  File \"a.py\", line 1, in f\n    x\n  File \"b.py\", line 2, in g\n    y\nValueError: bad\n",
        "go": "panic: oops\n\ngoroutine 1 [running]:\nmain.f()\n\t/g/a.go:3 +0x1\nmain.main()\n\t/g/a.go:9 +0x2\n\nexit status 2",
        "java": "Exception in thread \"main\" A: x\n\tat a.B.c(B.java:1)\n\tat a.B.m(B.java:2)\nCaused by: C: y\n\tat a.D.e(D.java:5)\n\t... 1 more",
        "asan": "==1==ERROR\n    #0 0x1 in f /a.c:1\n    #1 0x2 in main /a.c:2\n\nSUMMARY: x",
    }
    want = {
        "python": ['File "b.py", line 2, in g', 'File "a.py", line 1, in f'],
        "go": ["main.f() in /g/a.go:3 +0x1", "main.main() in /g/a.go:9 +0x2"],
        "java": ["at a.D.e(D.java:5)", "at a.B.m(B.java:2)"],
        "asan": ["    #0 0x1 in f /a.c:1", "    #1 0x2 in main /a.c:2"],
    }
    for lang, log in logs.items():
        assert spark.createDataFrame([(log,)], "t string").select(traces.EXTRACTORS[lang](F.col("t")).alias("x")).first().x == want[lang], lang


@pytest.mark.parametrize("word, mask", [("aa", "-k"), ("aaaaa", "----k"), ("aabcaabca", "-----kkkk"), ("abcaacaacaac", "kk------k-kk"), ("", ""), ("abc", "kkk")])
def test_repeat_mask(word, mask):
    assert "".join("k" if k else "-" for k in frames.repeat_mask(list(word))) == mask


def test_folding_is_idempotent():
    keys = list("xabababyzyzyzq")
    left = [k for k, m in zip(keys, frames.folded(keys)) if m]
    assert "".join(left) == "xabyzq" and all(frames.folded(left))


def plain_similarity(a, b):
    m = [[0.0] * (len(a) + 1) for _ in range(len(b) + 1)]
    for i in range(1, len(b) + 1):
        for j in range(1, len(a) + 1):
            gain = math.exp(-(0.04 * min(i, j) + 0.13 * abs(i - j))) if a[j - 1] == b[i - 1] else 0.0
            m[i][j] = max(m[i][j - 1], m[i - 1][j], m[i - 1][j - 1] + gain)
    return m[-1][-1] / sum(math.exp(-0.04 * i) for i in range(1, min(len(a), len(b)) + 1))


def test_similarity(spark):
    pairs = [("abc", "abc"), ("abcd", "abxd"), ("ab", "abcd"), ("xyz", "abc"), ("aab", "ba")]
    rows = spark.createDataFrame([(list(a), list(b)) for a, b in pairs], "a array<string>, b array<string>")
    got = rows.select(similarity.similarity("a", "b").alias("s"), similarity.upper_bound("a", "b").alias("u")).collect()
    for (a, b), r in zip(pairs, got):
        assert r.s == pytest.approx(plain_similarity(a, b), abs=1e-12) and r.u >= r.s - 1e-12
    assert got[0].s == pytest.approx(1) and got[2].s == pytest.approx(1)


def brute_clusters(items):
    """Complete linkage over all pairs, without candidates or components."""
    reps = {}
    for i, k in sorted(items.items()):
        reps.setdefault(tuple(k), []).append(i)
    groups = [[k] for k in reps]
    dist = lambda g, h: max(1 - plain_similarity(a, b) for a in g for b in h)
    while True:
        best = min(((round(dist(g, h), 12), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j), default=(1, 0, 0))
        if best[0] >= 0.3:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(i for k in g for i in reps[k]) for g in groups}


def test_clusters(spark):
    items = {i: list(w) for i, w in enumerate(["abcdef", "abcdeg", "xyz", "abcdef", "xyw", "mnop", "mnoq", "abzdef"])}
    got = clustering.cluster(spark.createDataFrame(list(items.items()), "id long, keys array<string>")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.cluster, set()).add(r.id)
    assert {frozenset(g) for g in groups.values()} == brute_clusters(items)
    assert sorted(groups) == list(range(1, len(groups) + 1))
    sizes = [len(groups[k]) for k in sorted(groups)]
    assert sizes == sorted(sizes, key=lambda n: n > 1), "single traces are numbered first"


def test_empty_clusters(spark):
    assert clustering.cluster(spark.createDataFrame([], "id long, keys array<string>")).count() == 0


def test_update(spark):
    members = spark.createDataFrame([(1, 1, list("abcd"), "f:1"), (2, 1, list("abce"), "f:2"), (3, 2, list("uvwx"), "g:1")], "id long, cluster int, keys array<string>, crashline string")
    new = spark.createDataFrame([(10, list("abcd"), "f:1"), (11, list("zzyy"), "h:1"), (12, list("zzyx"), "h:1"), (13, list("abcf"), "f:2")], "report_id long, keys array<string>, crashline string")
    got = {r.report_id: (r.outcome, r.cluster) for r in incremental.update(members, new, True).collect()}
    assert got["10"] == ("duplicate", None)
    assert got["11"][0] == "new" and got["11"][1] == 3
    assert got["13"] == ("deduplicated", 1)
    assert len(got) == 4


def plain_update(members, new, unique_lines):
    """Insertion one by one: {report_id: (outcome, cluster)}, deviants left out, and the clusters afterwards."""
    clusters, lines, out = {}, {}, {}
    for _, c, k, line in sorted(members):
        clusters.setdefault(c, []).append(k)
        lines.setdefault(c, set()).add(line)
    dist = lambda a, b: 1 - plain_similarity(a, b)
    for r, k, line in sorted(new):
        inner, dup = [], False
        for c, held in clusters.items():
            width, kind = max((dist(a, b) for a in held for b in held if a is not b), default=0.0), "inner"
            for m in held:
                if dist(k, m) == 0 or dist(k, m) > 0.3:
                    kind = "dup" if dist(k, m) == 0 else "outer"
                    break
            if kind == "inner" and width >= max(dist(k, m) for m in held):
                inner.append((width, c))
            dup |= kind == "dup"
        if dup:
            out[r] = ("duplicate", None)
        elif inner:
            c = min(inner)[1]
            out[r] = ("added", c)
            if unique_lines and line and line in lines[c]:
                out[r] = ("deduplicated", c)
            else:
                clusters[c].append(k)
                lines[c].add(line)
    return out, clusters


MEMBERS = "id long, cluster int, keys array<string>, crashline string"
REPORTS = "report_id long, keys array<string>, crashline string"


def test_update_within_a_batch(spark):
    """Two reports that fit a cluster but not each other, a proper prefix of the one that is added, and a copy of the other."""
    members = [(1, 1, list("abcdefghij"), "f:1"), (2, 1, list("abcdexyzij"), "f:2")]
    new = [(9, list("abcdefgzip"), "f:9"), (10, list("abcdexghqj"), "f:10"), (11, list("abcdefgzi"), "f:11"), (12, list("abcdexghqj"), "f:12")]
    assert plain_update(members, new[1:2], True)[0] == {10: ("added", 1)}, "it fits without the other"
    got = {r.report_id: (r.outcome, r.cluster) for r in incremental.update(spark.createDataFrame(members, MEMBERS), spark.createDataFrame(new, REPORTS), True).collect()}
    assert got == {"9": ("added", 1), "10": ("new", 2), "11": ("duplicate", None), "12": ("new", 2)}


@pytest.mark.parametrize("unique_lines", [False, True])
def test_update_as_one_by_one(spark, unique_lines):
    rng = random.Random(3)
    base = {1: "abcdefghij", 2: "klmnopqrst", 3: "abcdefklmn"}

    def near(c):
        k = list(base[c])
        for _ in range(rng.randrange(3)):
            k[rng.randrange(3, len(k))] = rng.choice("uvw")
        return k[: rng.choice((10, 10, 9, 8))]

    line = lambda: rng.choice(["", *(f"f:{i}" for i in range(12))])
    members = [(i, c, near(c), line()) for i, c in enumerate((1, 1, 1, 2, 2, 3, 3))]
    new = [(i, near(rng.choice((1, 2, 3))), line()) for i in range(5, 105)]
    want, after = plain_update(members, new, unique_lines)
    kinds = [x for x, _ in want.values()]
    assert len(kinds) - kinds.count("duplicate") > 2 and ("deduplicated" in kinds) == unique_lines and len(want) < len(new)
    got = {int(r.report_id): (r.outcome, r.cluster) for r in incremental.update(spark.createDataFrame(members, MEMBERS), spark.createDataFrame(new, REPORTS), unique_lines).collect()}
    assert {r: got[r] for r in want} == want and len(got) == len(new)
    # deviants meet the clusters as they are after the insertions
    for r, k, _ in new:
        if got[r][0] in ("moved", "removed"):
            assert all(1 - plain_similarity(k, m) < 0.3 for m in after[got[r][1]])


def test_first_of_nulls_and_empty(spark):
    rows = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "k string, o int")
    assert sorted(r.o for r in dedup.dedup(rows, ("k",), ("o",)).collect()) == [1, 2]
    assert dedup.dedup(rows.limit(0), ("k",), ("o",)).count() == 0


def test_sanitizer_class(spark):
    lines = ["==1==ERROR: AddressSanitizer: SEGV on unknown address 0x000000000010 (pc 0x1)", "The signal is caused by a READ memory access.", "SUMMARY: AddressSanitizer: SEGV /a.c:1 in f"]
    leak = ["==1==ERROR: LeakSanitizer: detected memory leaks"]
    rows = spark.createDataFrame([(lines,), (leak,), (["x"],)], "l array<string>").select(severity.sanitizer_short(F.col("l")).alias("s")).collect()
    assert [r.s for r in rows] == ["SourceAvNearNull", "memory-leaks", None]


def test_instructions():
    c = instructions.classify
    assert c(["ret"], "amd64", 1 << 20, 0) == "ReturnAv"
    assert c(["call 0x1"], "amd64", 992, 1000) == "StackOverflow"
    assert c(["mov qword ptr [rax], rbx"], "amd64", 0, 0) == "DestAvNearNull"
    assert c(["mov rax, [rbx]", "mov [rax], rcx"], "amd64", 1 << 20, 0) == "DestAvTainted"
    assert c(["mov rax, [rbx]", "mov [rax], 1", "jmp rax"], "amd64", 1 << 20, 0) == "BranchAvTainted"
    assert c(["ldr x0, [x1]", "add x2, x0, #8", "blr x2"], "arm64", 1 << 20, 0) == "CallAvTainted"
    assert c(["ldr x0, [x1]", "add x2, x0, #8", "br x2"], "arm64", 1 << 20, 0) == "SourceAv"
    assert c(["sw a0, 0(a1)"], "riscv64", 1 << 20, 0) == "DestAv"
    assert c([], "amd64", 0, 0) is None


def test_instruction_rules_by_signal_and_code():
    c, far, kernel = instructions.classify, 1 << 20, instructions.SI_KERNEL
    tainted = ["mov rax, qword ptr [rbx]", "call rax"]
    assert c(tainted, "amd64", 8, 0) == "SourceAvNearNull"
    assert c(tainted, "amd64", 8, 0, code=kernel) == c(tainted, "amd64", far, 0) == "CallAvTainted"
    assert c(tainted, "amd64", far, 0, signal=instructions.SIGBUS) == "SourceAv"
    assert c(["mov [rdi], eax"], "amd64", 8, 0, signal=instructions.SIGBUS) == "DestAv"
    assert c(["jmp 0x1234"], "amd64", far, 0) == "AccessViolation"
    assert c(["jmp qword ptr [rip + 0x10]"], "amd64", far, 0) == "BranchAv"
    assert c(["cmovne eax, [rbx]"], "amd64", far, 0) == "SourceAv"
    assert c(["rep movsb"], "amd64", far, 0) == c(["rep movsb byte ptr [rdi], byte ptr [rsi]"], "amd64", far, 0) == "DestAv"
    assert c(["add eax, [rbx]"], "amd64", far, 0) == "AccessViolation"
    assert c(["movzx eax, byte ptr [rbx]", "call rax"], "amd64", far, 0) == "SourceAv"
    assert c(["mov rax, [rbx]", "xchg rax, rcx", "jmp rcx"], "amd64", far, 0) == "BranchAvTainted"
    assert c(["mov rax, [rbx]", "lea rcx, [rax + 8]", "mov rax, 5", "jmp [rcx*8]"], "amd64", far, 0) == "BranchAvTainted"
    assert c(["mov rsp, [rbx]", "ret"], "amd64", far, 0) == "ReturnAv"


def test_instruction_rules_of_other_processors():
    c, far = instructions.classify, 1 << 20
    for isa in ("arm", "arm64", "riscv64"):
        assert c(["nop"], isa, far, 0) == c(["bl 0x10"], isa, far, 0) == "AccessViolation"
    assert c(["ldr pc, [r0]"], "arm", far, 0) == "SegFaultOnPc"
    assert c(["ldr r1, [r0]", "moveq pc, r1"], "arm", far, 0) == "SegFaultOnPc"
    assert c(["ldr r1, [r0]", "adds r2, r1, #1", "bx r2"], "arm", far, 0) == "BranchAvTainted"
    assert c(["ldrb r1, [r0]", "bx lr"], "arm", 8, 0) == "SourceAvNearNull"
    assert c(["strh r1, [r0]"], "arm", 8, 0) == "DestAvNearNull"
    assert c(["ldm r0, {r1, r2}"], "arm", far, 0) == "AccessViolation"
    assert c(["ldp x0, x1, [x2]", "stp x3, x4, [x1, #16]"], "arm64", far, 0) == "DestAvTainted"
    assert c(["ldr x0, [x1]", "b.eq 0x10", "blr x0"], "arm64", far, 0) == "SourceAv"
    assert c(["ld a0, 0(a1)", "add a2, a0, a3", "jalr a2"], "riscv64", far, 0) == "CallAvTainted"
    assert c(["ld a0, 0(a1)", "addi a0, a3, 1", "jalr a0"], "riscv64", far, 0) == "SourceAv"
    assert c(["ld a0, 0(a1)", "sd a5, 8(a0)"], "riscv64", far, 0, code=instructions.SI_KERNEL) == "DestAvTainted"


def test_instructions_behind_the_sixteenth():
    c = instructions.classify
    assert c(["mov rax, [rbx]", *["inc ecx"] * 20, "call rax"], "amd64", 1 << 20, 0) == "CallAvTainted"
    assert c(["lw a0, 0(a1)", *["addi a2, a2, 1"] * 30, "sw a3, 0(a0)"], "riscv64", 1 << 20, 0) == "DestAvTainted"
    assert c(["mov rax, [rbx]", "ret", *["inc ecx"] * 20, "call rax"], "amd64", 1 << 20, 0) == "SourceAv"


def test_crash_line_text(spark):
    row = spark.createDataFrame([("/a/f.c:12:5", "/a/./b/../c.h")], "l string, p string").select(text.without_column(F.col("l")).alias("l"), text.normal_path(F.col("p")).alias("p"), text.strip_prefix(F.col("p"), "/a").alias("s")).first()
    assert (row.l, row.p, row.s) == ("/a/f.c:12", "/a/c.h", "./b/../c.h")
