"""Merkle manifests, conversation repair and personal data against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from crashloom.llm import common, conversations, merkle, personal_data


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(*fields):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def plain_path(leaves, i):
    """The root and the levels of others above leaf i."""
    path = []
    while len(leaves) > 1:
        path.append((i % 3, [x for k, x in enumerate(leaves[i - i % 3 : i - i % 3 + 3]) if k != i % 3]))
        leaves, i = [sha("".join(leaves[k : k + 3])) for k in range(0, len(leaves), 3)], i // 3
    return leaves[0], path


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, at long, d string"


def plain_manifest(rows):
    """{(doc_id, leaf): [(subroot, root, path)]}."""
    first = lambda v: (v is not None, v if v is not None else 0)
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((first(r[0]), leaf_of(r[0], r[3], r[2], r[4], r[1])))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    ordered = {g: [x for _, x in sorted(v)] for g, v in groups.items()}
    roots = [plain_path(ordered[g], 0)[0] for g in names]
    out = {}
    for n, g in enumerate(names):
        root, top = plain_path(roots, n)
        for i, (k, x) in enumerate(sorted(groups[g])):
            out.setdefault((k[1] if k[0] else None, x), []).append((roots[n], root, plain_path(ordered[g], i)[1] + top))
    return out


@pytest.mark.parametrize("sources, rows", [(1, 1), (1, 300), (3, 40), (100, 160), (2, 3)])
def test_manifest(spark, sources, rows):
    """Trees of one leaf to three pages, nulls in each field, repeated rows and ids, and columns named as the operator's own."""
    rng = random.Random(rows)
    some = lambda x: None if rows > 2 and rng.random() < 0.1 else x
    data = [(some(rng.randrange(rows)), some(f"é\n{rng.randrange(9)}"), some("en"), some(f"s{rng.randrange(sources)}"), some(3), "x", 7, "y") for _ in range(rows)]
    data += data[:2]
    df = spark.createDataFrame(data, SCHEMA)
    want = plain_manifest(data)
    got = merkle.prove(df).select("*", merkle.proof_digest(F.col("proof")).alias("digest")).collect()
    assert len(got) == len(data)
    for r in got:
        proof = [(s.digit, list(s.others)) for s in r.proof]
        assert (r.subroot, r.root, proof) in want[r.doc_id, r.leaf] and r.verified and r.folded_root == r.root
        assert r.digest == sha("".join(x for _, others in proof for x in others))
    assert merkle.prove(df.limit(0)).count() == 0


def test_tampering_is_found(spark):
    data = [(i, f"a\n{i}", "en", "s", 1, "", 0, "") for i in range(20)]
    df = spark.createDataFrame(data, SCHEMA)
    suspect = F.when(F.col("doc_id") == 3, merkle.digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.translate("text", "\n", "")))
    got = {r.doc_id: r for r in merkle.prove(df, suspect=suspect).collect()}
    assert {k for k, r in got.items() if not r.verified} == {3} and got[3].leaf == leaf_of(3, "s", "en", 1, "a\n3")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_text, turn_text, role, text = (" " if x is None else str(x) for x in (conv, turn, role, text))
        code = zlib.crc32(f"{conv_text}:{turn_text}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(code, text)
        out += [(conv, turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    return out


def plain_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired rows) of one conversation, by trying all edits from the end."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), sha(r[3])))
    faults, seen = [], set()
    for _, _, role, text in rows:
        ink = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("b" if not ink else "d" if (role, text) in seen else "t" if ink[-1] not in ".!?" else "-")
        seen.add((role, text))
    turns = {r[1] for r in rows if r[1] is not None}
    initials = [r[2][:1] for r in rows]
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    behind = None
    for i in range(len(rows), -1, -1):
        now = {q: ((0, "", ()) if q in (0, 3) else (1 << 40, "~", ())) if i == len(rows) else (1 << 40, "~", ()) for q in range(4)}
        if i < len(rows):
            extra = faults[i] == "t"
            for q in range(4):
                ways = [(behind[q][0] + 3, "D" + behind[q][1], behind[q][2])]
                if faults[i] not in "bd":
                    if (q, initials[i]) in step:
                        c, a, r = behind[step[q, initials[i]]]
                        ways.append((c + extra, "K" + a, ((rows[i][2], rows[i][3]), *r)))
                    to, role = (3, "assistant") if q == 2 else (2, "user")
                    c, a, r = behind[to]
                    ways.append((c + 2 + extra, "R" + a, ((role, rows[i][3]), *r)))
                now[q] = min(ways)
        for _ in range(3):
            for q in range(4):
                to, role = (3, "assistant") if q == 2 else (2, "user")
                c, a, r = now[to]
                now[q] = min(now[q], (c + 2, "I" + a, ((role, ""), *r)))
        behind = now
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, *behind[0])


@pytest.mark.parametrize("block", [256, 3])
def test_repair(spark, block):
    """Short and long conversations, nulls in each column, equal turns, odd roles, and ways that only differ after many letters."""
    rng = random.Random(5)
    texts = ["Yes.", "No!", "and then", "", " \t", None, "ok?  \n", "é", "Yes."]
    rows = []
    for conv in [None, *range(30)]:
        for t in range(rng.choice((1, 2, 5, 9, 14))):
            rows.append((conv, rng.choice((t, t, t, None, t // 2)), rng.choice(("user", "assistant", "system", "tool", "", None, "user", "assistant")), rng.choice(texts)))
    # all-equal costs for many letters: users only, and doubled assistants
    rows += [(100, t, "user", f"line {t}.") for t in range(41)] + [(101, t, ("user", "assistant", "assistant")[t % 3], f"l {t}.") for t in range(60)] + [(102, t, "user", "same.") for t in range(30)]
    df = conversations.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1)).withColumn("c", F.lit(2)))
    damaged = plain_damage(rows)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, df.collect()), key=key) == sorted(damaged, key=key)
    report, repaired = conversations.repair(df, block)
    edits = {}
    for r in repaired.collect():
        edits.setdefault(r.conv_id, []).append((r.place, r.edit, r.role, r.text))
    digests = {r.conv_id: (r.audit, r.sha256) for r in conversations.digests(repaired).collect()}
    got = {r.conv_id: r for r in report.collect()}
    assert set(got) == {r[0] for r in damaged}
    for conv, r in got.items():
        *counts, cost, audit, kept = plain_repair([x for x in damaged if x[0] == conv])
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost) == (*counts, cost), conv
        mine = sorted(edits.get(conv, []))
        assert [x[0] for x in mine] == list(range(len(mine))) and "".join(x[1] for x in mine) == audit
        assert [(x[2], x[3]) for x in mine if x[1] != "D"] == list(kept)
        assert digests[conv] == (audit, sha("\n".join(f"{a}:{b}" for a, b in kept)))
    assert len(digests[101][0]) > 32, "ranks are ranked anew behind the letters of a number"
    none = conversations.repair(df.limit(0))
    assert none[0].count() == none[1].count() == 0


def plain_personal(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(x) for x in m[0] if x.isdigit()]
        if 16 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(x.isdigit() for x in m[0]) <= 15]


def test_plain_personal_data():
    rng = random.Random(1)
    order = lambda s: (personal_data.KINDS.index(s[0]), s[1])
    for _ in range(20_000):
        t = "".join(rng.choice("aB1209..@@-+ ()%é") for _ in range(rng.randrange(60)))
        assert [(personal_data.KINDS[k], b, e) for k, b, e, _ in personal_data.find(t)[0]] == sorted(plain_personal(t), key=order), t
        t = "".join(rng.choice(["one", "dot", "at", " ", "-", "(at)", "[dot]", "7", "x", "@", ".", "plus", "​", "о", "<"]) for _ in range(rng.randrange(40)))
        base, spans = personal_data.find(t)
        assert [(personal_data.KINDS[k], b, e) for k, b, e, _ in base] == sorted(plain_personal(t), key=order) and set(base) <= set(spans)


DISGUISED = [
    ("mail é john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com", "john.doe@example.com"),
    ("john at example dot co dot uk, ok", "email", "john at example dot co dot uk", "john@example.co.uk"),
    ("Ann(at)mail(dot)org", "email", "Ann(at)mail(dot)org", "Ann@mail.org"),
    ("j​ohn@exam​ple.com", "email", "j​ohn@exam​ple.com", "john@example.com"),
    ("ѕue＠example.com", "email", "ѕue＠example.com", "sue@example.com"),
    ("call plus four nine one five one two three four five six seven ok", "phone", "plus four nine one five one two three four five six seven", "+49151234567"),
    ("plus 49 151 234 Five six-seven", "phone", "plus 49 151 234 Five six-seven", "+49 151 234 567"),
    ("one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one", "192.168.0.1"),
    ("٤929 3483 8514 six three zero six", "card", "٤929 3483 8514 six three zero six", "4929 3483 8514 6306"),
]


@pytest.mark.parametrize("text, kind, source, value", DISGUISED)
def test_disguised_personal_data(text, kind, source, value):
    base, spans = personal_data.find(text)
    assert [(personal_data.KINDS[k], text[b:e], v) for k, b, e, v in spans if (k, b, e, v) not in base] == [(kind, source, value)]


def test_clean_texts_have_no_personal_data():
    for t in ("meet me at example.com", "look at one dot two", "at x dot com", "one two three", "plus four", "dots [.] and (at) signs", "", "есть"):
        assert personal_data.find(t) == ([], [])


def test_long_runs_take_linear_time():
    began = time.time()
    for piece in ("1", "a", "1.", " ", "one ", "@", "a@", "+1", "((([", "1 ", "at ", "a dot ", "a.dot.", "​"):
        personal_data.find(piece * (200_000 // len(piece)))
    assert time.time() - began < 20


def test_personal_data_of_documents(spark):
    rows = [(1, "a@b.c x"), (2, None), (3, ""), (4, "w " * 60_000 + "a@b.c"), (4, "w " * 60_000 + "a@b.c"), (None, "+49 151 2345678 and 1.2.3.4")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(0)).withColumn("base", F.lit(0))
    got = [(r.doc_id, r.s) for r in personal_data.scan(df).select("doc_id", personal_data.rendered(F.col("spans")).alias("s")).collect()]
    assert sorted(got, key=str) == sorted([(1, "email:0:5"), (2, ""), (3, ""), (4, "email:120000:120005"), (4, "email:120000:120005"), (None, "ip:20:27,phone:0:15")], key=str)
    assert personal_data.scan(df.limit(0)).count() == 0


def test_ranks_over_ranges(spark):
    """Places and sizes of groups that lie in several ranges; nulls are a group and come first."""
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i) for i in range(500)]
    got = common.ranked(spark.createDataFrame(rows, "g string, o long").repartition(7), ["g"], ["o"], "at", "test-ranks", total="n").collect()
    for g in ("a", "b", None):
        held = sorted(o for x, o in rows if x == g)
        assert sorted((r.at, r.o, r.n) for r in got if r.g == g) == [(i, o, len(held)) for i, o in enumerate(held)]
