"""The training-data operators against brute force, exact round trips and held-out accuracy, with awkward inputs."""

from __future__ import annotations

import hashlib
import os
import random
import struct
import subprocess
import sys
import re
import time
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crashloom.llm import common, decontamination, gif_media, language_id, line_dedup, ngram_join, packing, queries, secret_scan, shingles, token_counts, toxicity, url_rules

DATA = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
LONG = " ".join(f"w{i}" for i in range(30_000))


def docs(spark, texts):
    """Documents with null and repeated ids and a column whose name operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "src0", 0, 1.5) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long, score double")


AWKWARD = [(0, None), (1, ""), (2, "   \n\t "), (3, "a"), (4, LONG), (4, LONG), (5, LONG), (6, "\U0001f600 é \n\n"), (7, "the same words again and again"), (8, "the same words again and again")]


@given
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = queries.QUERIES[name](spark, DATA)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=key) == sorted(want.fetchall(), key=key)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_shingles_match_plain_sets():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB \t\né") for _ in range(rng.randrange(60))) for _ in range(300)] + [None, "", LONG]
    got = list(shingles.shingle_sets(pa.array(texts)))
    assert [len(g) for g in got] == [len(shingle_set(t)) for t in texts]
    seen = {}
    for t, g in zip(texts, got):
        assert seen.setdefault(frozenset(shingle_set(t)), tuple(g)) == tuple(g)
    assert len(set(seen.values())) == len(seen)


def brute_components(texts):
    sets = [shingle_set(t) for _, t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and 100 * k >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(texts):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(texts))


def test_ngram_join(spark):
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(400)]
    texts = []
    for n in (4, 6, 8, 9, 10, 12, 15, 40, 41, 120):
        base = [rng.choice(vocab) for _ in range(n)]
        for k in range(6):  # copies with up to k changed, dropped or added words
            w = list(base)
            for _ in range(k):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice([[], [rng.choice(vocab)], [w[i], rng.choice(vocab)]])
            texts.append((100 + len(texts), " ".join(w)))
    texts += [(900 + i, t) for i, (_, t) in enumerate(AWKWARD) if t != LONG]
    got = sorted(tuple(r) for r in ngram_join.join(docs(spark, texts)).collect())
    assert got == brute_components(texts)
    kept = {r.doc_id for r in ngram_join.keep_one(docs(spark, texts)).collect()}
    assert kept == {d for d, _, c in got if d == c}


def test_shingles_need_little_memory():
    texts = pa.array([" ".join(f"w{i * k}" for i in range(1500)) for k in range(1, 301)])
    tracemalloc.start()
    sizes = [len(s) for s in shingles.shingle_sets(texts)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes == [1496] * 300 and peak < 24 << 20


def test_ngram_join_needs_no_pandas():
    root = os.path.dirname(os.path.dirname(common.__file__)) + "/.."
    said = "import sys; from crashloom.llm import ngram_join; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-B", "-c", said], cwd=root).returncode == 0


def test_cells_allow_what_links(spark):
    rng = np.random.default_rng(5)
    rows = []
    for n in (5, 40, 700, 9000):
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        for keep in (n, n - n // 10, n // 2):
            b = np.concatenate([a[:keep], rng.integers(0, 2**64, n - keep, dtype=np.uint64)])
            rows.append((ngram_join.histogram(a), ngram_join.histogram(b), n, n, keep))
        rows.append((ngram_join.histogram(a), ngram_join.histogram(a[: n - n // 10]), n, n - n // 10, n - n // 10))
    got = spark.createDataFrame(rows, "a binary, b binary, n long, m long, keep long").withColumn("ok", ngram_join._cells_allow("a", "b", "n", "m")).collect()
    assert len(got) == len(rows)
    assert all(r.ok for r in got if 180 * r.keep >= 80 * (r.n + r.m))
    assert not any(r.ok for r in got if r.keep == r.n // 2 and r.n > 5)


def test_ngram_join_without_documents(spark):
    assert ngram_join.join(docs(spark, [(1, None)]).limit(0)).count() == 0
    assert [tuple(r) for r in ngram_join.join(docs(spark, [(1, None)])).collect()] == [(1, 0, 1)]


def variants(rng, base, n, most):
    """``n`` texts that each vary a few words of ``base``; some vary one that is varied already."""
    out = []
    for _ in range(n):
        w = list(rng.choice(out) if out and rng.random() < 0.3 else base)
        for _ in range(rng.randint(1, most)):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[], [f"x{rng.random()}"], [w[i], f"x{rng.random()}"], [rng.choice(base)]])
        out.append(w)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("dense", [0.0, 1e9])
def test_ngram_join_of_variants_of_one_text(spark, monkeypatch, dense):
    """Lists with many open pairs go around centres, whatever the threshold for that."""
    monkeypatch.setattr(ngram_join, "DENSE", dense)
    rng = random.Random(7)
    texts = []
    for n, most in ((90, 4), (60, 3), (18, 1)):
        texts += variants(rng, [f"w{rng.randrange(10**6)}" for _ in range(n)], 50, most)
    # families: variants of variants that don't link with the first text
    base = [f"f{i}" for i in range(80)]
    for family in variants(rng, base, 4, 6):
        texts += variants(rng, family.split(), 12, 2)
    got = sorted(tuple(r) for r in ngram_join.join(docs(spark, list(enumerate(texts)))).collect())
    assert got == brute_components(list(enumerate(texts)))


def test_ngram_join_by_subsets_of_light_sets(spark, monkeypatch):
    """Small sets of unlike sizes are found by subsets, on either side of the boundary."""
    seen = []
    real = ngram_join._lists
    monkeypatch.setattr(ngram_join, "choose_boundary", lambda mean: 12)
    monkeypatch.setattr(ngram_join, "_lists", lambda d, heavy, boundary: seen.append(boundary) or real(d, heavy, boundary))
    rng = random.Random(11)
    texts = [t for n in (8, 10, 12, 14, 16, 17, 19) for k in range(8) for t in variants(rng, [f"v{n}-{k}-{i}" for i in range(n)], 3, 1)]
    texts += [" ".join(w.split()[:-j]) for w in texts[:40] for j in (1, 2)]
    got = sorted(tuple(r) for r in ngram_join.join(docs(spark, list(enumerate(texts)))).collect())
    assert seen == [12] and got == brute_components(list(enumerate(texts)))
    linked = {(n, m) for (_, n, c), (_, m, e) in zip(got, got[1:]) if c == e}
    assert any(min(x) <= 12 < max(x) for x in linked) or len({c for _, _, c in got}) < len(got)


def test_ngram_join_with_an_id_for_two_texts(spark):
    base, other = ([f"{x}{i}" for i in range(60)] for x in "ab")
    near = lambda w: " ".join([*w[:-1], "changed"])
    texts = [(1, " ".join(base)), (1, " ".join(other)), (2, near(base)), (3, near(other)), (None, " ".join(base))]
    got = Counter(tuple(r) for r in ngram_join.join(docs(spark, texts)).collect())
    assert got == Counter([(1, 56, 1), (1, 56, 1), (2, 56, 1), (3, 56, 1), (None, 56, None)])
    assert sorted(r.doc_id or 0 for r in ngram_join.keep_one(docs(spark, texts)).collect()) == [0, 1, 1]


def test_boundary_grows_with_lists():
    assert ngram_join.choose_boundary(1.0) <= ngram_join.choose_boundary(100.0)
    assert all(ngram_join.need(a, b) == min(k for k in range(1, a + b) if 100 * k >= 80 * (a + b - k)) for a in range(1, 40) for b in ngram_join.partners(a))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def test_banded_distance(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(200):
        a = "".join(rng.choice("ab\U0001f600c") for _ in range(rng.randint(1, 20)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "c"])
        rows.append(tuple(sorted((a, "".join(b)), key=len, reverse=True)))
    for edits in (1, 2, 3):
        got = spark.createDataFrame(rows, "x string, y string").select("x", "y", line_dedup.within("x", "y", edits).alias("w")).collect()
        assert [r.w for r in got] == [levenshtein(r.x, r.y) <= edits for r in got]


def brute_lines(texts):
    """Texts without the lines that repeat an earlier one, exactly or within edits, by comparing all lines."""
    flat = [(d, no, x) for d, t in texts if t is not None for no, x in enumerate(t.split("\n")) if len(x) >= line_dedup.EXACT]
    up = list(range(len(flat)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, _, x) in enumerate(flat):
        for j, (_, _, y) in enumerate(flat[:i]):
            if x == y or (min(len(x), len(y)) >= line_dedup.FUZZY and levenshtein(x, y) <= line_dedup.EDITS):
                up[max(root(i), root(j))] = min(root(i), root(j))
    gone = {(flat[i][0], flat[i][1]) for i in range(len(flat)) if root(i) != i}
    return {d: None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (d, no) not in gone) for d, t in texts}


def test_line_dedup(spark):
    rng = random.Random(2)
    line = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    base = [line(n) for n in (9, 12, 24, 25, 26, 40, 80, 200)]
    texts = []
    for i in range(30):
        ls = []
        for _ in range(4):
            x = list(rng.choice(base)) if rng.random() < 0.7 else list(line(rng.randrange(1, 60)))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                at = rng.randrange(len(x) + 1)
                x[at : at + rng.randint(0, 1)] = rng.choice(["", "z"])
            ls.append("".join(x))
        texts.append((i, "\n".join(ls)))
    texts += [(100, None), (101, ""), (102, "\n\n")]
    want = brute_lines(texts)
    got = line_dedup.dedup(docs(spark, texts))
    assert got.columns == docs(spark, texts).columns
    assert {r.doc_id: r.text for r in got.collect()} == want


def test_language(spark):
    assert len(language_id.suffix_automaton(b"abcbc")) >= 6
    model = language_id.Model({"en": b"the cat and the dog " * 40, "de": b"der hund und die katze " * 40})
    langs, scores = language_id.judge(model, ["the dog and the cat", "die katze und der hund", None, "", "123 !", "\u4e2d"])
    assert langs[:5] == ["en", "de", "und", "und", "und"] and langs[5] in ("de", "en") and all(0 <= s <= 1 for s in scores)
    assert language_id.judge(language_id.Model({}), ["abc"]) == (["und"], [0.0])
    got = language_id.predict(docs(spark, AWKWARD), model).collect()
    assert len(got) == len(AWKWARD)
    # phrases of a plain greedy parse
    plain, text, sample, i = 0, "thecatzebraandthe", "the cat and the dog " * 40, 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in sample:
            k += 1
        plain, i = plain + 1, i + k
    need, _ = language_id._parse(model, [text])
    assert need[0][model.langs.index("en")] == plain


@pytest.mark.parametrize("block", [1, 7, 256])
def test_language_parses_whole_texts(monkeypatch, block):
    """Phrases cross the ends of blocks, even phrases of many blocks."""
    monkeypatch.setattr(language_id, "BLOCK", block)
    rng = random.Random(8)
    samples = {"x": "".join(rng.choice("abc ") for _ in range(3000)), "y": "ab" * 1500, "z": "c"}
    model = language_id.Model({k: v.encode() for k, v in samples.items()})
    texts = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (1, 6, 255, 257, 2000)] + ["ab" * 700, samples["x"][100:2600] + "dd" + samples["x"][:1500]]
    need, _ = language_id._parse(model, texts)
    for text, row in zip(texts, need):
        for k, lang in enumerate(model.langs):
            count, i = 0, 0
            while i < len(text):
                n = 1
                while i + n < len(text) and text[i : i + n + 1] in samples[lang]:
                    n += 1
                count, i = count + 1, i + n
            assert row[k] == count


def test_language_ties_go_to_the_smallest_name():
    model = language_id.Model({"b": b"same words", "a": b"same words"})
    assert language_id.judge(model, ["same words", "words same"])[0] == ["a", "a"]


@given
def test_language_query_against_a_plain_parse(spark):
    """Every row of the query as phrases found one after the other through the automata's own edges."""
    d = common.table(spark, DATA, "documents")
    model = language_id.learn(d, ~common.held_out(F.col("doc_id"), 3, 1))
    rows = d.where("lang is not null").where(~common.held_out(F.col("doc_id"), 3, 1))
    assert model.langs == sorted(r[0] for r in rows.select("lang").distinct().collect())

    def phrases(text, table):
        state, n = 0, 0
        for c in text:
            v = table[state + c]
            n, state = n + (v < 0), v & 0x7FFFFFFF
        return n

    tables = [t.tolist() for t in model.tables]
    got = {r.doc_id: r for r in queries.op1_language_id(spark, DATA).collect()}
    for r in d.select("doc_id", "text").collect():
        if not r.text or not any(map(str.isalpha, r.text)):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        need = [phrases(model.classes[np.frombuffer(language_id.symbols(r.text), np.uint8)].tolist(), t) for t in tables]
        best, second = sorted(need)[:2]
        assert got[r.doc_id].lang_pred == model.langs[need.index(best)] and got[r.doc_id].score == pytest.approx(1 - best / second)


@given
def test_language_held_out(spark):
    d = common.table(spark, DATA, "documents").select("doc_id", "lang")
    got = queries.op1_language_id(spark, DATA).join(d, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.9


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    rng = random.Random(4)
    plain = [f"k{i}" for i in range(50)]
    text = lambda bad: " ".join(rng.sample(plain, 12) + (["vile", "awful"] if bad else []))
    rows = [(i, text(i % 10 == 0)) for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(0, 600, 2)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs(spark, rows), labels, lambda k: ~common.held_out(k, 5, 0))
    got = {r.doc_id: r.predicted for r in toxicity.score(docs(spark, rows), model).collect()}
    assert sum(got[i] == int(i % 10 == 0) for i in got) >= 590
    assert toxicity.drop_toxic(docs(spark, rows), model).columns == docs(spark, rows).columns
    assert all(0 <= r.score < 0.5 for r in toxicity.score(docs(spark, AWKWARD), model).collect())
    empty = toxicity.learn(docs(spark, rows), labels.limit(0), lambda k: ~common.held_out(k, 5, 0))
    assert {r.score for r in toxicity.score(docs(spark, AWKWARD), empty).collect()} == {0.0}


def plain_nnpu(pos, unl, n, prior):
    """The same training over one document at a time."""
    import math

    w, m1, m2 = [0.0] * n + [math.log(prior / (1 - prior))], [0.0] * (n + 1), [0.0] * (n + 1)
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    flipped = 0
    for t in range(1, toxicity.STEPS + 1):
        score = lambda d: sum(w[i] for i in d) + w[n]
        # risk of the negatives: what the unlabelled lose as negatives without the positives' share of it
        negatives = sum(math.log1p(math.exp(score(d))) for d in unl) / len(unl) - prior * sum(math.log1p(math.exp(score(d))) for d in pos) / len(pos)
        flipped += negatives < 0
        g = [0.0] * (n + 1)
        for docs_, part, size in ((pos, "p", len(pos)), (unl, "u", len(unl))):
            for d in docs_:
                s = sigmoid(score(d))
                as_positive, as_negative = (s - 1) / size, s / size
                if part == "p":
                    x = prior * as_positive - prior * as_negative if negatives >= 0 else prior * as_negative
                else:
                    x = as_negative if negatives >= 0 else -as_negative
                for i in [*d, n]:
                    g[i] += x
        for i in range(n + 1):
            grad = g[i] + (toxicity.RIDGE * w[i] if i < n else 0.0)
            m1[i], m2[i] = 0.9 * m1[i] + 0.1 * grad, 0.999 * m2[i] + 0.001 * grad * grad
            w[i] -= toxicity.RATE * (m1[i] / (1 - 0.9**t)) / (math.sqrt(m2[i] / (1 - 0.999**t)) + 1e-8)
    return w, flipped


def test_nnpu_against_plain_loops():
    rng = random.Random(12)
    pos = [[0, rng.randrange(1, 6)] for _ in range(8)]
    unl = [sorted({rng.randrange(1, 6), rng.randrange(1, 6)} | ({0} if i % 9 == 0 else set())) for i in range(27)]
    flips = 0
    for prior in (0.1, 0.6):
        want, flipped = plain_nnpu(pos, unl, 6, prior)
        flips += flipped
        assert np.allclose(toxicity.train_nnpu(pos, unl, 6, prior), want, atol=1e-6)
    assert flips, "the corrected risk was below zero at times"


@given
def test_toxicity_scores_against_plain_sums(spark):
    d, labels = common.table(spark, DATA, "documents"), common.table(spark, DATA, "labels")
    model = toxicity.learn(d, labels, lambda k: ~common.held_out(k, 5, 0))
    got = {r.doc_id: r for r in queries.op2_toxicity(spark, DATA).collect()}
    for r in d.select("doc_id", "text").collect():
        features = {f for w in re.findall(r"[^\W\d_]+", (r.text or "").lower()) for f in toxicity.word_features(w)}
        z = model.intercept + sum(model.weights[model.ids[f]] for f in features if f in model.ids)
        assert got[r.doc_id].score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5) and got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_url_rules(spark):
    hosts = ["org", "example.org", "a.example.org", "xexample.org", "com", "b.com", "", "example.org.net"]
    paths = ["", "/", "/es/x", "/en/12", "/en/2", "/fr/", "/de/1?a://b"]
    urls = [f"http://{h.upper()}{p}#f" for h in hosts for p in paths] + [None, "no scheme", "://", "http://org?x/"]
    pages = spark.createDataFrame(list(enumerate(urls * 3)), "page_id long, url string")
    rules = spark.createDataFrame([*queries.RULES, (None, "/", "block"), ("org", "/", "allow")], "host string, path string, verdict string")
    url_rules.RANGE_ROWS, kept = 40, url_rules.RANGE_ROWS
    got = {r.page_id: r for r in url_rules.judge(pages, rules).collect()}
    url_rules.RANGE_ROWS = kept
    assert len(got) == len(urls) * 3
    for i, u in enumerate(urls * 3):
        m = re.match(r"[\s\S]*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h) + len(p), h + p, v) for h, p, v in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits, default=(0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, want[1], want[2])
    assert url_rules.judge(pages.limit(0), rules).count() == 0


def test_secrets(spark):
    far = "x" * 700
    texts = [(0, 'é Password = "abc-123_x" token: ab AKIA' + "Z9" * 8), (1, "user=anna " + "ab12" * 4 + f" {far} user=bob"), (2, None), (3, ""), (3, ""), (4, "https://h.example/x api_key:" + "k" * 9), (5, "f" * 24 + "G" + "0" * 23)]
    got = {r.doc_id: r for r in secret_scan.scan(docs(spark, texts)).select("*", secret_scan.rendered(F.col("spans")).alias("s")).collect()}
    assert (got[0].n_assign, got[0].n_access, got[0].n_hex) == (1, 1, 0) and got[0].s == "assign:2:23,access:35:55"
    assert got[1].s == "user:0:9,short_hex:10:26"
    assert got[2].s == "" and got[3].s == ""
    assert got[4].s == "endpoint:0:19,assign:20:37"
    assert got[5].n_hex == 1
    # the secret beside an access key identifier: bare, or as the value of a key; a path of as many letters is none, nor is a secret alone
    access, secret = "AKIA" + "Z9" * 8, "aB3+" * 10
    more = [(0, f"{access} {secret}"), (1, f"aws_secret_access_key = {secret[:30]} {access}"), (2, f"{access} {'usr/bin+' * 5}"), (3, f"{access} {secret}x"), (4, secret), (5, f"private_key: {secret[:20]}")]
    assert [r.s for r in secret_scan.scan(docs(spark, more)).orderBy("doc_id").select(secret_scan.rendered(F.col("spans")).alias("s")).collect()] == ["access:0:20,run:21:61", "keyed:11:54,access:55:75", "access:0:20", "access:0:20", "", ""]
    assert secret_scan.scan(docs(spark, texts)).count() == len(texts)


def test_secrets_of_a_text_with_many(spark):
    """Places of thousands of matches in one text, in time that grows about as their number."""
    took = []
    for n in (1000, 8000, 16000):
        began = time.time()
        row = secret_scan.scan(docs(spark, [(1, "token=abcdef1 " * n)])).select("n_assign", "base").first()
        took.append(time.time() - began)
        assert row.n_assign == n and [(s.start, s.stop) for s in row.base] == [(14 * i, 14 * i + 13) for i in range(n)]
    assert took[2] < 2 * took[1] + 1


def lzw(data, size, deferred=False):
    """A plain encoder with the table's full growth; ``deferred``: once full, the table is used on without a clear code."""
    clear, out, table = 1 << size, [], {}

    def reset():
        table.clear()
        table.update({(i,): i for i in range(clear)})

    reset()
    out.append((clear, size + 1))
    width, nxt, now = size + 1, clear + 2, ()
    for b in data:
        if now + (b,) in table:
            now += (b,)
            continue
        out.append((table[now], width))
        if nxt < 4096:
            table[now + (b,)] = nxt
            nxt += 1
            if nxt > 1 << width and width < 12:
                width += 1
        elif not deferred:
            out.append((clear, width))
            reset()
            width, nxt = size + 1, clear + 2
        now = (b,)
    out += [(table[now], width)] if now else []
    nxt += 1
    if nxt > 1 << width and width < 12:
        width += 1
    out.append((clear + 1, width))
    bits = "".join(format(c, f"0{w}b")[::-1] for c, w in out)
    return bytes(int(bits[i : i + 8][::-1].ljust(1, "0"), 2) for i in range(0, len(bits), 8))


@pytest.mark.parametrize("size", [2, 4, 8])
def test_lzw_streams(size):
    rng = np.random.default_rng(size)
    for n in (1, 5, 300, 20_000):
        data = np.repeat(rng.integers(0, 1 << size, n), rng.integers(1, 4, n))[:n].astype(np.uint8)
        assert (gif_media.lzw_decode(lzw(data.tolist(), size), size, n) == data).all()
    with pytest.raises(ValueError):
        gif_media.lzw_decode(b"\xff" * 40, size, 100)


@pytest.mark.parametrize("size", [2, 5, 8])
def test_lzw_deferred_clear(size):
    rng = np.random.default_rng(size)
    data = rng.integers(0, 1 << size, 240_000).astype(np.uint8)
    stream = lzw(data.tolist(), size, True)
    assert len(stream) * 8 > 12 * (3 << 13), "more codes than the table has, several times"
    for most in (1, 5000, 9000, len(data) - 1, len(data)):
        assert (gif_media.lzw_decode(stream, size, most) == data[:most]).all()
    assert (gif_media.lzw_decode(stream[: len(stream) // 2], size, 20_000) == data[:20_000]).all()
    if size == 8:
        head = b"GIF89a" + struct.pack("<HHBBB", 400, 600, 0xF7, 0, 0) + gif_media._GRAY.tobytes()
        image = b"\x2c" + struct.pack("<HHHHB", 0, 0, 400, 600, 0) + b"\x08" + gif_media._blocks(stream)
        assert (gif_media.decode(head + image + b"\x3b")[2][0].indices.ravel() == data).all()


def test_lzw_encoder():
    rng = np.random.default_rng(1)
    for data in (b"", b"a", bytes(64), rng.integers(0, 256, 30_000).astype(np.uint8).tobytes(), b"repeated words " * 5000, bytes(rng.integers(97, 101, 60_000).astype(np.uint8))):
        assert gif_media.lzw_encode(data) == lzw(list(data), 8)
        assert gif_media.lzw_decode(gif_media.lzw_encode(data), 8, len(data)).tobytes() == data
    assert len(gif_media.encode(b"repeated words!!" * 4000)) < 64_000 / 5


def test_gif_frames():
    import struct

    def image(x, y, w, h, samples, packed, delay, clear=0):
        return b"\x21\xf9\x04" + struct.pack("<BHB", packed, delay, clear) + b"\0\x2c" + struct.pack("<HHHHB", x, y, w, h, 0) + b"\x02" + gif_media._blocks(lzw(samples, 2))

    head = b"GIF89a" + struct.pack("<HHBBB", 2, 1, 0x81, 0, 0) + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    body = image(0, 0, 2, 1, [1, 1], 4, 5) + image(0, 0, 2, 1, [0, 2], 1 | 2 << 2, 7) + image(1, 0, 1, 1, [3], 3 << 2, 9) + image(0, 0, 1, 1, [2], 0, 1)
    _, _, got = gif_media.decode(head + body + b"\x3b")
    red, green, blue, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert [f.canvas[0].tolist() for f in got] == [[red, red], [red, green], [none, blue], [green, none]]
    assert [f.delay for f in got] == [5, 7, 9, 1]
    assert gif_media.histogram(got[0].canvas)[0].tolist() == [0] * 7 + [2]


def test_media_round_trip(spark):
    texts = AWKWARD + [(20, "x" * 200_000)]
    got = gif_media.digests(gif_media.store(docs(spark, texts))).collect()
    assert len(got) == len(texts)
    by = {(r.doc_id, r.n_bytes): r for r in got}
    for d, t in texts:
        raw = (t or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = by[d, len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    shown = gif_media.frames(gif_media.store(docs(spark, texts)).unionByName(spark.createDataFrame([(50, 0, b"junk")], "doc_id long, n_bytes long, media binary"))).select("doc_id", "frame", "width", "error").collect()
    assert [r.error is not None for r in shown if r.doc_id == 50] == [True] and sum(r.doc_id == 20 for r in shown) == 4


def test_token_counts(spark):
    path = queries.tokenizer_path()
    bpe = token_counts.Bpe(token_counts.load(path))
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "The", " ", "  ", "\n", "é", "'s", "12", "!", "\u00a0", "\U0001f600", "<|endoftext|>", "\u2028", "\u0915"]) for _ in range(rng.randrange(40))) for _ in range(800)] + [t for _, t in AWKWARD if t]
    for t in texts:
        ids = bpe.library.encode(t, add_special_tokens=False).ids
        assert bpe.count(t) == len(ids) and bpe.encode(t) == np.array(ids, "<u4").tobytes(), repr(t)
    assert " the" in bpe.whole and len(bpe.whole) > 40_000
    got = token_counts.count_tokens(docs(spark, AWKWARD), path).collect()
    assert len(got) == len(AWKWARD) and {r.n_tokens for r in got if r.doc_id in (0, 1)} == {0}


def test_fullest_pattern():
    rng = random.Random(7)
    for _ in range(60):
        counts = {s: rng.randint(1, 3) for s in rng.sample(range(1, 60), 6)}
        got = packing.fullest(counts, 100)
        sums = {0}
        for s, n in counts.items():
            sums = {a + k * s for a in sums for k in range(n + 1)}
        assert all(got[s] <= counts[s] for s in got) and sum(s * n for s, n in got.items()) == max(x for x in sums if x <= 100)


def test_plan_against_brute_force():
    """Bin by bin, the longest piece left with the fullest of all combinations of the others."""
    from itertools import product

    rng = random.Random(9)
    for _ in range(30):
        counts = {s: rng.randint(1, 4) for s in rng.sample(range(1, 40), 5)}
        left, fills = dict(counts), []
        while any(left.values()):
            longest = max(s for s, n in left.items() if n)
            rest = left | {longest: left[longest] - 1}
            best = max(sum(s * k for s, k in zip(rest, ks)) for ks in product(*(range(n + 1) for n in rest.values())) if sum(s * k for s, k in zip(rest, ks)) <= 50 - longest)
            fills.append(longest + best)
            # several combinations can be as full; the plan's own is removed
            pattern = packing.fullest(rest, 50 - longest)
            assert sum(s * k for s, k in pattern.items()) == best
            for s, k in [*pattern.items(), (longest, 1)]:
                left[s] -= k
        got = {}
        for s, _, n, times, seq, _ in packing.plan(counts, 50):
            for i in range(times):
                got[seq + i] = got.get(seq + i, 0) + s * n
        assert sorted(got.values()) == sorted(fills)


def test_packing_starts_no_workers_for_its_plan(spark):
    plan = packing.pack(docs(spark, [(1, "a b"), (2, None)]), queries.tokenizer_path())._jdf.queryExecution().toString()
    assert "LocalTableScan" in plan and "ExistingRDD" not in plan
    assert packing.pack(docs(spark, [(1, "a b")]).limit(0), queries.tokenizer_path()).count() == 0


def test_packing(spark):
    texts = AWKWARD + [(30 + i, " ".join(["word"] * (i * 37 % 900))) for i in range(60)]
    got = packing.pack(docs(spark, texts), queries.tokenizer_path()).collect()
    bpe = token_counts.Bpe(token_counts.load(queries.tokenizer_path()))
    by, bins = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    for d, t in dict(texts).items():
        copies = sum(d == x for x, _ in texts)
        ids = bpe.encode(t) + b"\x02\0\0\0"
        rows = sorted(by[d], key=lambda r: r.piece)[::copies]
        assert len(by[d]) == copies * len(rows) and sum(r.length for r in rows) == len(ids) // 4
        for r in rows:
            assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])
        assert all(r.length == 1024 for r in rows[1:])
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    first_fit: list[int] = []
    for n in sorted((r.length for r in got), reverse=True):
        at = next((i for i, used in enumerate(first_fit) if used + n <= 1024), None)
        if at is None:
            first_fit.append(n)
        else:
            first_fit[at] += n
    assert len(bins) <= len(first_fit)


def test_decontamination(spark):
    item = [f"q{i}" for i in range(20)]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "Short One"), (8, "Short One"), (9, None), (None, "lost words"), (10, "...")], "item_id long, text string")
    texts = [(0, "X " + " ".join(item[2:15]).upper() + " y"), (1, " ".join(item[:12])), (2, "so short ONE, yes"), (3, None), (4, ""), (5, " ".join(item) + " " + LONG), (6, "lost words")]
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontamination.contamination(docs(spark, texts), bench).collect()}
    assert got[0] == (15, 13, ["7"]) and got[1] == (12, 0, []) and got[2] == (4, 2, ["8"]) and got[3] == (0, 0, []) and got[4] == (0, 0, []) and got[5] == (30_020, 20, ["7"]) and got[6] == (2, 0, [])
    kept = {r.doc_id for r in decontamination.drop_contaminated(docs(spark, texts), bench).collect()}
    assert kept == {1, 3, 4, 5, 6}
    assert decontamination.contamination(docs(spark, texts), bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_of_capital_sigma(spark):
    """A sigma at a word's end and a letter behind a mark: lower case of the whole text differs from that of the words."""
    texts = [(0, "ΟΔΟΣ'ΑΒ"), (1, "x ΟΔΟΣ.ΑΒ: y"), (2, "οδος αβ"), (3, "ΟΔΟΣ ΓΔ")]
    for item in ("ΟΔΟΣ ΑΒ", "ΟΔΟΣ'ΑΒ"):
        bench = spark.createDataFrame([(7, item)], "item_id long, text string")
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontamination.contamination(docs(spark, texts), bench).collect()}
        assert got == {0: (2, 2, ["7"]), 1: (4, 2, ["7"]), 2: (2, 0, []), 3: (2, 0, [])}


CLASHING = ["_kept", "kept_id", "kept_row", "_repeat_id", "_repeat_row", "_repeats", "_lines", "__l", "__d", "__r", "__drop", "__n_lines", "_bad_id", "_bad_row", "rid", "label", "key", "n", "score", "predicted", "component_id"]


def test_stages_keep_columns_of_any_name(spark):
    """Columns that are named as the stages' own keep their values, and null, empty, repeated and very long texts their rows."""
    line = "a line that more than one of the documents hold, word by word"
    texts = [(1, f"{line}\nfirst"), (2, f"{line}\nsecond and other words"), (3, " ".join(f"w{i}" for i in range(40))), (4, " ".join(f"w{i}" for i in range(40)) + " end"), (5, None), (None, "no id at all"), (6, " ".join(f"b{i}" for i in range(13))), (7, ""), (8, LONG), (8, LONG)]
    d = docs(spark, texts).select("doc_id", "text", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING))
    bench = spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(13)))], "item_id long, text string")
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(d, labels, lambda k: ~common.held_out(k, 5, 0))
    whole = Counter(r.doc_id for r in d.collect())
    for got, gone in ((toxicity.drop_toxic(d, model), []), (line_dedup.dedup(d), []), (ngram_join.keep_one(d), [4]), (decontamination.drop_contaminated(d, bench), [6])):
        rows = got.collect()
        assert got.columns == d.columns
        assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in rows for c in CLASHING)
        assert Counter(r.doc_id for r in rows) == Counter({k: n for k, n in whole.items() if k not in gone})
    cleaned = {r.doc_id: r.text for r in line_dedup.dedup(d).collect()}
    assert (cleaned[1], cleaned[2], cleaned[5], cleaned[7]) == (f"{line}\nfirst", "second and other words", None, "")


@pytest.fixture(scope="module")
def empty_tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    if os.path.isdir(DATA):
        for t in ("documents", "pages", "benchmark", "labels", "conversations"):
            common.table(spark, DATA, t).limit(0).coalesce(1).write.parquet(f"{d}/{t}.parquet")
    return d


@given
@pytest.mark.parametrize("name", [*sorted(queries.QUERIES), "pipeline"])
def test_empty_tables(spark, empty_tables, name):
    import corpus_pipeline

    run = corpus_pipeline.run if name == "pipeline" else queries.QUERIES[name]
    assert run(spark, empty_tables).count() == 0


def test_broadcasts_are_bounded_by_bytes(spark):
    df = spark.createDataFrame([(i, "x" * 100, [1, 2], None) for i in range(100)], "a long, b string, c array<long>, d struct<e:string>")
    assert "ResolvedHint" in common.small(df)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in common.small(df, most=9_000)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in common.small(df, rows=99)._jdf.queryExecution().analyzed().toString()


@given
def test_pipeline(spark):
    import corpus_pipeline

    table = common.table(spark, DATA, "documents")
    at = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, at, DATA)
        assert now.columns == table.columns, name
        at = common.cut(now, "stage")
    assert 0 < at.count() < table.count()
    last = corpus_pipeline.STAGES[-1][1](spark, at, DATA)
    assert last.select("doc_id").distinct().count() == at.count()
    assert Counter(r.piece for r in last.where("piece = 0").collect())[0] == at.count()


def test_pipeline_against_brute_force(spark, tmp_path):
    """All stages on a small corpus, each against plain Python on its own input."""
    import corpus_pipeline

    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    item = [word() for _ in range(16)]
    line = " ".join(word() for _ in range(9))
    texts = []
    for i in range(60):
        w = [word() for _ in range(rng.randint(20, 60))]
        if i % 6 == 1:
            w += ["vile", "awful"]
        if i % 10 == 2:
            w[5:5] = item
        t = " ".join(w)
        texts.append(t + "\n" + line if i % 4 == 0 else t)
        if i % 5 == 3:
            texts.append(t + " tail")
    rows = [(i, t) for i, t in enumerate([*texts, None, "", "x"])]
    d = str(tmp_path)
    docs(spark, rows).coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int("vile" in (t or ""))) for i, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(5, " ".join(item))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    at = common.table(spark, d, "documents")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in at.orderBy("doc_id").collect()] if "text" in at.columns else None
        at = common.cut(stage(spark, at, d), "stage")
        after = {r.doc_id: r.text for r in at.collect()} if "text" in at.columns else at.collect()
        if name == "toxicity":
            model = toxicity.learn(common.table(spark, d, "documents"), common.table(spark, d, "labels"), lambda k: ~common.held_out(k, 5, 0))
            want = {k: t for k, t in before if model.score(t) < 0.5}
            assert sum("vile" in (t or "") for t in want.values()) == 0
        elif name == "line_dedup":
            want = brute_lines(before)
        elif name == "ngram_join":
            want = {k: t for (k, t), (_, _, c) in zip(before, brute_components(before)) if c == k}
        elif name == "decontamination":
            windows = {tuple(item[i : i + 13]) for i in range(len(item) - 12)}

            def share(t):
                w = re.findall("[0-9a-z]+", (t or "").lower())
                hit = {j for i in range(len(w) - 12) if tuple(w[i : i + 13]) in windows for j in range(i, i + 13)}
                return len(hit) * 20 >= len(w) if hit else False

            want = {k: t for k, t in before if not share(t)}
        else:
            bpe = token_counts.Bpe(token_counts.load(queries.tokenizer_path()))
            sizes = {k: bpe.count(t) + 1 for k, t in before}
            assert {r.doc_id: r.length for r in after} == sizes
            bins = Counter()
            for r in after:
                bins[r.sequence_id] += r.length
            assert max(bins.values()) <= 1024 and len(bins) == -(-sum(sizes.values()) // 1024)
            break
        assert after == want, name
        seen.append(len(before) - len(after))
    assert seen[0] > 0 and seen[2] > 0 and seen[3] > 0
