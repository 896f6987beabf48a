"""Clusters, updates and range joins against plain Python and known results."""

from __future__ import annotations

import os
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from crashloom.functions.similarity import similarity, upper_bound
from crashloom.operators import clustering, dedup, incremental, ranges, summary
from crashloom.operators.graph import cut
from test_crash_functions import plain_similarity

#: Twelve reports by name as frames, and their crash lines. They form nine clusters; crash lines leave eleven of them.
SMALL = {"10": "0 1 2 3", "2": "4 5 6 7", "20": "4 5 6 7", "3": "8 9 10 11 12", "30": "8 9 10 11 12", "4": "13 14 11 12", "40": "14 11 12", "5": "15 16", "6": "17 2 3", "7": "18 19 20 11 12", "8": "21 22 23 24 25 26 27 11 12", "9": "28 24 29 26 27 11 12"}
LINES = {"3": "malloc.c:1466", "30": "malloc.c:1466"}
#: Fixed value: the mean silhouette after the update below.
SILHOUETTE = 0.15436556855344655


def reports(spark, names=SMALL):
    return spark.createDataFrame([(f"{n}.casrep", SMALL[n].split(), LINES.get(n, "")) for n in names], "id string, keys array<string>, crashline string")


def test_small_corpus(spark):
    found = cut(reports(spark).join(clustering.cluster(reports(spark)), "id"), "golden")
    by = {r.id.split(".")[0]: r.cluster for r in found.collect()}
    assert len(set(by.values())) == 9 and [by[x] for x in ("10", "5", "6", "7", "8", "9")] == [1, 2, 3, 4, 5, 6]
    assert by["2"] == by["20"] == 7 and by["3"] == by["30"] == 8 and by["4"] == by["40"] == 9
    kept = dedup.dedup_crash_lines(found, order=("id",)).where("cluster > 0")
    assert (found.count(), kept.count()) == (12, 11)
    # one report is taken from the seventh cluster and one from the ninth, which then is the eighth; the eighth goes
    state = kept.where("id not in ('20.casrep', '40.casrep') and cluster <> 8").withColumn("cluster", F.when(F.col("cluster") == 9, 8).otherwise(F.col("cluster")))
    out = cut(incremental.update(cut(state, "golden-state"), reports(spark).withColumnRenamed("id", "report_id"), True), "golden-update")
    counts = incremental.counts(out).first()
    assert (counts.added, counts.duplicates, counts.clusters, counts.after) == (1, 9, 1, 1)
    fresh = out.where("outcome in ('added', 'moved', 'new')").withColumnRenamed("report_id", "id").join(reports(spark), "id").select("id", "cluster", "keys", "crashline")
    mean = clustering.mean_silhouette(state.select("id", "cluster", "keys", "crashline").union(fresh)).first()
    assert (mean.clusters, mean.reports) == (9, 10) and abs(mean.silhouette - SILHOUETTE) < 1e-12


def test_silhouette_of_nothing_is_an_error(spark):
    members = spark.createDataFrame([(1, 1, ["a"])], "id long, cluster int, keys array<string>")
    for df, text in ((members.limit(0), "needs reports"), (members, "two clusters")):
        with pytest.raises(Exception, match=text):
            clustering.mean_silhouette(df).select("silhouette").collect()


def test_clusters_read_traces_once(spark):
    """Traces that took a shuffle to make aren't made again for the result."""
    t = spark.range(60).groupBy((F.col("id") % 20).alias("id")).agg(F.sort_array(F.collect_list(F.concat(F.lit("f"), F.col("id") % 7))).alias("keys"))
    found = clustering.cluster(t)
    assert "Range" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 20


@pytest.mark.parametrize("meets", [64_000_000, 700])
def test_silhouettes_in_slices(spark, monkeypatch, meets):
    """The means of all pairs, whatever the slices, and no table of pairs."""
    monkeypatch.setattr(clustering, "MEETS", meets)
    made = []
    monkeypatch.setattr(clustering, "cut", lambda df, name: (made.append((name, back := cut(df, name))), back)[1])
    rng = random.Random(11)
    rows = [(i, i % 5 + 1 if i < 40 else 6, [rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))]) for i in range(41)] + [(50, 1, ["z"]), (51, 2, ["z"])]
    got = {r.id: r.silhouette for r in clustering.silhouettes(spark.createDataFrame(rows, "id long, cluster int, keys array<string>")).collect()}
    for i, c, k in rows:
        mean = {x: [1 - plain_similarity(k, y) for j, z, y in rows if z == x and j != i] for x in range(1, 7)}
        a, b = (sum(mean[c]) / len(mean[c]) if mean[c] else None), min(sum(v) / len(v) for x, v in mean.items() if x != c)
        assert abs(got[i] - (0 if a is None else (b - a) / max(a, b))) < 1e-9
    assert all(back.count() <= len(rows) for _, back in made) and (sum(n == "nearness" for n, _ in made) > 1) == (meets == 700)


def plain_linkage(n, dist, threshold=0.3):
    """Merges by the least distance of all, ties by the smallest members: {(height, members)}."""
    d = np.ones((n, n))
    for (a, b), x in dist.items():
        d[a, b] = d[b, a] = round(x, clustering.DIGITS)
    np.fill_diagonal(d, np.inf)
    groups, height = {i: [i] for i in range(n)}, [0.0] * n
    while len(groups) > 1:
        i, j = sorted(divmod(int(np.argmin(d)), n))
        if d[i, j] >= threshold:
            break
        height[i] = float(d[i, j])
        groups[i] += groups.pop(j)
        d[i] = np.maximum(d[i], d[j])
        d[:, i] = d[i]
        d[i, i] = d[j] = d[:, j] = np.inf
    return {(height[i], tuple(sorted(g))) for i, g in groups.items() if len(g) > 1}


@pytest.mark.parametrize("seed", range(4))
def test_complete_linkage(spark, seed):
    """Random distances with many ties, all items in one component."""
    rng = random.Random(seed)
    n = rng.randint(20, 60)
    dist = {(a, b): rng.choice([0.0, 0.1, 0.1, 0.2, 0.25, 0.29, rng.random() / 2]) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.8}
    near = {p: x for p, x in dist.items() if x < 0.3}
    got = {}
    for r in clustering.link(spark.createDataFrame([(a, b, x) for (a, b), x in near.items()], "id_a long, id_b long, dist double")).collect():
        got.setdefault((r.height, r.first, r.size), []).append(r.v)
    assert {(h, tuple(sorted(v))) for (h, first, size), v in got.items() if (first, size) == (min(v), len(v))} == plain_linkage(n, near)
    assert clustering.link(spark.createDataFrame([], "id_a long, id_b long, dist double")).count() == 0


def variants(rng, base, n):
    out = []
    for _ in range(n):
        k = list(base)
        for _ in range(rng.randrange(4)):
            k[rng.randrange(len(k))] = rng.choice("uvwxyz")
        out.append(k[: rng.randrange(6, len(k) + 1)])
    return out


def test_diameters(spark, monkeypatch):
    """Branch and bound over blocks of three traces gives the widest pair of all."""
    monkeypatch.setattr(clustering, "BLOCK", 3)
    rng = random.Random(8)
    rows = [(i, c, k) for c, base in enumerate(("abcdefghij", "aaabbbcccd", "abcabcabca"), 1) for i, k in enumerate(variants(rng, base, 24), 100 * c)]
    rows += [(900, 9, ["m"]), (901, 9, ["m"]), (910, 10, ["m"]), (911, 10, ["n"]), (920, 11, list("abc")), (921, 11, list("abd")), (922, 11, list("abe"))]
    got = {r.cluster: (r.size, round(r.diameter, 9)) for r in clustering.diameters(spark.createDataFrame(rows, "id long, cluster int, keys array<string>")).collect()}
    held = {c: [k for _, x, k in rows if x == c] for c in {c for _, c, _ in rows}}
    assert got == {c: (len(v), round(max((1 - plain_similarity(a, b) for i, a in enumerate(v) for b in v[:i]), default=0.0), 9)) for c, v in held.items()}


@pytest.mark.parametrize("hot", [4096, 5])
def test_pairs_of_hot_frames(spark, monkeypatch, hot):
    """Frames that all traces hold are dealt into parts without losing or repeating a pair."""
    monkeypatch.setattr(clustering, "HOT", hot)
    rng = random.Random(4)
    t = [(i, [rng.choice("abcd"), rng.choice("efgh"), "main"]) for i in range(30)]
    pairs = clustering.candidate_pairs(spark.createDataFrame(t, "id long, keys array<string>")).select("id_a", "id_b").collect()
    assert len(pairs) == len(set(pairs)) == 30 * 29 // 2
    left, right = (spark.createDataFrame([x for x in t if x[0] % 2 == k], f"{'lr'[k]} long, keys array<string>") for k in (0, 1))
    got = {(r.l, r.r) for r in clustering.pairs_across(left, right, 0.7).select("l", "r").collect()}
    want = {(a, b) for a, x in t for b, y in t if a % 2 == 0 and b % 2 == 1 and plain_similarity(x, y) >= 0.7}
    assert want <= got and len(got) < 225


def test_few_candidates(spark):
    """What is too far is told before pairs are shuffled, and what a table was made of goes with its query."""
    rng = random.Random(5)
    t = cut(spark.createDataFrame([(i, rng.sample([f"p{x}" for x in range(40)], rng.randint(2, 7))) for i in range(300)], "id long, keys array<string>"), "traces")
    pairs = clustering.candidate_pairs(t, 0.5).select("id_a", "id_b", similarity("ka", "kb").alias("s")).collect()
    assert len({(r.id_a, r.id_b) for r in pairs}) == len(pairs) < 1.6 * sum(r.s > 0.5 for r in pairs)
    files = lambda: {f for _, _, x in os.walk(spark.conf.get("spark.local.dir")) for f in x if f.startswith("shuffle_")}
    before = files()
    assert cut(spark.range(5000).groupBy((F.col("id") % 999).alias("k")).count(), "counts").count() == 999
    # the count above has one row for each task
    assert sum("data" in f for f in files() - before) <= 1


def test_no_candidate_is_lost(spark):
    """Frames of all kinds of hashes: every pair that is similar enough is found."""
    rng = random.Random(7)
    rows = [(i, rng.sample([f"p{x}" for x in range(150)], rng.randint(1, 6))) for i in range(250)]
    t = cut(spark.createDataFrame(rows, "id long, keys array<string>"), "traces")
    for least in (0.5, 0.7):
        got = {(r.id_a, r.id_b) for r in clustering.candidate_pairs(t, least).select("id_a", "id_b").collect()}
        assert {(i, j) for i, a in rows for j, b in rows if i < j and set(a) & set(b) and plain_similarity(a, b) > least} <= got


@pytest.mark.parametrize("keys", ["abcdef", "abcdefghijklmnop"])
def test_similarity_without_table(spark, keys):
    """Traces without repeats and in the same order, and others, have the similarity of the table, and the bound isn't below it."""
    rng = random.Random(len(keys))
    draw = lambda: (rng.sample(keys, rng.randint(1, 6)), sorted(rng.sample(keys, rng.randint(1, 6))), rng.choices(keys, k=rng.randint(1, 9)))[rng.randrange(3)]
    rows = spark.createDataFrame([(draw(), draw()) for _ in range(400)], "a array<string>, b array<string>")
    for r in rows.select("a", "b", similarity("a", "b").alias("s"), upper_bound("a", "b").alias("bound")).collect():
        assert abs(r.s - plain_similarity(r.a, r.b)) < 1e-12 and r.bound > r.s - clustering.SLACK


def test_relations_compare_little(spark):
    """Far members settle a report without being compared, and kinds are those of looking at members in order."""
    rng = random.Random(6)
    bases = ["abcdefghij", "klmnopqrst", "abcdefklmn"]
    members = [(i, 1 + i % 3, k) for i, k in enumerate(x for b in zip(*(variants(rng, base, 15) for base in bases)) for x in b)]
    new = list(enumerate([k for base in bases for k in variants(rng, base, 12)] + [members[3][2], members[4][2][:3], ["nowhere"]], 1000))
    m, r = spark.createDataFrame(members, "id long, cluster int, keys array<string>"), spark.createDataFrame(new, "report_id long, keys array<string>")
    assert incremental.compared(m, r).count() < len(members) * len(new) / 4
    got = {(x.report_id, x.cluster): x.kind for x in incremental.relations(m, r).where("kind <> 'outer'").collect()}
    want = {}
    for n, k in new:
        for c in (1, 2, 3):
            held = [x for _, y, x in members if y == c]
            dist = [round(1 - plain_similarity(k, x), 12) for x in held]
            stop = next((d for d in dist if d == 0 or d > 0.3), None)
            if stop == 0:
                want[n, c] = "dup"
            elif stop is None and max(dist) <= round(max(1 - plain_similarity(a, b) for a in held for b in held), 12):
                want[n, c] = "inner"
    assert got == want and "dup" in got.values()


def test_item_distances(spark, monkeypatch):
    """Only items of which all traces are near stay, whatever the blocks."""
    monkeypatch.setattr(incremental, "BLOCK", 2)
    rng = random.Random(9)
    sets = {f"c{c}": [list("abcdefgh"[:7]) + [rng.choice("xyz")] for _ in range(5)] for c in (1, 2)} | {"c3": [list("klmn"), list("klop")], "r7": [list("abcdefgz")], "r8": [list("klmn")], "r9": [list("qq")]}
    distinct = {i: sorted(set(map(tuple, v))) for i, v in sets.items()}
    items = spark.createDataFrame([(i, str(n), list(k)) for i, v in distinct.items() for n, k in enumerate(v)], "item string, h string, keys array<string>")
    members = spark.createDataFrame([(f"{i}{n}", int(i[1:]), list(k)) for i, v in distinct.items() if i[0] == "c" for n, k in enumerate(v)], "id string, cluster int, keys array<string>")
    got = {(r.ia, r.ib): round(r.d, 9) for r in incremental.item_distances(items, members).collect()}
    want = {}
    for a in distinct:
        for b in distinct:
            both = distinct[a] + distinct[b] if a[0] == b[0] == "c" else None
            pairs = [(x, y) for x in both for y in both if x != y] if both else [(x, y) for x in distinct[a] for y in distinct[b]]
            d = max((1 - plain_similarity(list(x), list(y)) for x, y in pairs), default=0.0)
            if a < b and d < 0.3:
                want[a, b] = round(d, 9)
    assert got == want and ("c1", "c2") in got


def test_interval_join(spark):
    """Mappings of four kilobytes to all addresses, some empty or reversed, for two programs."""
    rng = random.Random(2)
    rows = [(i % 2, i, rng.randrange(1 << rng.choice([5, 10, 20, 40, 64]))) for i in range(120)]
    rows = [(p, i, a, min((1 << 64) - 1, a + rng.choice([0, 1, 7, 4096, 1 << 30, 1 << 50]))) for p, i, a in rows] + [(0, 200, 0, (1 << 64) - 1), (0, 201, 5, 5), (0, 202, 9, 3)]
    at = {(rng.randrange(2), x) for _, _, a, b in rows for x in (a, b, a - 1, b - 1, (a + b) // 2) if 0 <= x < 1 << 64}
    points = spark.createDataFrame([(p, Decimal(x)) for p, x in at] + [(0, None)], "program int, x decimal(20,0)")
    intervals = spark.createDataFrame([(p, i, Decimal(a), Decimal(b)) for p, i, a, b in rows], "program int, id int, start decimal(20,0), stop decimal(20,0)")
    got = sorted((r.program, int(r.x), r.id) for r in ranges.interval_join(points, intervals, "x", "start", "stop", ["program"]).collect())
    assert got == sorted((p, x, i) for p, x in at for q, i, a, b in rows if p == q and a <= x < b)
    assert ranges.dyadic(intervals, "start", "stop").groupBy("id").count().agg(F.max("count")).first()[0] <= 126


def test_interval_join_of_many(spark, monkeypatch):
    """Few cells for each interval and few lengths for each point, and many cells aren't broadcast."""
    maps = spark.range(50).selectExpr("id * 1000 as start", "id * 1000 + 100 + id * 7 as stop", "id as module")
    at = spark.range(0, 60000, 7).withColumnRenamed("id", "x")
    assert ranges.dyadic(maps, "start", "stop").groupBy("module").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] <= 5
    want = {(x, x // 1000) for x in range(0, 60000, 7) if x // 1000 < 50 and x % 1000 < 100 + x // 1000 * 7}
    for many, merged in ((10**6, False), (10, True)):
        monkeypatch.setattr(ranges, "MANY", many)
        found = ranges.interval_join(at, maps, "x", "start", "stop")
        plan = found._jdf.queryExecution().optimizedPlan().toString() + found._jdf.queryExecution().sparkPlan().toString()
        assert ("SortMergeJoin" in plan, "Broadcast" in plan) == (merged, not merged)
        got = [(r.x, r.module) for r in found.select("x", "module").collect()]
        assert len(got) == len(want) and set(got) == want
