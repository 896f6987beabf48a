"""Clusters of similar traces: candidate pairs, complete linkage, diameters and silhouettes."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.fixed import DEPTH, SHIFT, THRESHOLD
from ..functions.similarity import similarity, upper_bound
from .graph import cut, discard, roots

#: The bound may be a rounding error too small.
SLACK = 1e-9
#: Traces of a frame that one task joins with others at a time, and members of a cluster.
HOT, BLOCK = 4096, 64
#: Traces of a frame from which on it is told apart from rarer ones.
COMMON = 256
#: Meetings of traces at frames whose sums are made at a time.
MEETS = 64_000_000
#: Digits of a distance that count when merges are ordered.
DIGITS = 12


def weight(n: Column) -> Column:
    """The sum of exp(-DEPTH i) over the places 1 to n."""
    return math.exp(-DEPTH) * (1 - F.exp(-DEPTH * n)) / (1 - math.exp(-DEPTH))


def _coded(d: DataFrame, id: str, keys: str) -> DataFrame:
    """(i, h, g): the frames of a trace as hashes, which only choose what is compared, and which of 31 bits they set; equal hashes of different frames cost a comparison."""
    return d.select(F.col(id).alias("i"), F.transform(keys, lambda x: F.hash(x)).alias("h")).where("size(h) > 0").withColumn("g", F.expr("aggregate(h, 0, (s, x) -> s | shiftleft(1, pmod(x, 31)))"))


def _common(*coded: DataFrame) -> DataFrame:
    """(f, df): the frames that COMMON traces hold or more."""
    each = reduce(DataFrame.union, (d.select(F.explode(F.array_distinct("h")).alias("f")) for d in coded))
    return cut(each.groupBy("f").agg(F.count("*").alias("df")).where(F.col("df") >= min(COMMON, HOT)), "common")


def _offers(coded: DataFrame, common: DataFrame | None, least: float) -> DataFrame:
    """(i, h, g, f, earlier, need, bits) for the frames with which a trace is looked for: those at places besides the most common ones, and among these the lightest,
    that together weigh ``least`` of the trace at most. earlier: those offered before f; need: how many different frames it takes to exceed ``least``; bits: how many of the
    bits of ``g`` these set at least.
    """
    if common is None:
        times = "0L"
    else:
        held = coded.select("i", F.explode(F.array_distinct("h")).alias("f")).join(common, "f").groupBy("i").agg(F.collect_list(F.struct("f", "df")).alias("held"))
        coded, times = coded.join(held, "i", "left"), "coalesce(get(filter(held, y -> y.f = x), 0).df, 0L)"
    limit = f"({least}D * {_weight_sql('size(h)')} - {SLACK}D)"
    places = f"array_sort(transform(h, (x, p) -> named_struct('c', - {times}, 'w', exp(-{DEPTH}D * (p + 1)), 'f', x)))"
    fold = f"""array_distinct(aggregate({places}, named_struct('r', 0D, 'o', cast(array() as array<int>)),
        (s, e) -> named_struct('r', s.r + e.w, 'o', if(s.r + e.w > {limit}, array_append(s.o, e.f), s.o)), s -> s.o))"""
    need = f"if(size(array_distinct(h)) < size(h), 1, 1 + size(filter(sequence(1, size(h)), n -> {_weight_sql('n')} <= {limit})))"
    offers = coded.select("i", "h", "g", F.expr(fold).alias("o"), F.expr(need).alias("need")).withColumn("bits", F.expr("need - size(array_distinct(h)) + bit_count(g)"))
    return offers.select("*", F.posexplode("o").alias("at", "f")).select("i", "h", "g", "f", F.expr("slice(o, 1, at)").alias("earlier"), "need", "bits")


def _weight_sql(n: str) -> str:
    return f"{math.exp(-DEPTH) / (1 - math.exp(-DEPTH))}D * (1 - exp(-{DEPTH}D * {n}))"


def _meet(short: DataFrame, long: DataFrame, common: DataFrame, least: float, condition: str, *out: str) -> DataFrame:
    """(a, b) or ``out`` of :func:`_coded` traces whose similarity may exceed ``least``, each pair once, a being of ``short``; condition: of a, ha and b, hb.

    A pair meets at each frame that one offers and the other has, and stays at the first of these; whether it can be similar enough is told there by the hashes of all
    frames, so what is too far isn't shuffled. The traces of a frame are dealt into parts of HOT, so that what joins a frame of most traces is many tasks' work.
    """
    n, most = common.agg(F.count("*"), F.max("df")).first()
    if least > 0:
        offers = _offers(short, common if n else None, least)
    else:
        each = short.withColumn("o", F.array_distinct("h")).select("*", F.posexplode("o").alias("at", "f"))
        offers = each.withColumn("earlier", F.expr("slice(o, 1, at)")).drop("o", "at")
    every = long.select("i", "h", "g", F.explode(F.array_distinct("h")).alias("f"))
    on = ["f"]
    if n and most >= HOT:
        hot = common.where(F.col("df") >= HOT).select("f", (F.col("df") / HOT).cast("int").alias("last"))
        last = F.coalesce("last", F.lit(0))
        offers = offers.join(hot, "f", "left").withColumn("part", F.explode(F.sequence(F.lit(0), last))).drop("last")
        every = every.join(hot, "f", "left").withColumn("part", F.pmod(F.xxhash64("i"), last + 1).cast("int")).drop("last")
        on.append("part")
    # a size that the optimizer guesses from the traces misses what explode makes of them, so nothing is broadcast
    met = offers.withColumnsRenamed({"i": "a", "h": "ha", "g": "ga"}).hint("merge").join(every.withColumnsRenamed({"i": "b", "h": "hb", "g": "gb"}), on).where(condition)
    if least > 0:
        met = met.where("bit_count(ga & gb) >= bits").where("size(array_intersect(ha, hb)) >= need")
    met = met.where("not coalesce(arrays_overlap(earlier, hb), false)")
    if least > 0:
        met = met.withColumn("bound", once(upper_bound("ha", "hb"))).where(F.col("bound") > least - SLACK)
    return met.select(*(out or ("a", "b")))


def candidate_pairs(traces: DataFrame, least: float = 0.0, id: str = "id", keys: str = "keys") -> DataFrame:
    """(id_a, id_b, ka, kb), id_a < id_b, of traces that share a frame and whose similarity may exceed ``least``.

    Traces without a common frame have similarity 0, so an equi-join on frames finds all pairs. A frame
    at place i adds at most exp(-DEPTH i) to a similarity, which is relative to the sum of these over the shorter trace. So to
    exceed ``least`` the shorter trace shares the frame of one of its places besides any that weigh no more than ``least`` of
    its sum together: these are taken from the frames that most traces hold. The shorter one's other
    frames are joined with all frames of the longer one.
    """
    coded = _coded(traces, id, keys)
    found = cut(_meet(coded, coded, _common(coded), least, "struct(size(ha), a) < struct(size(hb), b)"), "candidates")
    k = traces.select(F.col(id).alias("i"), F.col(keys).alias("k"))
    pairs = found.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
    return pairs.join(k.select(F.col("i").alias("id_a"), F.col("k").alias("ka")), "id_a").join(k.select(F.col("i").alias("id_b"), F.col("k").alias("kb")), "id_b")


def pairs_across(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(l, r, kl, kr, bound) of traces (l, keys) and (r, keys) whose similarity may be ``least`` or more, by the rare frames of the shorter one; bound is above the similarity."""
    sides = [d.select(F.col(c).alias("i"), F.col("keys").alias("k")) for d, c in ((left, "l"), (right, "r"))]
    x, y = (_coded(d, "i", "k") for d in sides)
    common = _common(x, y)
    found = _meet(x, y, common, least, "size(ha) <= size(hb)").toDF("l", "r").union(_meet(y, x, common, least, "size(ha) < size(hb)").select(F.col("b").alias("l"), F.col("a").alias("r")))
    met = cut(found, "candidates").join(sides[0].select(F.col("i").alias("l"), F.col("k").alias("kl")), "l").join(sides[1].select(F.col("i").alias("r"), F.col("k").alias("kr")), "r")
    return met.withColumn("bound", upper_bound("kl", "kr")).where(F.col("bound") > least - SLACK)


def once(value: Column) -> Column:
    """``value`` worked out once for a row, and not again in each filter on it."""
    return F.explode(F.array(value))


def distances(traces: DataFrame, least: float = 0.0, id: str = "id", keys: str = "keys") -> DataFrame:
    """(id_a, id_b, dist) of the candidate pairs; other pairs are at distance 1."""
    return candidate_pairs(traces, least, id, keys).select("id_a", "id_b", once(1 - similarity("ka", "kb")).alias("dist"))


def link(near: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(v, first, height, size) of the items that complete linkage merges: the first item of their cluster, the height of its last merge, its items.

    ``near``: id_a < id_b, dist, with all pairs below ``threshold``; others are too far to merge. In each round every pair of
    clusters that are each other's nearest merges: no merge brings another cluster nearer than the farther one of its halves
    was, so such a pair merges before anything else happens to it, in whatever order merges are taken. Ties go to the smallest
    members, as the least distance of all would. The distance of two merged clusters is the largest of all pairs across, and
    a pair that isn't in the table is too far: an edge stays only if each half of one has an edge to each half of the other.

    A round is a few joins and aggregates on the edges; no cluster or component is gathered. Merges in which each cluster waits for
    the next one need distances that more than double each time, so rounds are few.
    """
    kind = near.schema["id_a"].dataType
    edges = cut(near.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.round("dist", DIGITS).alias("d")).where(F.col("d") < threshold), "edges")
    merges = None
    while edges.limit(1).count():
        key = F.struct("d", "a", "b")
        best = edges.select(F.explode(F.array("a", "b")).alias("v"), key.alias("e")).groupBy("v").agg(F.min("e").alias("e"))
        pairs = cut(best.groupBy("e").agg(F.count("*").alias("n")).where("n = 2").select("e.a", "e.b", "e.d"), "merges")
        merges = pairs if merges is None else merges.union(pairs)
        into = pairs.select(F.explode(F.array("a", "b")).alias("v"), F.col("a").alias("to"))
        moved = edges.join(into.select(F.col("v").alias("a"), F.col("to").alias("ta")), "a", "left").join(into.select(F.col("v").alias("b"), F.col("to").alias("tb")), "b", "left")
        halves = F.when(F.col("ta").isNull(), 1).otherwise(2) * F.when(F.col("tb").isNull(), 1).otherwise(2)
        moved = moved.select(F.coalesce("ta", "a").alias("x"), F.coalesce("tb", "b").alias("y"), "d", halves.alias("need")).where("x <> y")
        across = moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("d").alias("d"), F.count("*").alias("n"), F.max("need").alias("need"))
        last, edges = edges, cut(across.where("n = need").select("a", "b", "d"), "edges")
        discard(last)
    if merges is None:
        return near.sparkSession.createDataFrame([], StructType([StructField("v", kind), StructField("first", kind), StructField("height", DoubleType()), StructField("size", LongType())]))
    parents = roots(merges.select(F.col("b").alias("v"), F.col("a").alias("parent")))
    clusters = merges.join(parents.select(F.col("v").alias("a"), "root"), "a", "left").groupBy(F.coalesce("root", "a").alias("first")).agg(F.max("d").alias("height"), (F.count("*") + 1).alias("size"))
    items = parents.select("v", F.col("root").alias("first"))
    return items.union(clusters.select(F.col("first").alias("v"), "first")).join(clusters, "first").select("v", "first", "height", "size")


def cluster(traces: DataFrame, threshold: float = THRESHOLD, id: str = "id", keys: str = "keys") -> DataFrame:
    """(id, cluster) by complete linkage of distinct traces, numbered from 1.

    Equal traces are at distance 0 and are clustered as one. Numbers go to single traces in
    order of ids and then to merged clusters in the order of their last merges.
    """
    # read once: what makes the traces isn't done again for the result
    own = cut(traces.select(F.col(id).alias("id"), F.col(keys).alias("keys")), "own")
    rep = cut(own.groupBy("keys").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "traces")
    merged = link(distances(rep, 1 - threshold, "rep").where(F.col("dist") < threshold), threshold)
    shaped = rep.join(merged.withColumnRenamed("v", "rep"), "rep", "left").withColumn("first", F.coalesce("first", "rep"))
    shaped = cut(shaped.withColumn("many", (F.coalesce("size", F.lit(1)) > 1) | (F.col("n") > 1)).withColumn("height", F.coalesce("height", F.lit(0.0))), "linked")
    groups = shaped.groupBy("first").agg(F.max("many").alias("many"), F.max("height").alias("height"))
    numbers = rank(groups, ["many", "height", "first"], "cluster")
    return own.join(shaped.select("keys", "first"), "keys").join(numbers.select("first", "cluster"), "first").select("id", F.col("cluster").cast("int").alias("cluster"))


def rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with 1, 2, ... in ``order``, without gathering all rows in one task.

    Rows are sorted by ranges into a table; each task's rows are counted, and the counts before it
    (a row for each task) are added to the place within it.
    """
    rows = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return rows.withColumn("_i", local).join(before.select("_p", "_b"), "_p").withColumn(name, F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")


def running(df: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the earlier rows of a row's group, in an order without ties and without gathering a group in one task."""
    rows = cut(df.repartitionByRange(*group, *order).withColumn("_v", value).withColumn("_p", F.spark_partition_id()), "ranges")
    sums = rows.groupBy("_p", *group).agg(F.sum("_v").alias("_s"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_p", *group, F.coalesce(F.sum("_s").over(earlier(Window.partitionBy(*group).orderBy("_p"))), F.lit(0)).alias("_b"))
    local = F.coalesce(F.sum("_v").over(earlier(Window.partitionBy("_p", *group).orderBy(*order))), F.lit(0))
    return rows.withColumn("_l", local).join(before, ["_p", *group]).withColumn(name, F.col("_b") + F.col("_l")).drop("_p", "_v", "_b", "_l")


def common_start(first: str, second: str) -> Column:
    """How many frames two traces begin alike."""
    shorter = f"least(size({first}), size({second}))"
    return F.expr(f"if({shorter} = 0, 0, coalesce(get(filter(sequence(1, {shorter}), i -> {first}[i - 1] <> {second}[i - 1]), 0) - 1, {shorter}))")


def _farthest(unique: DataFrame, pivots: DataFrame) -> DataFrame:
    """(cluster, far, id, keys): the member that is farthest from its cluster's pivot (cluster, pivot)."""
    apart = F.when(F.arrays_overlap("keys", "pivot"), 1 - similarity("keys", "pivot")).otherwise(F.lit(1.0))
    met = unique.join(pivots, "cluster").select("cluster", F.struct(apart.alias("far"), "id", "keys").alias("x"))
    return met.groupBy("cluster").agg(F.max("x").alias("x")).select("cluster", "x.*")


def _widest(unique: DataFrame) -> DataFrame:
    """(cluster, d): the largest distance of two distinct traces of a cluster, by branch and bound.

    The traces farthest from a first one, and from that one, give a distance to beat: 1 can't be beaten. Traces of
    the other clusters in order of their frames are cut into blocks, which share a beginning. Traces that begin with the same c frames have a
    similarity of that beginning's weight at least, so pairs of blocks, and then pairs of traces, that can't beat it are left
    out. The blocks of a cluster are many tasks' work.
    """
    first = unique.groupBy("cluster").agg(F.min(F.struct("id", "keys")).alias("x"), F.count("*").alias("n")).where("n > 1")
    one = cut(_farthest(unique, first.select("cluster", F.col("x.keys").alias("pivot"))).join(first.select("cluster", "n"), "cluster"), "pivots")
    two = _farthest(unique, one.where("far < 1 and n > 2").select("cluster", F.col("keys").alias("pivot"))).select("cluster", F.col("far").alias("second"))
    low = cut(one.join(two, "cluster", "left").select("cluster", "n", F.greatest("far", F.coalesce("second", F.lit(0.0))).alias("low")), "widths")
    if low.where("low < 1 and n > 3").limit(1).count() == 0:
        return low.select("cluster", F.col("low").alias("d"))
    open_ = unique.join(low.where("low < 1 and n > 3"), "cluster").select("cluster", "keys", "id", "low")
    dealt = cut(running(open_, ["cluster"], ["keys"], F.lit(1), "at").withColumn("block", F.expr(f"at div {BLOCK}")), "dealt")
    ends = dealt.groupBy("cluster", "block", "low").agg(F.min("keys").alias("k1"), F.max("keys").alias("k2"), F.max(F.size("keys")).alias("size"))
    ends = cut(ends.select("cluster", "block", "low", "size", F.slice("k1", F.lit(1), common_start("k1", "k2")).alias("start")), "blocks")
    side = lambda x: ends.select("cluster", *(F.col(c).alias(c + x) for c in ("block", "size", "start")), *(["low"] if x == "a" else []))
    reach = lambda same, size: 1 - weight(same) / weight(size)
    met = side("a").join(side("b"), "cluster").where("blocka <= blockb").where(reach(common_start("starta", "startb"), F.least("sizea", "sizeb")) > F.col("low") + SLACK)
    traces = lambda x: dealt.select("cluster", F.col("block").alias("block" + x), F.col("at").alias("at" + x), F.col("keys").alias("k" + x))
    pairs = met.select("cluster", "blocka", "blockb", "low").join(traces("a"), ["cluster", "blocka"]).join(traces("b"), ["cluster", "blockb"]).where("ata < atb")
    pairs = pairs.where(reach(common_start("ka", "kb"), F.least(F.size("ka"), F.size("kb"))) > F.col("low") + SLACK)
    best = pairs.groupBy("cluster").agg(F.max(F.when(F.arrays_overlap("ka", "kb"), 1 - similarity("ka", "kb")).otherwise(F.lit(1.0))).alias("best"))
    return low.join(best, "cluster", "left").select("cluster", F.greatest("low", F.coalesce("best", F.lit(0.0))).alias("d"))


def distinct_members(members: DataFrame) -> DataFrame:
    """(cluster, keys, id, n): each distinct trace of a cluster with its first id and how often it occurs."""
    return members.groupBy("cluster", "keys").agg(F.min("id").alias("id"), F.count("*").alias("n"))


def diameters(members: DataFrame) -> DataFrame:
    """(cluster, size, diameter): the largest distance of two members, 0 for one. ``members``: id, cluster, keys."""
    unique = cut(distinct_members(members), "members")
    wide = _widest(unique.where("size(keys) > 0"))
    return unique.groupBy("cluster").agg(F.sum("n").alias("size")).join(wide, "cluster", "left").select("cluster", "size", F.coalesce("d", F.lit(0.0)).alias("diameter"))


def report_distances(members: DataFrame, reports: DataFrame) -> DataFrame:
    """(report_id, cluster, dist): the distance of a report from its farthest member. ``reports``: report_id, keys.

    Clusters of which no member shares a frame with the report are left out: they are at distance 1.
    """
    unique = cut(distinct_members(members), "members")
    sizes = unique.groupBy("cluster").agg(F.count("*").alias("size"))
    r = reports.select("report_id", F.col("keys").alias("kr"))
    frames = lambda df, keys, *names: df.select(*names, F.explode(F.array_distinct(keys)).alias("f"))
    met = frames(r, "kr", "report_id").join(frames(unique, "keys", "cluster", "id"), "f").select("report_id", "cluster", "id").distinct()
    each = met.join(r, "report_id").join(unique.select("cluster", "id", "keys"), ["cluster", "id"])
    far = each.groupBy("report_id", "cluster").agg(F.max(1 - similarity("kr", "keys")).alias("d"), F.count("*").alias("met"))
    return far.join(sizes, "cluster").select("report_id", "cluster", F.when(F.col("met") < F.col("size"), F.lit(1.0)).otherwise(F.col("d")).alias("dist"))


def _nearness(some: DataFrame, whole: DataFrame, common: DataFrame) -> DataFrame:
    """(uid, own, b, met) of members (i, h): the sum of similarities to the others of their cluster, the least mean distance of a cluster they share a frame with, and how many of these there are."""
    # most pairs have one frame in common, once in each, and are no more alike than by its places
    p, q = F.expr("array_position(ha, f)"), F.expr("array_position(hb, f)")
    single = F.expr("size(array_intersect(ha, hb)) = 1 and size(array_remove(ha, f)) = size(ha) - 1 and size(array_remove(hb, f)) = size(hb) - 1")
    alone = F.exp(-(DEPTH * F.least(p, q) + SHIFT * F.abs(p - q))) / weight(F.least(F.size("ha"), F.size("hb")))
    met = _meet(some, whole, common, 0.0, "a <> b", "a", "b", F.when(single, alone).otherwise(similarity("ha", "hb")).alias("s"))
    each = met.select("a.cluster", "a.id", F.col("b.cluster").alias("oc"), F.col("b.size").alias("os"), (F.col("s") * F.col("b.n")).alias("s"))
    # all pairs of a member come to one task, which sums them up by clusters and then over these
    each = each.repartition("cluster", "id").groupBy("cluster", "id", "oc").agg(F.sum("s").alias("s"), F.first("os").alias("os"))
    inside = F.col("oc") == F.col("cluster")
    # copies of the trace itself are in its cluster with similarity 1
    own, b = F.sum(F.when(inside, F.col("s"))).alias("own"), F.min(F.when(~inside, 1 - F.col("s") / F.col("os"))).alias("b")
    return each.groupBy("cluster", "id").agg(own, b, F.count(F.when(~inside, 1)).alias("met")).select(F.struct("cluster", "id").alias("uid"), "own", "b", "met")


def silhouettes(members: DataFrame) -> DataFrame:
    """(id, cluster, a, b, silhouette) of each member; 0 for the only member of a cluster.

    Only traces that share a frame are compared: the others are at distance 1, so a cluster's
    mean distance follows from the sum of similarities and its size. Clusters that
    share no frame with a member are at mean distance 1.

    No pair is kept: members are taken in slices of about MEETS meetings with others, each of which is summed up to a row for a member
    before the next one, so disk is bounded whatever the number of pairs. The work is that of all pairs with a common frame.
    """
    unique = cut(distinct_members(members), "members")
    sizes = unique.groupBy("cluster").agg(F.sum("n").alias("size"))
    clusters = unique.agg(F.count_distinct("cluster")).first()[0]
    rows = cut(unique.join(sizes, "cluster").select(F.struct("cluster", "id").alias("uid"), "cluster", "id", "keys", "n", "size"), "sized")
    # whole traces meet, each at its frames; g is for hashes only
    whole = rows.where("size(keys) > 0").select(F.struct("cluster", "id", "n", "size").alias("i"), F.col("keys").alias("h"), F.lit(0).alias("g"))
    common = _common(whole)
    held = whole.select(F.explode(F.array_distinct("h")).alias("f")).groupBy("f").agg(F.count("*").alias("df"))
    slices = int((held.agg(F.sum(F.col("df").cast("double") * F.col("df"))).first()[0] or 0) // MEETS) + 1
    seen = [cut(_nearness(whole.where(F.pmod(F.xxhash64("i"), F.lit(slices)) == k), whole, common), "nearness") for k in range(slices)]
    x = rows.join(reduce(DataFrame.union, seen), "uid", "left")
    a = (F.col("size") - F.col("n") - F.coalesce("own", F.lit(0.0))) / (F.col("size") - 1)
    x = x.withColumn("a", F.when(F.col("size") > 1, a)).withColumn("b", F.when(F.coalesce("met", F.lit(0)) < clusters - 1, F.least(F.coalesce("b", F.lit(1.0)), F.lit(1.0))).otherwise(F.col("b")))
    sil = F.when(F.col("size") == 1, F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    each = members.select(F.col("id").alias("mid"), F.col("cluster").alias("mc"), F.col("keys").alias("mk"))
    return each.join(x, (F.col("mc") == F.col("cluster")) & (F.col("mk") == F.col("keys"))).select(F.col("mid").alias("id"), "cluster", "a", "b", sil.alias("silhouette"))


def mean_silhouette(members: DataFrame) -> DataFrame:
    """(clusters, reports, silhouette); no reports and fewer than two clusters are errors."""
    got = silhouettes(members).groupBy().agg(F.count_distinct("cluster").alias("clusters"), F.count("*").alias("reports"), F.avg("silhouette").alias("silhouette"))
    fail = lambda text: F.raise_error(F.lit(text))
    checked = F.when(F.col("reports") == 0, fail("a silhouette needs reports")).when(F.col("clusters") < 2, fail("a silhouette needs two clusters")).otherwise(F.col("clusters"))
    # a filter runs whatever columns are read
    return got.withColumn("clusters", checked.cast("long")).where("clusters >= 2")
