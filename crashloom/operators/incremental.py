"""Adding reports to clusters that exist: relations, insertion in order, accumulation of the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import THRESHOLD
from ..functions.similarity import similarity, upper_bound
from .clustering import BLOCK, SLACK, diameters, distances, distinct_members, link, pairs_across, rank, running
from .dedup import dedup_crash_lines
from .graph import cut


def compared(members: DataFrame, new: DataFrame) -> DataFrame:
    """(report_id, cluster, size, nth, dist): the pairs of a new report and a distinct trace of a cluster that must be compared; nth is the trace's place by its first id.

    Pairs come from the rare frames of the shorter trace, and a bound on the similarity leaves out those that are further apart than the
    threshold. A report with fewer such pairs than a cluster has traces is too far from one of
    them, whichever it is; its distances only matter if the bound lets one of the traces be a dup.
    """
    unique = cut(running(distinct_members(members), ["cluster"], ["id"], F.lit(1), "earlier"), "members")
    sizes = unique.groupBy("cluster").agg(F.count("*").alias("size"))
    met = pairs_across(new.select(F.col("report_id").alias("l"), "keys"), unique.select(F.struct("cluster", "id", (F.col("earlier") + 1).alias("nth")).alias("r"), "keys"), 1 - THRESHOLD)
    met = cut(met.select(F.col("l").alias("report_id"), "r.cluster", "r.nth", "kl", "kr", "bound"), "candidates")
    wanted = met.groupBy("report_id", "cluster").agg(F.count("*").alias("met"), F.max("bound").alias("best")).join(sizes, "cluster")
    wanted = wanted.where((F.col("met") == F.col("size")) | (F.col("best") >= 1 - SLACK)).select("report_id", "cluster", "size")
    return met.join(wanted, ["report_id", "cluster"]).select("report_id", "cluster", "size", "nth", (1 - similarity("kl", "kr")).alias("dist"))


def _unbroken(rows: DataFrame, key: list[str], place: str, name: str) -> DataFrame:
    """(key, name): how many places 1, 2, ... the rows of a key have without a gap."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(place))
    return rows.withColumn("_n", nth).groupBy(*key).agg(F.sum((F.col("_n") == F.col(place)).cast("long")).alias(name))


def relations(members: DataFrame, new: DataFrame) -> DataFrame:
    """(report_id, cluster, kind, measure, diameter, open) of each new report to each cluster with a trace near it; to others it is outer.

    ``members``: id, cluster, keys; ``new``: report_id, keys. A cluster's members are looked at
    in order of ids: at distance 0 the report is a dup; at more than the threshold it is outer at
    once, so a dup behind a far member doesn't count; else it is inner if the cluster doesn't
    grow wider by it, with the cluster's diameter as measure. It is ``open`` if members that are
    added later can change it: no old one is at distance 0 or far.

    Only near members are looked at: if those up to the dup have places without a gap, none before it is far, and if they are
    all, none is.
    """
    near = cut(compared(members, new).where(F.col("dist") <= THRESHOLD), "near-members")
    key = ["report_id", "cluster"]
    seen = near.groupBy(*key, "size").agg(F.count("*").alias("n"), F.max("dist").alias("widest"), F.min(F.when(F.col("dist") == 0, F.col("nth"))).alias("dup")).join(_unbroken(near, key, "nth", "unbroken"), key)
    seen = cut(seen.withColumn("full", F.col("n") == F.col("size")), "seen")
    full = seen.where("full and dup is null").select("cluster").distinct()
    wide = diameters(members.join(full, "cluster", "left_semi")).select("cluster", "diameter")
    dup = F.coalesce(F.col("dup") <= F.col("unbroken"), F.lit(False))
    kind = F.when(dup, "dup").when(F.col("full") & (F.col("diameter") >= F.col("widest")), "inner").otherwise("outer")
    return seen.join(wide, "cluster", "left").select(*key, kind.alias("kind"), F.when(kind == "inner", F.col("diameter")).alias("measure"), "diameter", (F.col("full") & F.col("dup").isNull()).alias("open"))


def nearest(related: DataFrame) -> DataFrame:
    """(report_id, cluster) of the inner cluster of the least diameter, ties to the smallest number."""
    inner = related.where("kind = 'inner'")
    return inner.groupBy("report_id").agg(F.min(F.struct("measure", "cluster")).alias("x")).select("report_id", F.col("x.cluster").alias("cluster"))


def _settled(members: DataFrame, batch: DataFrame, traces: DataFrame, related: DataFrame, unique_lines: bool) -> DataFrame | None:
    """(report_id, dup, cluster, stays) of the reports that fit a cluster or may be dups of what the batch adds; None if there are none.

    ``batch``: report_id, rep, crashline; ``traces``: rep, keys, the distinct ones; ``related``: the
    relations of traces to old members. Each report depends on earlier ones only, so the rounds
    have one fixed point, that of insertion in order of ids; a round settles one more link of each chain.
    """
    dups = related.where("kind = 'dup'").select("rep").distinct()
    open_ = cut(related.where("open").join(dups, "rep", "left_anti").select("rep", "cluster", (F.col("kind") == "inner").alias("inner"), "diameter"), "open")
    if open_.limit(1).count() == 0:
        return None
    keyed = open_.join(traces, "rep")
    # which of the batch's traces are near one that may be added to the same cluster
    near = pairs_across(keyed.where("inner").select(F.col("rep").alias("l"), "keys").distinct(), keyed.select(F.col("rep").alias("r"), "keys").distinct(), 1 - THRESHOLD)
    near = near.select("l", "r", F.when(F.col("l") == F.col("r"), 0.0).otherwise(1 - similarity("kl", "kr")).alias("dist")).where(F.col("dist") <= THRESHOLD)
    near = near.join(open_.where("inner").select(F.col("rep").alias("l"), "cluster"), "l").join(open_.select(F.col("rep").alias("r"), "cluster", "diameter"), ["r", "cluster"])
    near = cut(near.select("cluster", F.col("l").alias("by"), F.col("r").alias("rep"), (F.col("dist") == 0).alias("zero"), (F.col("dist") <= F.col("diameter")).alias("tight")), "near")
    live = cut(batch.join(open_, "rep"), "live")
    lines = members.select("cluster", "crashline").where("crashline <> ''").distinct().withColumn("known", F.lit(True))
    key = ["rep", "cluster"]
    state = None
    while True:
        if state is None:
            seen = live.select("*", F.lit(False).alias("dup"), F.col("inner").alias("fits"))
        else:
            added = state.where("stays").groupBy("cluster", "rep").agg(F.min("report_id").alias("at"))
            flagged = live.join(added, ["cluster", "rep"], "left").withColumn("adds", F.coalesce(F.col("at") == F.col("report_id"), F.lit(False)))
            # how many have been added before each report, and by that the places of the added ones
            counted = cut(running(flagged, ["cluster"], ["report_id"], F.col("adds").cast("long"), "before"), "counted")
            places = counted.where("adds").select("cluster", F.col("rep").alias("by"), "at", (F.col("before") + 1).alias("place"))
            met = cut(near.join(places, ["cluster", "by"]), "met")
            zero = met.where("zero").groupBy(*key).agg(F.min("at").alias("zero"), F.min("place").alias("zero_place"))
            seen = counted.drop("at").join(zero, key, "left").join(_unbroken(met, key, "place", "near_to"), key, "left").join(_unbroken(met.where("tight"), key, "place", "tight_to"), key, "left")
            # a dup unless a far one comes first; it fits if all before it are near enough
            dup = F.coalesce((F.col("zero") < F.col("report_id")) & (F.col("zero_place") <= F.col("near_to")), F.lit(False))
            seen = seen.withColumn("dup", dup).withColumn("fits", F.col("inner") & ~F.col("dup") & (F.col("before") <= F.coalesce("tight_to", F.lit(0))))
        chosen = seen.groupBy("report_id", "rep", "crashline").agg(F.max("dup").alias("dup"), F.min(F.when(F.col("fits"), F.struct("diameter", "cluster"))).alias("x"))
        chosen = chosen.select("report_id", "rep", "crashline", "dup", F.when(~F.col("dup"), F.col("x.cluster")).alias("cluster"))
        stays = F.col("cluster").isNotNull()
        if unique_lines:
            firsts = chosen.where("cluster is not null and crashline <> ''").groupBy("cluster", "crashline").agg(F.min("report_id").alias("first"))
            chosen = chosen.join(firsts, ["cluster", "crashline"], "left").join(lines, ["cluster", "crashline"], "left")
            stays = stays & F.coalesce(F.col("first") == F.col("report_id"), F.lit(True)) & F.col("known").isNull()
        step = cut(chosen.select("report_id", "rep", "dup", "cluster", stays.alias("stays")), "settled")
        if state is not None:
            was = state.select("report_id", F.struct("dup", "cluster", "stays").alias("was"))
            if step.join(was, "report_id").where(~F.struct("dup", "cluster", "stays").eqNullSafe(F.col("was"))).limit(1).count() == 0:
                return step
        elif step.where("stays").limit(1).count() == 0:
            return step
        state = step


def update(members: DataFrame, new: DataFrame, unique_lines: bool = False, top: int | None = None) -> DataFrame:
    """(report_id, outcome, cluster) of each new report.

    Outcomes: duplicate; added or deduplicated (by crash line) to an old cluster; deviant ones
    are clustered with the old clusters and join one (moved, removed) or form new ones
    (new, new_removed), numbered from the largest old number on, or from ``top`` where ``members`` are only those of some clusters.

    ``members``: id, cluster, keys, crashline; ``new``: report_id (unique), keys, crashline. Reports
    are inserted in order of ids, and each one added is a member for later ones: these are dups at
    distance 0 of it, and deviant if they are too far from it. Insertions never widen a cluster, so
    diameters stay. Deviants meet the clusters with what was added.
    """
    traces = cut(new.groupBy("keys").agg(F.min("report_id").alias("rep")).select("rep", "keys"), "batch-traces")
    batch = cut(new.join(traces.withColumnRenamed("keys", "_keys"), F.col("keys").eqNullSafe(F.col("_keys"))).drop("_keys"), "batch")
    related = cut(relations(members, traces.withColumnRenamed("rep", "report_id")).withColumnRenamed("report_id", "rep"), "relations")
    copies = batch.join(related.where("kind = 'dup'").select("rep").distinct(), "rep").select("report_id")
    settled = _settled(members, batch.select("report_id", "rep", "crashline"), traces, related, unique_lines)
    rid = F.col("report_id").cast("string").alias("report_id")
    none = F.lit(None).cast("int").alias("cluster")
    out = copies.select(rid, F.lit("duplicate").alias("outcome"), none)
    old = members.select(F.concat(F.lit("m"), F.col("id")).alias("id"), "cluster", "keys", "crashline")
    done = copies
    if settled is not None:
        kept = settled.where("dup or cluster is not null")
        out = out.union(kept.select(rid, F.when(F.col("dup"), "duplicate").when(F.col("stays"), "added").otherwise("deduplicated"), F.col("cluster").cast("int")))
        old = old.union(settled.where("stays").select("report_id", "cluster").join(batch, "report_id").select(F.concat(F.lit("r"), F.col("report_id")), "cluster", "keys", "crashline"))
        done = done.union(kept.select("report_id"))
    deviants = cut(batch.join(done, "report_id", "left_anti").select("report_id", "keys", "crashline"), "deviants")
    return out.union(accumulate(cut(old, "members"), deviants, unique_lines, top).select(rid, "outcome", "cluster"))


def item_distances(items: DataFrame, members: DataFrame) -> DataFrame:
    """(ia, ib, d) of the items (item, h, keys) of which all traces across are nearer than the threshold; d is the largest distance, and for two clusters the width of their union.

    One trace that is too far settles a pair of items. First one trace stands for each item: items whose stand-ins are too far
    from each other go. Then the bound on the similarity of all traces across is looked at, and only pairs of items without a
    pair beyond it have their traces compared. The traces of an item are joined in blocks, so a large one is many tasks' work.
    """
    stand = items.groupBy("item").agg(F.min(F.struct("h", "keys")).alias("x"), F.count("*").alias("n"))
    stand = cut(stand.select("item", F.col("x.keys").alias("keys"), "n"), "stand-ins")
    close = distances(stand, 1 - THRESHOLD, "item").where(F.col("dist") < THRESHOLD).select(F.col("id_a").alias("ia"), F.col("id_b").alias("ib"), F.col("dist").alias("d"))
    size = lambda x: stand.select(F.col("item").alias("i" + x), F.col("n").alias("n" + x))
    close = cut(close.join(size("a"), "ia").join(size("b"), "ib"), "close-items")
    blocked = cut(items.select("item", "keys", F.pmod(F.xxhash64("h"), F.lit(1 << 30)).alias("x")).join(stand.select("item", "n"), "item").withColumn("block", F.expr(f"x % (n div {BLOCK} + 1)")), "item-traces")
    traces = lambda x: blocked.select(F.col("item").alias("i" + x), F.col("block").alias("b" + x), F.col("keys").alias("k" + x))

    def across(pairs: DataFrame) -> DataFrame:
        spread = lambda df, x: df.withColumn("b" + x, F.explode(F.expr(f"sequence(0, n{x} div {BLOCK})")))
        return spread(spread(pairs, "a"), "b").join(traces("a"), ["ia", "ba"]).join(traces("b"), ["ib", "bb"])

    large = close.where("na * nb > 1").drop("d")
    if large.limit(1).count() == 0:
        # each item is one trace, so no cluster is wide
        return close.select("ia", "ib", "d")
    far = across(large).where(upper_bound("ka", "kb") <= 1 - THRESHOLD - SLACK).select("ia", "ib").distinct()
    left = cut(large.join(far, ["ia", "ib"], "left_anti"), "open-items")
    exact = across(left).groupBy("ia", "ib").agg(F.max(F.when(F.arrays_overlap("ka", "kb"), 1 - similarity("ka", "kb")).otherwise(F.lit(1.0))).alias("d")).where(F.col("d") < THRESHOLD)
    both = cut(close.where("na * nb = 1").select("ia", "ib", "d").union(exact), "near-items")
    # two clusters are as far apart as their union is wide; a report only counts its distances
    clusters = both.where("ia like 'c%' and ib like 'c%'").select(F.explode(F.array("ia", "ib")).alias("item")).distinct()
    if clusters.limit(1).count() == 0:
        return both
    wide = diameters(members.withColumn("item", F.concat(F.lit("c"), F.col("cluster"))).join(clusters, "item", "left_semi").drop("item")).select(F.concat(F.lit("c"), F.col("cluster")).alias("item"), "diameter")
    met = both.join(wide.select(F.col("item").alias("ia"), F.col("diameter").alias("da")), "ia", "left").join(wide.select(F.col("item").alias("ib"), F.col("diameter").alias("db")), "ib", "left")
    union = F.greatest("d", F.coalesce("da", F.lit(0.0)), F.coalesce("db", F.lit(0.0)))
    return met.select("ia", "ib", F.when(F.col("ia").startswith("c") & F.col("ib").startswith("c"), union).otherwise(F.col("d")).alias("d")).where(F.col("d") < THRESHOLD)


def accumulate(members: DataFrame, deviants: DataFrame, unique_lines: bool = False, top: int | None = None) -> DataFrame:
    """(report_id, outcome, cluster): deviants clustered together with whole clusters.

    The items are old clusters and deviant reports; two items are as far apart as the
    union of their traces is wide. Items further than the threshold from each other never
    meet, so linkage runs in the components of near items.
    """
    traces = members.select(F.concat(F.lit("c"), F.col("cluster")).alias("item"), "keys").union(deviants.select(F.concat(F.lit("r"), F.col("report_id")).alias("item"), "keys")).distinct()
    t = cut(traces.where("size(keys) > 0").withColumn("h", F.sha2(F.to_json("keys"), 256)), "items")
    both = cut(item_distances(t, members), "item-distances")
    grouped = link(both.select(F.col("ia").alias("id_a"), F.col("ib").alias("id_b"), F.col("d").alias("dist"))).select(F.col("v").alias("item"), F.col("first").alias("grp"))
    items = deviants.select(F.concat(F.lit("r"), F.col("report_id")).alias("item"), "report_id", "crashline").join(grouped, "item", "left").withColumn("grp", F.coalesce("grp", "item"))
    old = grouped.where("item like 'c%'").groupBy("grp").agg(F.min(F.substring("item", 2, 20).cast("int")).alias("old"))
    if top is None:
        top = members.agg(F.coalesce(F.max("cluster"), F.lit(0))).first()[0]
    named = cut(items.join(old, "grp", "left").withColumn("top", F.lit(int(top))), "deviant-groups")
    fresh = rank(named.where("old is null").groupBy("grp").agg(F.min("report_id").alias("first")), ["first"], "nth").select("grp", "nth")
    placed = named.join(fresh, "grp", "left").withColumn("cluster", F.coalesce("old", (F.col("top") + F.col("nth")).cast("int")))
    if unique_lines:
        earlier = members.select(F.lit(0).alias("late"), F.lit(None).cast(deviants.schema["report_id"].dataType).alias("rid"), F.col("id").cast("string").alias("mid"), F.col("cluster").cast("int"), "crashline")
        later = placed.select(F.lit(1).alias("late"), F.col("report_id").alias("rid"), F.lit("").alias("mid"), "cluster", "crashline")
        kept = dedup_crash_lines(earlier.union(later), order=("late", "rid", "mid")).where("late = 1 and cluster <> 0").select(F.col("rid").alias("_kept"))
        placed = placed.join(kept, placed["report_id"] == F.col("_kept"), "left").withColumn("stays", F.col("_kept").isNotNull())
    else:
        placed = placed.withColumn("stays", F.lit(True))
    outcome = F.when(F.col("old").isNotNull(), F.when(F.col("stays"), "moved").otherwise("removed")).otherwise(F.when(F.col("stays"), "new").otherwise("new_removed"))
    return placed.select("report_id", outcome.alias("outcome"), "cluster")


def counts(outcomes: DataFrame) -> DataFrame:
    """(added, duplicates, deduplicated, clusters, before, after) of an update."""
    n = lambda *names: F.sum(F.col("outcome").isin(*names).cast("long"))
    fresh = F.when(F.col("outcome").isin("new", "new_removed"), F.col("cluster"))
    return outcomes.agg(n("added", "moved").alias("added"), n("duplicate").alias("duplicates"), n("deduplicated", "removed").alias("deduplicated"), F.count_distinct(fresh).alias("clusters"), n("new", "new_removed").alias("before"), n("new").alias("after"))
