"""A Merkle manifest of a dataset, and proofs by descent through a content-addressed store.

Each row is a leaf: the SHA-256 of its fields. The leaves of a group, such as a source, in order of
their keys form a tree of runs of ``RUN`` nodes; the roots of the groups form one more. The store holds
records of a digest and what stands below it. A record is a page of up to ``LEVELS`` levels (a node's
children, theirs, and so on), so building and descending take one round of joins for each LEVELS digits of a rank.

Requests for leaves descend from the root: at each record the next digits of a leaf's rank choose
a child, and the children that are not chosen are collected. Leaves whose ranks begin alike
share one request until they part, so all rounds together have about 1/80 of the leaves as rows. A
path from the root to a leaf, reversed, is the leaf's proof.

No group is gathered: ranks come from a sort by ranges and counts of earlier ranges, and a page has at most
RUN ** LEVELS members.

Defined results: nulls in any field are part of the leaf; rows with a null group are a group, before the
others; rows with a null key come first. Rows with equal keys are in order of their digests, and equal rows are
leaves of their own. A table without rows has no proofs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RUN, LEVELS = 3, 4
PAGE = RUN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: What stands above a node: its place among its run, and the others from left to right.
STEP = "struct<digit:int,others:array<string>>"


def digest(*fields: Column) -> Column:
    """Lower-case hex SHA-256 of the fields, each ``-`` if null and else its bytes' count, a colon and its value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in text)), 256)


def _levels() -> str:
    """Levels above the members, as SQL of their number n, up to LEVELS."""
    return "case " + " ".join(f"when n <= {RUN**k} then {k}" for k in range(LEVELS)) + f" else {LEVELS} end"


#: From the digests of a page's members to all its levels, the members first.
_RISE = f"""if(up = 0, array(members), aggregate(sequence(1, up), array(members), (levels, l) -> array_append(levels,
    transform(sequence(0, cast((size(element_at(levels, -1)) - 1) div {RUN} as int)), j -> sha2(array_join(slice(element_at(levels, -1), {RUN} * j + 1, {RUN}), ''), 256)))))"""

#: The steps from the top of a page down to its member ``at``.
_STEPS = f"""if(size(levels) < 2, cast(array() as array<{STEP}>), transform(reverse(sequence(0, size(levels) - 2)), l -> struct(
    cast(at div element_at(array({", ".join(str(RUN**k) for k in range(LEVELS))}), l + 1) % {RUN} as int) as digit,
    filter(slice(levels[l], cast(at div element_at(array({", ".join(str(RUN ** (k + 1)) for k in range(LEVELS))}), l + 1) as int) * {RUN} + 1, {RUN}),
        (x, k) -> k <> at div element_at(array({", ".join(str(RUN**k) for k in range(LEVELS))}), l + 1) % {RUN}) as others)))"""


def _pages(nodes: DataFrame, *kept: str) -> DataFrame:
    """(tree, page, n, up, levels, rows) of nodes (tree, at, n, d) of trees of n > 1 nodes; rows has the columns ``kept`` of the members."""
    grouped = nodes.groupBy("tree", F.expr(f"at div {PAGE}").alias("page")).agg(F.array_sort(F.collect_list(F.struct("at", "d", *kept))).alias("rows"), F.max("n").alias("n"))
    grouped = grouped.withColumn("up", F.expr(_levels())).withColumn("members", F.col("rows.d"))
    return grouped.select("tree", "page", "n", "up", F.expr(_RISE).alias("levels"), *(["rows"] if kept else []))


def _above(pages: DataFrame) -> DataFrame:
    """The tops of pages as nodes of the next round."""
    return pages.select("tree", F.col("page").alias("at"), F.expr(f"cast(ceil(n / {float(PAGE)}) as long)").alias("n"), F.expr("element_at(levels, -1)[0]").alias("d"))


def _record(pages: DataFrame) -> DataFrame:
    return pages.select(F.expr("element_at(levels, -1)[0]").alias("digest"), "levels")


def build(pages: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(roots, store) from the lowest pages of trees: roots has (tree, root, rounds), store (digest, levels)."""
    roots, store, rounds = None, _record(pages), 1
    while True:
        tops = common.cut(_above(pages), f"{name}-tops")
        done = tops.where("n = 1").select("tree", F.col("d").alias("root"), F.lit(rounds).alias("rounds"))
        roots = done if roots is None else roots.union(done)
        if tops.where("n > 1").limit(1).count() == 0:
            return roots, store
        pages = common.cut(_pages(tops.where("n > 1")), f"{name}-pages")
        store, rounds = store.union(_record(pages)), rounds + 1


def descend(requests: DataFrame, store: DataFrame, name: str) -> DataFrame:
    """(tree, page, path) for each lowest page, from requests (tree, digest, rounds, path) at the roots of trees."""
    records = common.cut(store.dropDuplicates(["digest"]), f"{name}-records")
    open_, done = requests.withColumn("page", F.lit(0).cast("long")), None
    while True:
        low = open_.where("rounds = 1").select("tree", "page", "path")
        done = low if done is None else done.union(low)
        more = open_.where("rounds > 1")
        if more.limit(1).count() == 0:
            return done
        met = more.join(records, "digest").select("tree", "page", "rounds", "path", "levels", F.posexplode(F.col("levels")[0]).alias("at", "child"))
        met = met.select("tree", (F.col("page") * PAGE + F.col("at")).alias("page"), (F.col("rounds") - 1).alias("rounds"), F.expr(f"concat(path, {_STEPS})").alias("path"), F.col("child").alias("digest"))
        open_ = common.cut(met, f"{name}-requests")


def prove(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", key: str = "doc_id", suspect: Column | None = None) -> DataFrame:
    """(key, leaf, subroot, root, proof, folded_root, verified) of each row of ``docs``.

    ``proof`` has a step for each level from the leaf to the root: the place in its run and the other
    digests of the run. ``folded_root`` is worked out from the leaf that a verifier sees and the proof; ``suspect`` is that
    leaf where it may differ from the manifest's.
    """
    leaf = digest(*(F.col(f) for f in fields))
    rows = docs.select(F.col(group).alias("tree"), F.col(key).alias("k"), leaf.alias("d"), (F.lit(None).cast("string") if suspect is None else suspect).alias("seen"))
    nodes = common.ranked(rows, ["tree"], ["k", "d", "seen"], "at", "merkle-leaves", total="n")
    low = common.cut(_pages(nodes, "k", "seen"), "merkle-low")
    roots, store = build(low, "merkle-group")
    roots = common.cut(roots, "merkle-roots")
    tops = common.ranked(roots.select("tree", F.col("root").alias("d"), "rounds"), [], ["tree"], "at", "merkle-subroots", total="n")
    upper = common.cut(_pages(tops.withColumn("id", F.col("tree")).withColumn("tree", F.lit(0)), "id", "rounds"), "merkle-upper")
    top, above = build(upper, "merkle-top")
    top = top.select("tree", F.col("root").alias("digest"), "rounds", F.expr(f"cast(array() as array<{STEP}>)").alias("path"), F.col("root"))
    # one row
    at_top = descend(top.drop("root"), above, "merkle-top").join(upper, ["tree", "page"]).join(F.broadcast(top.select("tree", "root")), "tree")
    at_top = at_top.select("root", "levels", "path", F.posexplode("rows").alias("at", "row"))
    groups = common.cut(at_top.select("root", F.col("row.id").alias("tree"), F.col("row.d").alias("digest"), F.col("row.rounds").alias("rounds"), F.expr(f"concat(path, {_STEPS})").alias("path")), "merkle-groups")
    paths = common.cut(descend(groups.drop("root"), store, "merkle-group"), "merkle-paths")
    met = low.alias("p").join(paths.alias("q"), F.expr("p.tree <=> q.tree and p.page = q.page")).select("p.tree", "levels", "path", F.posexplode("rows").alias("at", "row"))
    names = groups.select(F.col("tree").alias("g"), F.col("digest").alias("subroot"), "root")
    met = met.join(common.small(names), F.expr("tree <=> g")).select(F.col("row.k").alias(key), F.col("row.d").alias("leaf"), "subroot", "root", "row.seen", F.expr(f"reverse(concat(path, {_STEPS}))").alias("proof"))
    met = met.withColumn("folded_root", fold(F.coalesce("seen", "leaf"), F.col("proof")))
    return met.select(key, "leaf", "subroot", "root", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    step = lambda d, s: F.sha2(F.concat(F.array_join(F.slice(s["others"], 1, s["digit"]), ""), d, F.array_join(F.slice(s["others"], s["digit"] + 1, RUN), "")), 256)
    return F.aggregate(proof, leaf, step)


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all other digests of a proof, level by level from the leaf to the root."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda s: s["others"])), ""), 256)
