"""N-gram Jaccard self-join: a size-aware heavy-light join over word shingles.

Two documents link when the Jaccard similarity of their distinct 5-word shingles
is 0.8 or more. Documents with equal sets form a class first; the join runs over
classes, which are named by fingerprints of their sets.

Shingles have one order for all sets, in which those that many documents carry come last. Two sets
that link share SUBSET shingles among the first ``n - ceil(0.8 n) + SUBSET`` of each.

* Light sets (at most ``boundary`` shingles): all subsets of SUBSET shingles of that prefix are
  enumerated, by light sets and by those that can link with a light one.
* Heavy sets: the inverted lists of the first ``n - ceil(0.8 n) + 1`` shingles are scanned. Places in
  the order bound the overlap.
* The boundary is the largest size for which enumerating makes no more rows
  than scanning, from the measured mean list length.

Lists of either kind then go to :func:`common.link_lists`: members of a list first meet a pivot each, what links
is contracted, and members of different components meet where few pairs are left. Lists with many
pairs left are those of texts that vary one text, around the similarity. Their members are written
as differences to a centre (:func:`_around_centres`): the difference of two sets is that of their
differences, so what the texts have in common drops out, and two that link, but not both with the centre, share a stated part of
their differences. They are joined by the rarest of these, again without pairs of a whole group.

Pairs are checked exactly: first a lossless bound on the
symmetric difference from histograms, then the sets themselves.

Defined results: nulls, empty texts and texts without words have an empty set and link with nothing;
a repeated row joins its copy's class; rows of one doc_id with different texts link each by its own
text. A row without doc_id gets its set's size and no component. Shingles are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from . import common
from .shingles import mix, parts, shingle_sets

WIDTH = 5
#: Similarity as a ratio of integers, so that comparisons are exact.
NUM, DEN = 80, 100
#: Shingles in more documents than this are put last in the order.
HEAVY_DF = 64
#: Most shingles that are put last by name; any set of them gives the same result.
HEAVY_ROWS = 1 << 17
#: Share of the hash range whose shingles are counted; prefixes lie at its low end.
COUNTED = 0.25
#: Shingles of an enumerated subset. Sets that link and aren't equal share four or more.
SUBSET = 2
#: Open pairs for each member from which a list goes to :func:`_around_centres`.
DENSE = 16.0
#: A histogram has at most two to this number of cells.
MOST_BITS = 12


def need(a: int, b: int) -> int:
    """Least overlap of sets of sizes a and b that link."""
    return -(-NUM * (a + b) // (DEN + NUM))


def prefix_size(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def partners(n: int) -> range:
    """Sizes that a set of n shingles can link with."""
    return range(-(-NUM * n // DEN), DEN * n // NUM + 1)


def enumerated(n: int, boundary: int) -> bool:
    """Whether a set of n shingles is light or can link with a light one; sets of up to 3 link with equal ones only."""
    return n > 3 and partners(n)[0] <= boundary


def subset_rows(n: int) -> int:
    return comb(prefix_size(n) + SUBSET - 1, SUBSET)


def choose_boundary(mean_list: float) -> int:
    """Largest size up to which enumerating subsets makes no more rows than scanning lists."""
    n = 0
    while subset_rows(n + 1) <= prefix_size(n + 1) * max(1.0, mean_list):
        n += 1
    return n


def fingerprint(s: np.ndarray) -> int:
    return int(s.view(np.uint64).sum().astype(np.uint64).view(np.int64)) if len(s) else 0


def sets(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, f, g, n, cells): a hash of the text, and two fingerprints, the size and the histogram of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in parts(batches):
            f, g, n, cells = [], [], [], []
            for s in shingle_sets(x.column(2), WIDTH):
                m = mix(s.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
                f.append(fingerprint(s))
                g.append(int(m.sum().view(np.int64)) if len(s) else 0)
                n.append(len(s))
                cells.append(histogram(m))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(f, pa.int64()), pa.array(g, pa.int64()), pa.array(n, pa.int64()), pa.array(cells, pa.binary())], ["doc_id", "rid", "f", "g", "n", "cells"])

    text = F.col("text").cast("string")
    return common.in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("rid"), text.alias("text")), run, "doc_id long, rid long, f long, g long, n long, cells binary")


def _counts(docs: DataFrame) -> DataFrame:
    """(token, df) of the shingles in the counted part of the hash range, over all documents."""
    top = np.int64(-(2**63) + int(COUNTED * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in parts(batches):
            found = [s[: np.searchsorted(s, top)] for s in map(np.sort, shingle_sets(x.column(0), WIDTH))]
            tokens, df = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array(df, pa.int64())], ["token", "df"])

    return common.in_arrow(docs.select(F.col("text").cast("string").alias("text")), run, "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))


def _packed(size: int, places: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    return (np.int64(size) << 25) | (places.astype(np.int64) << 1) | heavy


def _unpacked() -> tuple[Column, Column]:
    """size and pos of a list row."""
    return F.shiftright("meta", 25).alias("size"), F.shiftright("meta", 1).bitwiseAND(F.lit((1 << 24) - 1)).alias("pos")


def _lists(docs: DataFrame, heavy: np.ndarray, boundary: int) -> DataFrame:
    """(key, id, meta): the list rows of each document's set, where id is the set's fingerprint.

    meta packs the set's size, the place in its order and a bit for keys that many sets may share (see :func:`_unpacked`). A task
    lists equal sets once.
    """
    far = docs.sparkSession.sparkContext.broadcast(np.sort(heavy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = far.value, set()
        for x in parts(batches):
            out: list[tuple[np.ndarray, ...]] = []
            for s in shingle_sets(x.column(0), WIDTH):
                n, f = len(s), fingerprint(s)
                if not n or (f, n) in seen:
                    continue
                seen.add((f, n))
                s = np.sort(s)
                often = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s if len(last) else np.zeros(n, bool)
                order, marks = np.concatenate([s[~often], s[often]]), np.sort(often)
                if n > boundary:
                    p = prefix_size(n)
                    out.append((order[:p], np.full(p, f), _packed(n, np.arange(p), marks[:p])))
                if enumerated(n, boundary):
                    picks = np.array(list(combinations(range(prefix_size(n) + SUBSET - 1), SUBSET)))
                    k = mix(mix(order.view(np.uint64))[picks].sum(axis=1)).view(np.int64)
                    # if these are the first that two sets share, at most what follows the last of them is shared besides
                    out.append((k, np.full(len(k), f), _packed(n, picks[:, -1] - (SUBSET - 1), marks[picks].all(axis=1))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["key", "id", "meta"])

    return common.in_arrow(docs.select(F.col("text").cast("string").alias("text")), run, "key long, id long, meta long")


def _arrays(docs: DataFrame) -> DataFrame:
    """(v, tokens): fingerprint and shingles of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in parts(batches):
            got = list(shingle_sets(x.column(0), WIDTH))
            at = np.cumsum([0, *map(len, got)]).astype(np.int32)
            values = pa.array(np.concatenate(got) if got else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(map(fingerprint, got), pa.int64()), pa.ListArray.from_arrays(pa.array(at), values)], ["v", "tokens"])

    return common.in_arrow(docs.select("text"), run, "v long, tokens array<long>")


def histogram(mixed: np.ndarray) -> bytes:
    """Counts of a set's mixed hashes by their first bits: about a cell or two for two of them, a byte each, held at 255.

    The number of cells is a power of two, so a finer histogram folds to a coarser one. Cells
    that are held back are left out of a comparison.
    """
    bits = min(max(4, (len(mixed) // 2).bit_length()), MOST_BITS)
    return np.minimum(np.bincount((mixed >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


@F.arrow_udf(BooleanType())
def _cells_allow(a: pa.Array, b: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
    """Whether the histograms leave room for enough overlap: the sets differ at least as much as their cells."""
    la, lb = (np.array([len(v) for v in x.to_pylist()], np.int64) for x in (a, b))
    out = np.zeros(len(a), bool)
    room = (DEN - NUM) * (n.to_numpy(zero_copy_only=False) + m.to_numpy(zero_copy_only=False))
    for x, y in {*zip(la.tolist(), lb.tolist())}:
        at = np.flatnonzero((la == x) & (lb == y))
        k = min(x, y)
        # a count that is held at 255 may be higher: it allows any difference upwards
        p, q = (np.frombuffer(b"".join(v.take(pa.array(at)).to_pylist()), np.uint8).astype(np.int64).reshape(len(at), k, -1) for v in (a, b))
        held = (p == 255).any(axis=2) | (q == 255).any(axis=2)
        apart = np.where(held, 0, np.abs(p.sum(axis=2) - q.sum(axis=2))).sum(axis=1)
        out[at] = (DEN + NUM) * apart <= room[at]
    return pa.array(out)


def may_match() -> Column:
    """Whether sizes allow a link and a shared shingle at these places can be the pair's first one: enough must follow it."""
    least = F.floor((NUM * (F.col("sa") + F.col("sb")) + DEN + NUM - 1) / (DEN + NUM))
    return (F.least("sa", "sb") * DEN >= F.greatest("sa", "sb") * NUM) & (F.col("sa") - F.col("pa") >= least) & (F.col("sb") - F.col("pb") >= least)


def linked(apart: str, sizes: str) -> str:
    """Whether sets with ``apart`` shingles in one of them only and ``sizes`` shingles in all link."""
    return f"{DEN + NUM} * {apart} <= {DEN - NUM} * ({sizes})"


def _around_centres(lists: DataFrame, labels: DataFrame, links: DataFrame, sets_of, verify) -> DataFrame:
    """(a, b): links that connect the members of each of ``lists`` as all links among them do.

    The centre of a list is the best linked set of the component that most of its members belong to; the
    members of all lists with one centre are looked at together. d is the number of shingles that a set
    and the centre don't share. Sets a and b have at most da + db apart, and if that is
    near enough for a link, each of them links with the centre, too. Otherwise
    they share at least half of what da + db is beyond that. So a set that doesn't link with the centre is sought
    by all but that share of its differences, one that does by about half of them, the rarest in the group first.

    Sets that differ from the centre by more than their size share only some passage with it. They link with none whose
    difference is at most three fifths of its size, and meet the others that are in a list with them.
    """
    often = lists.groupBy("key", "label").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "label")).alias("x")).select("key", F.col("x.label").alias("label"))
    degree = links.select(F.col("a").alias("v")).union(links.select(F.col("b").alias("v"))).groupBy("v").agg(F.count("*").alias("m"))
    best = degree.join(labels, "v").groupBy("label").agg(F.max(F.struct("m", "v")).alias("x")).select("label", F.col("x.v").alias("best"))
    centred = common.cut(lists.drop("left", "n").join(often.join(best, "label", "left").select("key", F.coalesce("best", "label").alias("centre")), "key"), "centred")
    members = common.cut(centred.select("centre", "id", "size", "label").distinct(), "members")
    tokens = sets_of(members.select("id").union(members.select("centre")))
    # while they are small, members and centres go to where the sets are, so that these aren't shuffled
    central = common.cut(tokens.join(common.small(members.select(F.col("centre").alias("v")).distinct()), "v", "left_semi").select(F.col("v").alias("centre"), F.col("tokens").alias("c")), "centres")
    both = tokens.select(F.col("v").alias("id"), F.col("tokens").alias("t")).join(common.small(members), "id").join(common.small(central), "centre")
    both = both.withColumn("csize", F.size("c")).withColumn("d", F.col("size") + F.col("csize") - 2 * F.size(F.array_intersect("t", "c"))).withColumn("close", F.col("d") <= F.col("size"))
    apart = F.when(F.col("close"), F.concat(F.array_except("t", "c"), F.array_except("c", "t"))).alias("apart")
    both = common.cut(both.select("centre", "id", "size", "label", "csize", "d", "close", F.expr(linked("d", "size + csize")).alias("near"), apart), "apart")
    common.discard(tokens, central, members)

    half = f"floor(({DEN + NUM} * d + {DEN - NUM} * (csize - size)) / {2 * (DEN + NUM)}) + 1"
    shared = F.expr(f"greatest(1, if(near, {half}, d - floor(size * {DEN - NUM} / {NUM})))")
    rows = both.where("close").withColumn("shared", shared.cast("int")).where("d >= shared")
    each = rows.select("centre", "id", F.explode("apart").alias("token"))
    df = common.cut(each.groupBy("centre", "token").agg(F.count("*").alias("df")).where("df > 1"), "apart-df")
    order = each.join(common.small(df), ["centre", "token"], "left").groupBy("centre", "id").agg(F.array_sort(F.collect_set(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "token"))).alias("x"))
    prefix = rows.drop("apart").join(order, ["centre", "id"]).select("centre", "id", "size", "label", "d", "near", F.posexplode(F.expr("slice(x, 1, d - shared + 1)")).alias("pos", "x")).where("x.df > 1")
    prefix = common.cut(prefix.select(F.xxhash64("centre", "x.token").alias("key"), "id", "size", "label", "d", "near", "pos"), "apart-lists")
    left, right = (prefix.select("key", *(F.col(c).alias(c + x) for c in ("id", "size", "label", "d", "near", "pos"))) for x in "ab")
    enough = f"greatest(1, ceil(({DEN + NUM} * (da + db) - {DEN - NUM} * (sizea + sizeb)) / {2 * (DEN + NUM)})) <= least(da - posa, db - posb)"
    pairs = left.join(right, "key").where(f"ida < idb and labela <> labelb and not (neara and nearb) and {enough} and least(sizea, sizeb) * {DEN} >= greatest(sizea, sizeb) * {NUM}")
    pairs = pairs.select(F.col("ida").alias("a"), F.col("sizea").alias("sa"), F.col("idb").alias("b"), F.col("sizeb").alias("sb"))
    # of the others at least one is far from the centre
    far = centred.drop("anchor").join(both.where("5 * d > 3 * size").select("centre", "id", (~F.col("close")).alias("anchor")).distinct(), ["centre", "id"])
    found = verify(pairs.union(common.cross_pairs(far, may_match())).distinct())
    return found.union(both.where("near and id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b")))


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``; see the module's text."""
    return _solve(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _solve(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, n, component_id) for each row of ``docs``."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    each = common.cut(sets(docs), "sets")
    keyed = each.where("n > 0 and doc_id is not null")
    classes = common.cut(keyed.groupBy("f", "g", "n").agg(F.min("doc_id").alias("rep"), F.first("cells").alias("cells")), "classes")
    known = docs.where("doc_id is not null")
    counts = common.cut(_counts(known).where("df > 1"), "counts")
    heavy = np.array([r[0] for r in counts.where(F.col("df") > HEAVY_DF).orderBy(F.desc("df"), "token").limit(HEAVY_ROWS).select("token").collect()], np.int64)
    shared = counts.where(F.col("df") <= HEAVY_DF).agg(F.sum("df"), F.sum(F.col("df") * F.col("df"))).first()
    boundary = choose_boundary(shared[1] / shared[0] if shared[0] else 1.0)
    # One shuffle for all that follows: the rows of a light list meet, those of a heavy one stay spread out.
    rows = _lists(known, heavy, boundary).withColumn("salt", F.when(F.col("meta") % 2 == 1, F.col("id")).otherwise(F.lit(0)))
    rows = rows.repartition("key", "salt").dropDuplicates(["key", "salt", "id"])
    rows = rows.withColumn("members", F.count("*").over(Window.partitionBy("key", "salt"))).where("meta % 2 = 1 or members > 1")
    lists = common.cut(rows.select("key", "id", *_unpacked(), F.lit(True).alias("anchor")), "lists")

    def sets_of(ids: DataFrame) -> DataFrame:
        """(v, tokens) of the sets that ``ids`` name, from each class's first document; twice if that is there twice."""
        wanted = common.cut(ids.toDF("v").distinct(), "wanted")
        names = common.cut(classes.join(common.small(wanted), classes["f"] == wanted["v"], "left_semi").select("f", "rep"), "named")
        full = docs.join(common.small(names.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi")
        found = common.cut(_arrays(full).join(common.small(wanted), "v", "left_semi"), "tokens")
        common.discard(wanted, names)
        return found

    def verify(pairs: DataFrame) -> DataFrame:
        sketch = common.small(classes.select("f", "cells"), 50_000)
        near = pairs.join(sketch.select(F.col("f").alias("a"), F.col("cells").alias("ca")), "a").join(sketch.select(F.col("f").alias("b"), F.col("cells").alias("cb")), "b")
        near = common.cut(near.where(_cells_allow("ca", "cb", "sa", "sb")).select("a", "b", "sa", "sb"), "near")
        tokens = sets_of(near.select("a").union(near.select("b")))
        both = tokens.select(F.col("v").alias("a"), F.col("tokens").alias("ta")).join(common.small(near), "a").join(tokens.select(F.col("v").alias("b"), F.col("tokens").alias("tb")), "b")
        overlap = F.size(F.array_intersect("ta", "tb"))
        found = common.cut(both.where(overlap * (DEN + NUM) >= (F.size("ta") + F.size("tb")) * NUM).select("a", "b").distinct(), "verified")
        common.discard(near, tokens)
        return found

    common.discard(counts)
    labels, _ = common.link_lists(lists, verify, may_match(), pairs_per_row=DENSE, dense=lambda *x: _around_centres(*x, sets_of, verify))
    # components of sets become components of documents by their least doc_id
    placed = classes.join(labels, classes["f"] == labels["v"], "left").select("f", "g", "n", "rep", F.coalesce("label", "f").alias("label"))
    least = placed.groupBy("label").agg(F.min("rep").alias("component_id"))
    placed = common.cut(placed.join(least, "label").select("f", "g", "n", "component_id"), "components")
    return each.join(placed, ["f", "g", "n"], "left").select("doc_id", "rid", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose component has a smaller doc_id; all columns stay, whatever their names. A row without doc_id stays."""
    d, r = common.fresh(docs, "kept_id", "kept_row")
    gone = _solve(docs).where("component_id < doc_id").select(F.col("doc_id").alias(d), F.col("rid").alias(r)).distinct()
    return docs.join(gone, (docs["doc_id"] == F.col(d)) & (F.xxhash64(docs["text"].cast("string")) == F.col(r)), "left_anti")
