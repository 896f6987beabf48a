"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

An item's windows are its runs of 13 words; an item with fewer words is one window. A
document is hit where it holds all words of a window in order.

* Rarity: the items' shingles, pairs of neighbouring words, are counted over all
  documents. A document that holds a window holds its rarest shingle, so one prefix
  shingle for each window is enough. Neighbouring windows mostly share it, so an item
  has a few anchors. Single words count as shingles only if an item is a single word.
* Candidates: document shingles join anchors; each match is an alignment (item,
  shift) that passes if some window around the anchor fits within both texts.
* Verification: along each distinct alignment the windows are compared exactly.

Counts, candidates and checks cover whole texts. The tables of anchors and of candidate
alignments are broadcast only while they are small, and shuffled otherwise.

Defined results: a null text has no words and isn't contaminated. Items without id or
words are ignored; repeated items count once. Repeated documents get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 13
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(lowered: Column) -> Column:
    return F.filter(F.split(lowered, SEPARATORS, -1), lambda x: x != "")


def folded(text: Column) -> Column:
    """Lower case that folds each letter by itself: a capital sigma's lower case depends on what is around it."""
    return F.lower(F.replace(text, F.lit("Σ"), F.lit("σ")))


def shingles(ws: str, single: bool) -> Column:
    """Neighbouring words as array<struct<at, token>>; with ``single`` also each word by itself."""
    pairs = f"transform(zip_with(slice({ws}, 1, greatest(size({ws}) - 1, 0)), slice({ws}, 2, greatest(size({ws}) - 1, 0)), (a, b) -> concat(a, ' ', b)), (t, i) -> struct(i as at, t as token))"
    return F.expr(f"concat({pairs}, transform({ws}, (t, i) -> struct(i as at, t as token)))" if single else pairs)


def _windows(benchmark: DataFrame) -> DataFrame:
    items = benchmark.select(F.col("item_id").alias("item"), words(common.ascii_lower(F.col("text").cast("string"))).alias("iw")).where("item is not null and size(iw) > 0").distinct()
    return items.withColumn("w", F.least(F.size("iw"), F.lit(WINDOW))).withColumn("k", F.xxhash64("item", "iw"))


def _anchors(items: DataFrame, counts: DataFrame, single: bool) -> DataFrame:
    """(token, k, at, w, n): each item's windows reduced to their rarest shingle and its place in the item."""
    starts = items.select("k", "iw", "w", F.explode(F.expr("sequence(0, size(iw) - w)")).alias("i")).withColumn("ww", F.transform(F.expr("slice(iw, i + 1, w)"), folded))
    places = starts.select("k", "w", F.size("iw").alias("n"), "i", F.explode(shingles("ww", single)).alias("s")).select("k", "w", "n", "i", "s.at", "s.token")
    rated = places.join(common.small(counts), "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    best = rated.groupBy("k", "w", "n", "i").agg(F.min(F.struct("df", "token", (F.col("i") + F.col("at")).alias("at"))).alias("x"))
    return best.select("x.token", "k", "x.at", "w", "n").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, items, rid): items is the sorted array of the ids as text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("_t"), F.xxhash64(text).alias("rid"))
    items = common.cut(_windows(benchmark), "items")
    single = items.where("w = 1").limit(1).count() > 0
    # folded() folds more than A-Z, letter by letter, so equal words stay equal; exact words are compared below
    each = rows.select("doc_id", "rid", words(folded(F.col("_t"))).alias("ws")).select("doc_id", "rid", F.explode(shingles("ws", single)).alias("s")).select("doc_id", "rid", F.col("s.at").alias("pos"), "s.token")
    own = items.select(F.transform("iw", folded).alias("ws"))
    vocabulary = common.cut(own.select(F.explode(shingles("ws", single)).alias("s")).select("s.token").distinct(), "vocabulary")
    counts = common.cut(each.select("token").join(common.small(vocabulary), "token").groupBy("token").agg(F.count("*").alias("df")), "rarity")
    anchors = common.cut(_anchors(items, counts, single), "anchors")
    found = each.join(common.small(anchors), "token")
    shift = F.col("pos") - F.col("at")
    # the last window start that still covers the anchor must not lie before the text
    candidates = found.withColumn("shift", shift).where("shift + least(at, n - w) >= 0").select("doc_id", "rid", "k", "shift").distinct()
    listed = candidates.join(common.small(items.select("k", "item", "iw", "w")), "k")
    listed = common.cut(listed.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("item", "iw", "w", "shift")).alias("cands")), "candidates")
    hits = _verified(rows, listed)
    counted = rows.select("doc_id", "rid", F.regexp_count(F.lower("_t"), F.lit(WORD)).cast("long").alias("n_words"))
    h = common.small(hits)
    out = counted.join(h, counted["doc_id"].eqNullSafe(h["_d"]) & (counted["rid"] == h["_r"]), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"), "rid")


def _verified(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """(_d, _r, n_hit, items) of the documents in which a window truly occurs."""
    listed = listed.select(F.col("doc_id").alias("_d"), F.col("rid").alias("_r"), "cands")
    near = common.small(listed, 20_000)  # a row holds the item words of a document's candidates
    full = rows.join(near, rows["doc_id"].eqNullSafe(near["_d"]) & (rows["rid"] == near["_r"]))
    # tables in between keep the words and the hits from being worked out again where they are used
    full = common.cut(full.select("_d", "_r", "cands", words(common.ascii_lower(F.col("_t"))).alias("dw")), "candidate-words")
    starts = """transform(cands, c -> struct(c.item as item, c.w as w, filter(transform(sequence(0, size(c.iw) - c.w), i ->
        if(c.shift + i >= 0 and c.shift + i + c.w <= size(dw) and slice(dw, greatest(c.shift + i, 0) + 1, c.w) = slice(c.iw, i + 1, c.w), c.shift + i, -1)), s -> s >= 0) as at))"""
    hit = common.cut(full.select("_d", "_r", F.expr(f"filter({starts}, x -> size(x.at) > 0)").alias("h")), "window-hits").where("size(h) > 0")
    places = "array_distinct(flatten(flatten(transform(h, x -> transform(x.at, s -> sequence(s, s + x.w - 1))))))"
    ids = "array_sort(array_distinct(transform(h, x -> cast(x.item as string))))"
    return common.cut(hit.select("_d", "_r", F.expr(f"size({places})").alias("n_hit"), F.expr(ids).alias("items")).distinct(), "hits")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated documents; all columns stay, whatever their names."""
    d, r = common.fresh(docs, "_bad_id", "_bad_row")
    bad = contamination(docs.select("doc_id", "text"), benchmark).where(contaminated(F.col("n_hit"), F.col("n_words")))
    bad = common.small(common.cut(bad.select(F.col("doc_id").alias(d), F.col("rid").alias(r)).distinct(), "contaminated"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == F.col(r)), "left_anti")
