"""Best-fit packing by minimum bin slack.

Documents become token ids with an end token. A document of n tokens is cut, if it is
longer than a sequence, into a first piece of ``n mod L`` tokens and whole pieces of L.
Bins are then filled one pattern at a time: the longest piece left is fixed, and subset sums
of the lengths that are still available, as bits of one integer, find the fullest feasible
combination with it; it is removed, as many times as the remaining counts allow.

Only the number of pieces of each length (at most L counts) reaches the driver, so the plan
doesn't grow with the data. Pieces learn their rank within their length from counts over
(bucket, length), so a length that most pieces have is not gathered in one task;
the rank then names pattern, repetition and place.

Defined results: a null or empty text is the end token alone. Repeated rows are packed
as often as they occur.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .token_counts import load, shared_bpe

#: Rows of one length that one task ranks, in the mean.
RANKED = 20_000


def pieces(docs: DataFrame, path: str, limit: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for each piece of each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared_bpe(shared.value, frozenset())
        for x in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(x.column(1).to_pylist()):
                ids = bpe.encode(text) + end
                n = len(ids) // 4
                cuts = [0, *range(n % limit or limit, n + 1, limit)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(row, pa.int64())), *(pa.array(v, t) for v, t in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64())))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("_text"))
    return common.in_arrow(rows, run, f"doc_id {rows.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], limit: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to ``limit``; it uses long ones first.

    reach[k] has bit s set if lengths before the k-th, longest first, can sum to s.
    """
    mask = (1 << (limit + 1)) - 1
    sizes = sorted((s for s, n in counts.items() if n > 0 and s <= limit), reverse=True)
    reach = [1]
    for s in sizes:
        now, left, step = reach[-1], min(counts[s], limit // s), 1
        while left:  # copies in powers of two
            k = min(step, left)
            now |= now << (k * s) & mask
            left -= k
            step *= 2
        reach.append(now)
        if now >> limit & 1:
            break
    total, out = reach[-1].bit_length() - 1, {}
    for k in range(len(reach) - 2, -1, -1):
        n = 0
        while not reach[k] >> total & 1:
            total -= sizes[k]
            n += 1
        if n:
            out[sizes[k]] = n
    return out


def plan(counts: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, copies, times, first sequence, offset) of each length in each pattern."""
    left, rank, out, seq = dict(counts), dict.fromkeys(counts, 0), [], 0
    while any(left.values()):
        # each bin takes the longest piece that is left, so long ones don't remain for the end
        longest = max(s for s, n in left.items() if n)
        pattern = fullest(left | {longest: left[longest] - 1}, limit - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[s] // n for s, n in pattern.items())
        offset = 0
        for s, n in sorted(pattern.items(), reverse=True):
            out.append((s, rank[s], n, times, seq, offset))
            offset += s * n
            rank[s] += n * times
            left[s] -= n * times
        seq += times
    return out


def pack(docs: DataFrame, path: str, limit: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece."""
    spark = docs.sparkSession
    rows = common.cut(pieces(docs, path, limit, end_id), "pieces")
    total = rows.count()
    buckets = max(1, -(-total // RANKED))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)))
    sums = rows.groupBy("length", "_b").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    sums = common.cut(sums.withColumn("before", F.coalesce(before, F.lit(0))), "ranks")
    counts = {r[0]: r[1] for r in sums.groupBy("length").agg(F.sum("n")).collect()}
    # as an Arrow table, as rows of a list would start further Python workers on each executor
    planned = np.array(plan(counts, limit), np.int64).reshape(-1, 6)
    patterns = spark.createDataFrame(pa.table({c: planned[:, i] for i, c in enumerate(("length", "low", "copies", "times", "seq", "base"))}))
    local = F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = rows.withColumn("_i", local).join(common.small(sums.select("length", "_b", "before")), ["length", "_b"]).withColumn("_r", F.col("before") + F.col("_i") - 1)
    # at most a row for each length and pattern: its size is bounded by the sequence length, not by the data
    placed = ranked.join(F.broadcast(patterns), "length").where("_r >= low and _r < low + copies * times")
    i = F.col("_r") - F.col("low")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("seq") + F.floor(i / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("base") + F.pmod(i, F.col("copies")) * F.col("length")).cast("long").alias("offset"),
    )
