"""URL filters as a sort-merge range join.

A host is keyed by its labels in reverse order, each closed by a mark that sorts below all
characters of a host, so a rule's host and its subdomains are one interval of
keys and the intervals of rules are nested or apart. URLs and the starts of rule
intervals are dealt to key ranges and sorted; one sweep over a sorted range keeps a stack of
the rules whose interval is open. Of these the longest whose path the URL's path starts
with wins; equally long ones are decided by the longer host, then by the text.

An interval that crosses ranges is opened in each of them, so ranges are independent. The
range bounds come from a hashed sample of the keys, which is bounded, and only affect how work is
dealt out; a host that many URLs share is spread by a hash of the row within its key.

Defined results: a null URL and one without ``://`` have empty host and path, which
no rule fits; the verdict without a rule is ``default``. Rules with null parts are
ignored; with repeated rules of different verdicts, block wins.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import ascii_lower, in_arrow

#: URLs in a range, in the mean, the most ranges, and keys that are sampled for each range.
RANGE_ROWS, RANGES, SAMPLED = 50_000, 4096, 40
MARK = "\x01"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by the mark."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), MARK), F.lit(MARK))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict); ``rules``: host, path, verdict."""
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("key", host_key("host")).withColumn("salt", F.xxhash64("page_id", "path"))
    clean = rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").dropna()
    clean = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("key", host_key("host"))
    total = rows.count()
    n = min(RANGES, max(1, -(-total // RANGE_ROWS)))
    keep = F.pmod(F.col("salt"), F.lit(max(1, total // (n * SAMPLED)))) == 0
    drawn = sorted(tuple(r) for r in rows.where(keep).select("key", "salt").limit(4 * n * SAMPLED).collect()) if n > 1 else []
    bounds = [drawn[len(drawn) * i // n] for i in range(1, n)] if drawn else []
    shared = pages.sparkSession.sparkContext.broadcast(bounds)

    @F.pandas_udf(IntegerType())
    def range_of(key: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(shared.value, x) for x in zip(key, salt)], dtype="int32")

    # a host's interval holds the keys that begin with its key: from there to just before the next mark
    low = range_of("key", F.lit(-(2**63)))
    high = range_of(F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("\x02")), F.lit(-(2**63)))
    opened = clean.withColumn("part", F.explode(F.sequence(low, high)))
    no = lambda name, kind: F.lit(None).cast(kind).alias(name)
    kind = rows.schema["page_id"].dataType.simpleString()
    events = rows.select(range_of("key", "salt").alias("part"), "key", F.lit(1).alias("kind"), "page_id", "host", "path", no("verdict", "string"))
    events = events.union(opened.select("part", "key", F.lit(0).alias("kind"), no("page_id", kind), "host", "path", "verdict"))
    swept = events.repartition("part").sortWithinPartitions("part", "key", "kind", "host", "path")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack = None, []  # the open rules: (key, host, path, verdict)
        for x in batches:
            out: list[list] = [[], [], [], [], []]
            ids = []
            cols = [x.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6)]
            for i, (p, key, what, host, path, verdict) in enumerate(zip(*cols)):
                if p != part:
                    part, stack = p, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if what == 0:
                    stack.append((key, host, path, verdict))
                    continue
                best = max(((len(h) + len(q), len(h), h + q, v) for _, h, q, v in stack if path.startswith(q)), default=(0, 0, None, default))
                ids.append(i)
                for c, v in zip(out, (host, path, best[2], best[3])):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([x.column(3).take(pa.array(ids, pa.int64())), *(pa.array(c, pa.string()) for c in out[:4])], ["page_id", "host", "path", "rule", "verdict"])

    return in_arrow(swept, sweep, f"page_id {kind}, host string, path string, rule string, verdict string")
