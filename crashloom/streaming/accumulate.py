"""Reports that keep arriving, as Structured Streaming over files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import cut
from ..operators.incremental import update
from ..sources import snapshots

MEMBERS = "id string, cluster int, keys array<string>, crashline string, bucket int"
#: Buckets of frames and of clusters, and folders that a table of the state is made of at most.
BUCKETS, MOST = 64, 8


def deduplicated(traces: DataFrame, within: str = "7 days") -> DataFrame:
    """A stream of traces (ts, fingerprint, ...) without repeats that come within a time of the first; state is dropped after it."""
    return traces.withWatermark("ts", within).dropDuplicatesWithinWatermark(["fingerprint"])


def class_counts(stream: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of classes (ts, class) in windows of time; rows later than ``late`` are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "class").agg(F.count("*").alias("reports")).select(F.col("w.start").alias("start"), "class", "reports")


def accumulate(stream: DataFrame, state: str, checkpoint: str, unique_lines: bool = False, buckets: int = BUCKETS, most: int = MOST) -> StreamingQuery:
    """Each micro-batch (report_id, keys, crashline) is added to the clusters kept under ``state``.

    The state is a folder of :mod:`..sources.snapshots`: version n holds what batches before n have left. It has the members by buckets of their
    clusters, and an index of which clusters hold a frame, by buckets of frames. A batch reads the buckets of its frames and then those of the clusters that
    hold any of them; others are at distance 1 from its reports. Once a table is made of ``most`` folders, it is folded into one. A
    batch that is run again starts from the same version and finds its own already published.

    With ``unique_lines``, clusters that have come nearer to each other than the threshold because repeats of crash lines were left out, and
    that share no frame with a batch, take no part in its linkage.
    """
    return stream.writeStream.foreachBatch(lambda batch, number: add(batch, number, state, unique_lines, buckets, most)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _bucket(c: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int").alias("bucket")


def _of_buckets(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the buckets in ``wanted``: their numbers, at most as many as there are buckets, prune what is read."""
    numbers = [r.bucket for r in wanted.select("bucket").distinct().collect()]
    return df.where(F.col("bucket").isin(numbers)) if numbers else df.limit(0)


def met_members(batch: DataFrame, members: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """The members of clusters that hold a frame of the batch."""
    frames = cut(batch.select(F.explode(F.array_distinct("keys")).alias("frame")).distinct().select("frame", _bucket(F.col("frame"), buckets)), "batch-frames")
    clusters = cut(_of_buckets(index, frames).join(frames.select("frame"), "frame", "left_semi").select("cluster").distinct().select("cluster", _bucket(F.col("cluster"), buckets)), "batch-clusters")
    return _of_buckets(members, clusters).join(clusters.select("cluster"), "cluster", "left_semi").select("id", "cluster", "keys", "crashline")


def add(batch: DataFrame, number: int, state: str, unique_lines: bool = False, buckets: int = BUCKETS, most: int = MOST) -> None:
    """Publish the state after batch ``number`` as version ``number`` + 1."""
    spark = batch.sparkSession
    if snapshots.manifest(spark, state, number + 1) is not None:
        return
    earlier = [v for v in snapshots.versions(spark, state) if v <= number]
    found = snapshots.manifest(spark, state, earlier[-1]) if earlier else None
    if found is None:
        members, top = spark.createDataFrame([], MEMBERS), 0
    else:
        members = met_members(batch, *(snapshots.table(spark, state, found, t) for t in ("members", "index")), buckets)
        top = found["facts"]["top"]
    out = cut(update(members, batch, unique_lines, top), "outcomes")
    fresh = out.where("outcome in ('added', 'moved', 'new')").join(batch.withColumn("report_id", F.col("report_id").cast("string")), "report_id")
    fresh = cut(fresh.select(F.col("report_id").alias("id"), "cluster", "keys", "crashline", _bucket(F.col("cluster"), buckets)), "fresh-members")
    index = fresh.select("cluster", F.explode(F.array_distinct("keys")).alias("frame")).distinct().select("frame", "cluster", _bucket(F.col("frame"), buckets))
    tables = {"members": fresh, "index": index}
    facts = {"top": max(top, fresh.agg(F.coalesce(F.max("cluster"), F.lit(0))).first()[0])}
    by = {"members": ["bucket"], "index": ["bucket"]}
    if found is not None and snapshots.folders(found) >= most:
        old = snapshots.compacted(spark, state, found, by)
        tables, found = {"members": old["members"].unionByName(fresh), "index": old["index"].unionByName(index).distinct()}, None
        tables = {name: t.repartition("bucket") for name, t in tables.items()}
    snapshots.publish(state, number + 1, tables, found, by, facts)
