"""Lineage cuts and connected components for the crash operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Whether shuffle files go when the query that made them ends, instead of when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a table in the shared checkpoint folder and read back.

    A lost executor then costs a re-read, and loops keep short plans. The shuffle files of the write go at its end,
    as nothing but the table is read after it. Only a local session may name no folder, and gets a temporary one.
    """
    spark = df.sparkSession
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where.rstrip('/')}/crashloom-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back.cut_path = path
    return back


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of :func:`cut` that nothing reads any more."""
    for df in tables:
        path = None if df is None else df.__dict__.get("cut_path")
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def roots(parents: DataFrame) -> DataFrame:
    """(v, root) for (v, parent) of a forest without its roots; paths halve in each round."""
    now = cut(parents.select("v", F.col("parent").alias("root")), "parents")
    while True:
        up = now.select(F.col("v").alias("root"), F.col("root").alias("next"))
        last, now = now, cut(now.join(up, "root", "left").select("v", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "parents")
        discard(last)
        if now.where("moved").limit(1).count() == 0:
            return now.select("v", "root")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(v, label) of each vertex, label being the smallest vertex of its component.

    Each round every vertex takes the least label around it and then the label of that
    label, so paths halve; neighbour labels are pre-aggregated before the shuffle.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    e = cut(e.union(e.select("y", "x")).distinct(), "edges")
    last = labels = cut(e.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("v"), F.least("x", "m").alias("label")), "labels")
    while True:
        around = e.join(labels.select(F.col("v").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("m"))
        low = labels.join(around.withColumnRenamed("x", "v"), "v").select("v", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jumped = low.join(labels.select(F.col("v").alias("label"), F.col("label").alias("next")), "label", "left")
        step = cut(jumped.select("v", "old", F.least("label", "next").alias("label")), "labels")
        discard(last)
        last = step
        if step.where("label <> old").limit(1).count() == 0:
            discard(e)
            return step.select("v", "label")
        labels = step.select("v", "label")
