"""Versions of tables that are published together, and accumulation over a state that is one."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from crashloom.operators import incremental
from crashloom.operators.graph import cut
from crashloom.sources import snapshots
from crashloom.streaming import accumulate


def numbers(spark, *n):
    return spark.createDataFrame([(i, i % 3) for i in n], "a int, part int")


def rows(df):
    return sorted(r.a for r in df.collect())


def data(path):
    return sorted(d for d in os.listdir(path) if d.startswith("data-"))


def test_versions(spark, tmp_path):
    path = str(tmp_path / "s")
    assert snapshots.versions(spark, path) == [] and snapshots.manifest(spark, path) is None
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, path, "x")
    one = snapshots.publish(path, 1, {"x": numbers(spark, 1, 2), "y": numbers(spark)}, partitions={"x": ["part"]}, facts={"top": 2})
    two = snapshots.publish(path, 2, {"x": numbers(spark, 3), "y": numbers(spark, 9)}, one, {"x": ["part"]})
    assert rows(snapshots.read(spark, path, "x")) == [1, 2, 3] and rows(snapshots.read(spark, path, "y")) == [9]
    assert rows(snapshots.read(spark, path, "x", 1)) == [1, 2] and rows(snapshots.read(spark, path, "y", 1)) == []
    assert one["facts"] == snapshots.manifest(spark, path, 1)["facts"] == {"top": 2} and snapshots.folders(two) == 2
    assert snapshots.read(spark, path, "x").where("part = 0").select("a").collect()[0].a == 3
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(path, 2, {"x": numbers(spark, 7)})
    assert len(data(path)) == 2 and rows(snapshots.read(spark, path, "x")) == [1, 2, 3]
    # what a writer leaves that fails before its manifest isn't read, and can be cleared away
    numbers(spark, 5).write.parquet(f"{path}/data-stray/x")
    assert rows(snapshots.read(spark, path, "x")) == [1, 2, 3] and snapshots.clean(spark, path) == 1
    three = snapshots.publish(path, 3, snapshots.compacted(spark, path, two, {"x": ["part"]}), partitions={"x": ["part"]})
    assert rows(snapshots.read(spark, path, "x")) == [1, 2, 3] and snapshots.folders(three) == 1 and snapshots.versions(spark, path) == [2, 3]
    snapshots.publish(path, 4, {"x": numbers(spark, 4), "y": numbers(spark, 4)})
    assert snapshots.versions(spark, path) == [3, 4] and len(data(path)) == 2


def test_clusters_and_quarantine_are_one_version(spark, tmp_path):
    traced = cut(spark.createDataFrame([("a", None), ("b", None), ("c", "bad"), ("d", None)], "file_path string, parse_error string"), "traced")
    clusters = spark.createDataFrame([("a", 1), ("b", 0), ("d", 2)], "file_path string, cluster int")
    snapshots.publish_clusters(traced, clusters, str(tmp_path / "s"), 1)
    got = {name: sorted(r.file_path for r in snapshots.read(spark, str(tmp_path / "s"), name).collect()) for name in ("clusters", "errors")}
    assert got == {"clusters": ["a", "d"], "errors": ["c"]}


def test_accumulation_reads_what_a_batch_meets(spark, tmp_path):
    """Batches give the clusters of updates with the whole state, and the state stays of few folders."""
    rng = random.Random(4)
    bases = ["abcdefgh", "klmnopqr", "stuvwxyz", "01234567"]
    state, whole = str(tmp_path / "state"), spark.createDataFrame([], "id string, cluster int, keys array<string>, crashline string")
    for number in range(5):
        batch = []
        for i in range(4):
            k = list(rng.choice(bases))
            k[rng.randrange(4, 8)] = rng.choice("ABC")
            batch.append((f"{number}{i}", k, ""))
        new = spark.createDataFrame(batch, "report_id string, keys array<string>, crashline string")
        accumulate.add(new, number, state, buckets=4, most=2)
        fresh = incremental.update(whole, new).where("outcome in ('added', 'moved', 'new')").join(new, "report_id").select(F.col("report_id").alias("id"), "cluster", "keys", "crashline")
        whole = cut(whole.union(fresh), "whole")
        got = snapshots.read(spark, state, "members")
        assert sorted(map(str, got.select("id", "cluster", "keys").collect())) == sorted(map(str, whole.select("id", "cluster", "keys").collect()))
        assert snapshots.folders(snapshots.manifest(spark, state)) <= 2
    before = snapshots.versions(spark, state)
    accumulate.add(new, 4, state, buckets=4, most=2)
    assert snapshots.versions(spark, state) == before, "a batch that is run again is published once"
    found = snapshots.manifest(spark, state)
    one = spark.createDataFrame([("x", list("abcd"), "")], "report_id string, keys array<string>, crashline string")
    met = accumulate.met_members(one, *(snapshots.table(spark, state, found, t) for t in ("members", "index")), 4)
    assert {r.id for r in met.collect()} == {r.id for r in whole.join(whole.where(F.arrays_overlap("keys", F.array(*map(F.lit, "abcd")))).select("cluster").distinct(), "cluster").collect()}
    plan = met._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
