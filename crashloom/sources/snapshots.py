"""Tables published together as numbered versions over plain files.

Publication has two phases. The tables are written to folders of their own, which no reader knows yet; then a manifest that names them is renamed to its
version's number. A rename to a name that exists fails, so of two writers of a version one wins and the other gets an error, and
readers see all tables of a version or none. Tables can be written as what is added to those of the version before: a manifest
lists every folder that makes up a table, and :func:`compacted` folds them into one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another writer has published the version."""


def _files(spark: SparkSession, path: str):
    """The file system of a path, and its class of paths."""
    kind = spark._jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark._jsc.hadoopConfiguration()), kind


def versions(spark: SparkSession, path: str) -> list[int]:
    """The published versions, in order."""
    fs, kind = _files(spark, path)
    top = kind(f"{path}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The manifest of a version or of the last one; None if there is none. It has ``version``, ``tables`` (folders and schema by name) and ``facts``."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        return None
    return json.loads(spark.read.text(f"{path}/manifests/{known[-1] if version is None else version}.json", wholetext=True).first()[0])


def read(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """A table of a version or of the last one."""
    found = manifest(spark, path, version)
    if found is None:
        raise FileNotFoundError(f"no version in {path}")
    return table(spark, path, found, name)


def table(spark: SparkSession, path: str, found: dict, name: str) -> DataFrame:
    """A table of a manifest; partition columns come from its folders."""
    t = found["tables"][name]
    schema = StructType.fromJson(t["schema"])
    if not t["folders"]:
        return spark.createDataFrame([], schema)
    parts = [spark.read.schema(schema).parquet(f"{path}/{f}") for f in t["folders"]]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def publish(path: str, version: int, tables: Mapping[str, DataFrame], adds_to: dict | None = None, partitions: Mapping[str, Sequence[str]] | None = None, facts: Mapping[str, object] | None = None, keep: int = 2) -> dict:
    """Write ``tables`` and publish them as a version; with ``adds_to``, the manifest of an earlier one, they add to its tables. Earlier versions than the last ``keep`` go, with what only they are made of.

    Publishing a version that exists is a :class:`Conflict`; what was written for it goes.
    """
    spark = next(iter(tables.values())).sparkSession
    fs, kind = _files(spark, path)
    folder = f"data-{uuid.uuid4().hex}"
    listed = {}
    for name, df in tables.items():
        writer = df.write.partitionBy(*(partitions or {}).get(name, ()))
        writer.parquet(f"{path}/{folder}/{name}")
        before = adds_to["tables"][name]["folders"] if adds_to else []
        listed[name] = {"folders": [*before, f"{folder}/{name}"], "schema": json.loads(df.schema.json())}
    made = {"version": version, "tables": listed, "facts": dict(facts or {})}
    target, staged = kind(f"{path}/manifests/{version}.json"), kind(f"{path}/manifests/_{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    out.write(bytearray(json.dumps(made).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(staged, target):
        fs.delete(staged, False)
        fs.delete(kind(f"{path}/{folder}"), True)
        raise Conflict(f"version {version} of {path} exists")
    known = versions(spark, path)
    kept = {f for v in known[-keep:] for f in _named(spark, path, v)}
    for old in known[:-keep]:
        gone = _named(spark, path, old) - kept
        fs.delete(kind(f"{path}/manifests/{old}.json"), False)
        for f in gone:
            fs.delete(kind(f"{path}/{f}"), True)
    return made


def _named(spark: SparkSession, path: str, version: int) -> set[str]:
    """The folders of data that a version's tables are in."""
    return {f.split("/")[0] for t in manifest(spark, path, version)["tables"].values() for f in t["folders"]}


def folders(found: dict) -> int:
    """The most folders that a table of a manifest is made of."""
    return max((len(t["folders"]) for t in found["tables"].values()), default=0)


def compacted(spark: SparkSession, path: str, found: dict, partitions: Mapping[str, Sequence[str]] | None = None) -> dict[str, DataFrame]:
    """The tables of a manifest, to be published whole; each one's rows are dealt by its partition columns, so a folder gets few files."""
    out = {}
    for name in found["tables"]:
        by = (partitions or {}).get(name, ())
        t = table(spark, path, found, name)
        out[name] = t.repartition(*by) if by else t
    return out


def clean(spark: SparkSession, path: str) -> int:
    """Delete folders that no manifest names, such as those of failed writes; how many there were. No writer may be at work."""
    fs, kind = _files(spark, path)
    named = {f for v in versions(spark, path) for f in _named(spark, path, v)}
    stray = [s.getPath() for s in fs.listStatus(kind(path)) if s.getPath().getName().startswith("data-") and s.getPath().getName() not in named]
    for p in stray:
        fs.delete(p, True)
    return len(stray)


def publish_clusters(traced: DataFrame, clusters: DataFrame, path: str, version: int) -> dict:
    """Clusters and quarantined reports as one version: ``clusters`` (file_path, cluster) of the reports without an error, 0 for repeats.

    ``traced`` should be a table: it is read for each of the two.
    """
    good = traced.where("parse_error is null").join(clusters, "file_path").where("cluster > 0")
    return publish(path, version, {"clusters": good, "errors": traced.where("parse_error is not null")}, partitions={"clusters": ["cluster"]})
