"""Data sources: core dumps larger than memory could hold, one file for each report, one SARIF document; and failed writes."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from crashloom.operators import sarif
from crashloom.sources import datasources, reports
from test_triage import core


def test_cores_by_ranges(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "core.1").write_bytes(core(8, 1, 62, b"/bin/x -a"))
    (tmp_path / "core.2").write_bytes(core(4, 2, 40, b"run"))
    (tmp_path / "core.3").write_bytes(b"junk")
    (tmp_path / "core.4").write_bytes(core(8, 1, 62, b"x", 2))
    (tmp_path / "core.5").write_bytes(core(8, 1, 62, b"x")[:130])
    (tmp_path / "other").write_bytes(core(8, 1, 62, b"x"))
    (tmp_path / "core.empty").write_bytes(b"")
    with open(tmp_path / "core.large", "wb") as f:
        f.write(core(8, 1, 62, b"/bin/large"))
        f.truncate(3 << 30)  # a sparse file beyond what fits a row
    got = {os.path.basename(r.path): r for r in datasources.read_cores(spark, str(tmp_path), "core").collect()}
    assert set(got) == {"core.1", "core.2", "core.3", "core.4", "core.5", "core.empty", "core.large"}
    assert tuple(got["core.1"])[2:] == ("amd64", "little", 8, "/bin/x -a", None) and tuple(got["core.2"])[2:] == ("arm", "big", 4, "run", None)
    assert got["core.large"].size == 3 << 30 and got["core.large"].cmdline == "/bin/large"
    assert got["core.3"].error == got["core.empty"].error == "not an ELF file" and got["core.4"].error == "not a core dump" and got["core.5"].error
    (tmp_path / "none").mkdir()
    assert datasources.read_cores(spark, str(tmp_path / "none")).count() == 0


def crashes(spark, n):
    kind = F.struct(F.lit("EXPLOITABLE").alias("Type"), F.concat(F.lit("kind"), F.col("id") % 3).alias("ShortDescription"), F.lit("d").alias("Description"), F.lit('e "q"').alias("Explanation"))
    return spark.range(n).select(F.format_string("r%03d.casrep", "id").alias("file_name"), kind.alias("CrashSeverity"), F.concat(F.lit("/s/é.c:"), "id").alias("CrashLine"), F.array(F.lit("#0 f")).alias("Stacktrace"))


def test_a_file_for_each_report(spark, tmp_path):
    out = str(tmp_path / "out")
    datasources.write_report_files(crashes(spark, 25).repartition(4), out)
    files = [f for _, _, names in os.walk(out) for f in names if f.endswith(".casrep")]
    assert len(files) == 25 and all(d.startswith("part-") for d in os.listdir(out))
    back = reports.read_reports(spark, out, recursive=True)
    assert {(r.file_name, r.CrashLine, r.CrashSeverity.ShortDescription, tuple(r.Stacktrace), r._corrupt) for r in back.collect()} == {(f"r{i:03}.casrep", f"/s/é.c:{i}", f"kind{i % 3}", ("#0 f",), None) for i in range(25)}
    # more reports stand beside them; a bad name leaves nothing of its write
    datasources.write_report_files(crashes(spark, 1).withColumn("file_name", F.lit("more.casrep")), out)
    bad = crashes(spark, 30).withColumn("file_name", F.when(F.col("file_name") == "r017.casrep", "a/b").otherwise(F.concat(F.lit("x"), "file_name"))).repartition(3)
    with pytest.raises(Exception, match="not a name"):
        datasources.write_report_files(bad, out)
    assert reports.read_reports(spark, out, recursive=True).count() == 26 and all(d.startswith("part-") for d in os.listdir(out))


def test_one_sarif_document(spark, tmp_path):
    r = crashes(spark, 40).withColumn("path", F.col("file_name")).withColumn("frames", F.expr("array(named_struct('function', 'f', 'debug', named_struct('file', '/s/a.c', 'line', 3L, 'column', 0L)))"))
    datasources.write_sarif(sarif.document_lines(r, "tool", "/s").repartition(5), str(tmp_path), "all.sarif")
    document = json.loads((tmp_path / "all.sarif").read_text())
    results = document["runs"][0]["results"]
    assert [x["locations"][0]["physicalLocation"]["region"]["startLine"] for x in results] == list(range(40)) and len(document["runs"][0]["tool"]["driver"]["rules"]) == 3
    assert os.listdir(tmp_path) == ["all.sarif"]
    back = datasources.read_sarif(spark, str(tmp_path)).collect()
    assert len(back) == 40 and {x.rule_id for x in back} == {"G0", "G1", "G2"}
    with pytest.raises(Exception, match="all.sarif"):
        datasources.write_sarif(sarif.document_lines(r, "tool"), str(tmp_path), "all.sarif")
    assert os.listdir(tmp_path) == ["all.sarif"]
