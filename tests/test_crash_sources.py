"""Readers, writers, SARIF, SQL registration and streaming on small files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from crashloom.operators import sarif, summary
from crashloom.sources import reports, sinks, snapshots
from crashloom.streaming import accumulate

TRACE = ["    #0 0x1 in parse_it /src/a.c:3:1", "    #1 0x2 in run_all /src/m.c:9"]


def folder(tmp_path):
    d = tmp_path / "reports"
    (d / "cl1").mkdir(parents=True)
    good = {"Stacktrace": TRACE, "AsanReport": ["==1==ERROR: AddressSanitizer: SEGV"], "CrashLine": "/src/a.c:3:1", "Unknown": 1, "Registers": {"rip": 18446744073709551615}}
    (d / "1.casrep").write_text(json.dumps(good, indent=1))
    (d / "2.casrep").write_text(json.dumps(good | {"CrashSeverity": {"Type": "EXPLOITABLE", "ShortDescription": "SegFaultOnPc", "Description": "d", "Explanation": "e"}}))
    (d / "3.casrep").write_text(json.dumps({"Stacktrace": ["broken"], "AsanReport": ["x"]}))
    (d / "4.casrep").write_text("{ no json")
    (d / "5.txt").write_text("other")
    (d / "cl1" / "6.casrep").write_text(json.dumps(good))
    return str(d)


def test_reports(spark, tmp_path):
    df = reports.traces(reports.read_reports(spark, folder(tmp_path))).cache()
    got = {r.file_name: r for r in df.collect()}
    assert sorted(got) == ["1.casrep", "2.casrep", "3.casrep", "4.casrep"]
    assert got["1.casrep"].fingerprint == got["2.casrep"].fingerprint and got["1.casrep"].parse_error is None
    assert got["1.casrep"].CrashSeverity.ShortDescription == "Undefined" and int(got["1.casrep"].Registers["rip"]) == 2**64 - 1
    assert got["3.casrep"].parse_error and got["4.casrep"].parse_error == "not a report"
    assert got["1.casrep"].ProcEnviron == [] and got["1.casrep"].OS == ""
    sinks.write_split(df.select("file_name", "parse_error"), str(tmp_path / "good"), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "good")).count() == 2
    assert summary.corrupted(df).first().corrupted == 1


def test_clusters_and_ignore_list(spark, tmp_path):
    found = reports.read_clusters(spark, folder(tmp_path)).select("file_name", "cluster").collect()
    assert [tuple(r) for r in found] == [("6.casrep", 1)]
    (tmp_path / "ignore").write_text("FILES\n^/usr\nFUNCTIONS\n^my_\n")
    got = {tuple(r) for r in reports.read_ignore_list(spark, str(tmp_path / "ignore")).collect()}
    assert ("file", "^/usr") in got and ("function", "^my_") in got


def test_sarif(spark, tmp_path):
    df = reports.traces(reports.read_reports(spark, folder(tmp_path))).where("parse_error is null").withColumn("path", F.col("file_name")).cache()
    lines = sarif.document_lines(df, "tool", "/src").orderBy("part", "nth").collect()
    doc = json.loads("".join(r.text for r in lines))
    run = doc["runs"][0]
    assert {r["id"] for r in run["tool"]["driver"]["rules"]} == {"F00", "F23"}
    assert len(run["results"]) == 2
    place = run["results"][0]["locations"][0]["physicalLocation"]
    assert place["artifactLocation"]["uri"] == "a.c" and place["region"] == {"startLine": 3, "startColumn": 1}
    assert [f["location"]["message"]["text"] for f in run["results"][0]["stacks"][0]["frames"]] == ["#0 parse_it", "#1 run_all"]


def test_sql(spark):
    from crashloom import sql

    sql.register(spark)
    assert spark.sql("SELECT count(*) AS n FROM severity_catalog").first().n == 75
    row = spark.sql("SELECT crash_similarity(array('a', 'b'), array('a', 'b')) AS s, crash_similarity(array('a'), array('c')) AS z, crash_line_without_column('/a.c:1:2') AS l, crash_ubsan_key('/a.c:1:2') AS u, crash_stem('x.gdb.casrep') AS t, crash_near_null(5) AS n, length(crash_fingerprint(array('a'))) AS f").first()
    assert (row.s, row.z, row.l, row.u, row.t, row.n, row.f) == (1.0, 0.0, "/a.c:1", "/a.c:1", "x", True, 64)
    log = "a.c:1:2: runtime error: x\nSUMMARY: UndefinedBehaviorSanitizer: y\nnoise\nb.c:1:2: runtime error: x\nSUMMARY: UndefinedBehaviorSanitizer: y"
    assert spark.createDataFrame([(log,)], "t string").createOrReplaceTempView("logs") is None
    assert spark.sql("SELECT w.nth FROM logs, LATERAL crash_ubsan_warnings(t) w").count() == 2
    assert [tuple(r) for r in spark.sql("SELECT w.nth, w.warning, crash_ubsan_count(t) AS n FROM logs, LATERAL crash_ubsan_warnings(t) w ORDER BY 1").collect()] == [(0, log.split("\nnoise")[0], 2), (1, log.split("noise\n")[1], 2)]
    assert [r.frame for r in spark.sql("SELECT frame FROM crash_frames(array('f', 'g')) ORDER BY nth").collect()] == ["f", "g"]
    assert "Python" not in spark.sql("SELECT w.nth FROM logs, LATERAL crash_ubsan_warnings(t) w")._jdf.queryExecution().toString()


def test_report_views(spark, tmp_path):
    from crashloom import sql

    sql.register(spark)
    sql.report_views(spark, folder(tmp_path), "crashes")
    rows = spark.sql("SELECT crash_line, count(*) AS n, max(crash_similarity(keys, keys)) AS s FROM crashes WHERE parse_error IS NULL GROUP BY 1").collect()
    assert [tuple(r) for r in rows] == [("/src/a.c:3:1", 2, 1.0)]
    frames = spark.sql("SELECT nth, function, file, line FROM crashes_frames WHERE file_path LIKE '%1.casrep' ORDER BY nth").collect()
    assert [tuple(r) for r in frames] == [(0, "parse_it", "/src/a.c", 3), (1, "run_all", "/src/m.c", 9)]


def test_streams(spark, tmp_path):
    schema = "report_id string, keys array<string>, crashline string"
    spark.createDataFrame([("a", list("xyz"), "f:1"), ("b", list("xyw"), "f:2"), ("c", list("mno"), "g:1")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    state = str(tmp_path / "state")
    accumulate.accumulate(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), state, str(tmp_path / "ck")).awaitTermination(120)
    got = snapshots.read(spark, state, "members")
    assert got.count() == 3 and got.select("cluster").distinct().count() >= 2
    events = "ts timestamp, fingerprint string, class string"
    rows = [("2024-01-01 00:00:00", "p", "A"), ("2024-01-01 00:10:00", "p", "B"), ("2024-01-01 05:00:00", "q", "A")]
    spark.createDataFrame(rows, "t string, fingerprint string, class string").select(F.col("t").cast("timestamp").alias("ts"), "fingerprint", "class").coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events).parquet(str(tmp_path / "ev"))
    q = accumulate.deduplicated(stream).writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("firsts").count() == 2
