"""SARIF 2.1.0: rules, results with locations and stacks, and the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import catalog, sarif_severity
from ..functions.text import normal_path, strip_prefix
from .clustering import rank

SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def rule_ids(reports: DataFrame) -> DataFrame:
    """(ShortDescription, rule_id, first): F<place> of known classes, else G0, G1, ... by first appearance in order of ``path``."""
    seen = reports.groupBy(F.col("CrashSeverity.ShortDescription").alias("ShortDescription")).agg(F.min("path").alias("first"))
    known = catalog(reports.sparkSession).groupBy("ShortDescription").agg(F.min("pos").alias("pos"))
    both = seen.join(F.broadcast(known), "ShortDescription", "left")
    others = rank(both.where("pos is null").select("ShortDescription", "first"), ["first", "ShortDescription"], "nth").select("ShortDescription", "nth")
    named = both.join(others, "ShortDescription", "left")
    return named.select("ShortDescription", F.when(F.col("pos").isNotNull(), F.format_string("F%02d", "pos")).otherwise(F.concat(F.lit("G"), F.col("nth") - 1)).alias("rule_id"), "first")


def _location(file: Column, line: Column, column: Column, root: str) -> Column:
    uri = strip_prefix(normal_path(file), root)
    region = F.struct(line.alias("startLine"), F.when(column > 0, column).alias("startColumn"))
    return F.struct(F.struct(F.struct(uri.alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))


def results(reports: DataFrame, root: str = "") -> DataFrame:
    """(path, rule_id, result): ``reports`` need path, CrashSeverity, CrashLine and frames.

    Frames without file or line are left out of the stack, the others keep their numbers.
    """
    ids = rule_ids(reports)
    r = reports.join(ids.select(F.col("ShortDescription").alias("_s"), "rule_id"), F.col("CrashSeverity.ShortDescription") == F.col("_s"))
    p = r"^(.*?)(?::(\d+))?(?::(\d+))?$"
    number = lambda k: F.nullif(F.regexp_extract("CrashLine", p, k), F.lit("")).cast("bigint")
    place = _location(F.regexp_extract("CrashLine", p, 1), F.coalesce(number(2), F.lit(1)), F.coalesce(number(3), F.lit(0)), root)
    known = F.filter(F.transform("frames", lambda f, i: F.struct(f.alias("f"), i.alias("i"))), lambda x: (x["f"]["debug"]["file"] != "") & (x["f"]["debug"]["line"] != 0))
    shown = lambda x: F.struct(
        F.struct(
            _location(x["f"]["debug"]["file"], x["f"]["debug"]["line"], x["f"]["debug"]["column"], root)["physicalLocation"].alias("physicalLocation"),
            F.struct(F.concat(F.lit("#"), x["i"], F.lit(" "), x["f"]["function"]).alias("text")).alias("message"),
        ).alias("location")
    )
    result = F.struct(F.col("rule_id").alias("ruleId"), F.lit("error").alias("level"), F.struct(F.col("CrashSeverity.Description").alias("text")).alias("message"), F.array(place).alias("locations"), F.array(F.struct(F.transform(known, shown).alias("frames"))).alias("stacks"))
    return r.select("path", "rule_id", result.alias("result"))


def rules(reports: DataFrame) -> DataFrame:
    """(rule_id, rule) of the classes that occur."""
    ids = rule_ids(reports)
    one = reports.groupBy(F.col("CrashSeverity.ShortDescription").alias("_s")).agg(F.min(F.struct("path", "CrashSeverity")).alias("x")).select("_s", "x.CrashSeverity")
    s = F.col("CrashSeverity")
    rule = F.struct(F.col("rule_id").alias("id"), s["ShortDescription"].alias("name"), F.struct(s["Description"].alias("text")).alias("shortDescription"), F.struct(s["Explanation"].alias("text")).alias("fullDescription"), F.struct(sarif_severity(s["Type"], s["ShortDescription"]).alias("security-severity")).alias("properties"))
    return one.join(ids, F.col("_s") == F.col("ShortDescription")).select("rule_id", rule.alias("rule"))


def document_lines(reports: DataFrame, tool: str, root: str = "") -> DataFrame:
    """(part, nth, text): the document as lines that are whole when joined in order, so that no task holds all results.

    Part 0 opens the document and holds the rules (a row for each class), part 1 has a line for each result.
    """
    found = rank(results(reports, root).select("path", F.to_json("result").alias("text")), ["path", "text"], "nth")
    listed = rules(reports).agg(F.array_join(F.array_sort(F.collect_list(F.to_json("rule"))), ",").alias("r"))
    head = listed.select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("nth"), F.concat(F.lit('{"$schema":"' + SCHEMA + '","version":"2.1.0","runs":[{"tool":{"driver":{"name":"' + tool + '","rules":['), "r", F.lit(']}},"results":[')).alias("text"))
    body = found.select(F.lit(1).alias("part"), F.col("nth").cast("long"), F.concat(F.when(F.col("nth") > 1, ",").otherwise(""), F.col("text")).alias("text"))
    tail = reports.sparkSession.createDataFrame([(2, 0, "]}]}")], "part int, nth long, text string")
    return head.union(body).union(tail)
