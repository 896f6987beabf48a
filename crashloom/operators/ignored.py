"""Frames of runtimes, judged once for each distinct name instead of once for each frame.

Most of the lists' expressions are literal heads (``^name``) or whole names (``^name$``). Those are looked up by an equi-join with the beginnings of
distinct names, of the few lengths that heads have; only names that none of them settles are tried with the other expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.frames import to_entry
from .dedup import free_names
from .graph import cut

_LITERAL = re.compile(r"(?:[^\\^$.|?*+()\[\]{}]|\\[^A-Za-z0-9])+")
_CHOICE = re.compile(r"\(([^()|]*)\|([^()|]*)\)(.*)", re.S)


def sorted_out(patterns: Iterable[str]) -> tuple[list[str], list[str], list[str]]:
    """Literal heads, whole names, and the other expressions of a list. A choice at the head of an expression makes two heads."""
    heads, names, others = set(), set(), []
    for pattern in patterns:
        body = pattern[1:] if pattern.startswith("^") else ""
        choice = _CHOICE.fullmatch(body)
        bodies = [choice[1] + choice[3], choice[2] + choice[3]] if choice else [body]
        whole = all(b.endswith("$") and not b.endswith("\\$") for b in bodies)
        bare = [b[:-1] if whole else b for b in bodies]
        if body and all(_LITERAL.fullmatch(b) for b in bare):
            (names if whole else heads).update(re.sub(r"\\(.)", r"\1", b) for b in bare)
        else:
            others.append(pattern)
    return sorted(heads), sorted(names), others


def matched(names: DataFrame, patterns: Iterable[str]) -> DataFrame:
    """(name): which of the distinct ``names`` (name) an expression finds something in. An empty name has nothing to find."""
    heads, whole, others = sorted_out(patterns)
    n = names.where("name <> ''").select("name").distinct()
    spark = names.sparkSession
    given = lambda values: F.broadcast(spark.createDataFrame([(v,) for v in values], "x string"))  # noqa: E731  a list from the caller, a few hundred
    starts = F.array(*(F.lit(k) for k in sorted({len(h) for h in heads})))
    begun = n.select("name", F.explode(F.transform(F.filter(starts, lambda k: k <= F.length("name")), lambda k: F.substring(F.col("name"), F.lit(1), k))).alias("x")) if heads else n.select("name", F.lit("").alias("x")).limit(0)
    found = begun.join(given(heads), "x", "left_semi").select("name").union(n.select("name", F.col("name").alias("x")).join(given(whole), "x", "left_semi").select("name")).distinct()
    if not others:
        return found
    alternation = "|".join(f"({x})" for x in others)
    return found.union(n.join(found, "name", "left_anti").where(F.col("name").rlike(alternation)))


def listed(kind: dict[str, list[str]], langs: Sequence[str], more: Sequence[str] = ()) -> list[str]:
    """The expressions of languages and a user's; a language without a list has one for single characters."""
    return [x for lang in langs for x in kind.get(lang, ["^[^.]$"])] + list(more) or ["^[^.]$"]


def without_ignored(df: DataFrame, frames: str = "frames", langs: Sequence[str] = fixed.CLUSTER_LANGS, functions: Sequence[str] = (), files: Sequence[str] = (), entry: str = fixed.FUZZ_ENTRY) -> DataFrame:
    """``df`` with its ``frames`` down to the fuzzer's entry point and without those of runtimes, as ``functions.frames.filtered`` has them.

    Frames are joined with the ignored names, which are as many as there are different ones, and put together again in their order;
    a name that most frames have is settled before anything is shuffled by it.
    """
    row, whole = free_names(df, "_row", "_frames")
    rows = cut(df.withColumn(whole, to_entry(F.col(frames), entry)).withColumn(row, F.monotonically_increasing_id()), "framed")
    each = rows.select(row, F.posexplode(whole).alias("_at", "_f"))
    named = lambda *columns: each.select(F.explode(F.array(*columns)).alias("name"))
    bad = matched(named("_f.function"), listed(fixed.IGNORED_FUNCTIONS, langs, functions)).select(F.lit("function").alias("_kind"), F.col("name").alias("_name"))
    bad = bad.union(matched(named("_f.module", "_f.debug.file"), listed(fixed.IGNORED_FILES, langs, files)).select(F.lit("file"), "name"))
    bad = cut(bad, "ignored-names")
    texts = F.array(*(F.struct(F.lit(k).alias("_kind"), F.col(c).alias("_name")) for k, c in (("function", "_f.function"), ("file", "_f.module"), ("file", "_f.debug.file"))))
    gone = each.select(row, "_at", F.inline(texts)).join(bad, ["_kind", "_name"], "left_semi").groupBy(row).agg(F.collect_set("_at").alias("_gone"))
    met = rows.join(gone, row, "left")
    kept = F.filter(F.col(whole), lambda f, i: ~F.array_contains(F.coalesce("_gone", F.expr("cast(array() as array<int>)")), i))
    return met.withColumn(frames, kept).select(*df.columns)
