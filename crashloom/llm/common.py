"""Helpers shared by the training-data operators.

Everything here is plain DataFrame code: cutting lineage with tables in the
shared checkpoint folder, size-checked broadcasts, and connected components.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

#: Rows and bytes that a side may have to be broadcast; beyond them the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 24 << 20
#: Bytes of an Arrow batch that a worker gets at a time; a row of more comes alone.
ARROW_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only a local session may have none, and gets a temporary one."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back.

    What follows no longer depends on how ``df`` was made, so a lost executor
    costs a re-read and not a recomputation, and loops keep short plans.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/crashloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.cut_path = path
    return back


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of :func:`cut` that nothing reads any more."""
    for df in tables:
        path = None if df is None else df.__dict__.get("cut_path")
        if path:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, title: str, total: str | None = None) -> DataFrame:
    """``df`` with 0, 1, ... in ``order`` within each ``group``, and the size of the group as ``total``; nulls come first and are a group.

    Rows are sorted by ranges into a table, in which a row's number tells its task and its place there. What a
    task has of a group is counted and the counts of earlier tasks are added, so no task sees a whole group.
    """
    keys = [F.col(c) for c in (*group, *order)]
    rows = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), title)
    task = F.shiftrightunsigned("_at", 33)
    held = rows.groupBy(*group, task.alias("_task")).agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)), "_task", (before - F.col("_low")).alias("_move"), F.sum("_n").over(whole).alias("_all"))
    held = small(cut(held, f"{title}-counts"))
    on = F.shiftrightunsigned(rows["_at"], 33) == held["_task"]
    for i, c in enumerate(group):
        on = on & rows[c].eqNullSafe(held[f"_g{i}"])
    return rows.join(held, on).select(*df.columns, (F.col("_at") + F.col("_move")).alias(name), *([] if total is None else [F.col("_all").alias(total)]))


def _width(df: DataFrame) -> Column:
    """About the bytes of a row."""
    fixed, parts = 8, []
    for f in df.schema:
        if isinstance(f.dataType, (StringType, BinaryType)):
            parts.append(F.octet_length(f.name))
        elif isinstance(f.dataType, ArrayType) and not isinstance(f.dataType.elementType, (StringType, StructType, ArrayType)):
            parts.append(8 * F.size(f.name))
        elif isinstance(f.dataType, (ArrayType, StructType, MapType)):
            parts.append(F.octet_length(F.to_json(F.struct(f.name))))
        fixed += 8
    return sum((F.coalesce(x, F.lit(0)).cast("long") for x in parts), F.lit(fixed).cast("long"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``rows`` rows of ``most`` bytes together, else leave it to a shuffle join.

    ``df`` should be a table from :func:`cut`: its rows are counted and measured here.
    """
    if df.count() > rows:
        return df
    return F.broadcast(df) if (df.agg(F.sum(_width(df))).first()[0] or 0) <= most else df


def in_arrow(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``rows`` through ``run`` in batches of ARROW_BYTES, whatever the length of their texts; a task gives memory back at its end."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(each, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores in front as keep it apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text has the remainder ``fold``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, label) for each vertex of ``edges``; label is the smallest vertex of its component.

    Alternating large-star and small-star steps on the edge list. Neighbour
    minima are pre-aggregated before they are joined back, so a hub isn't
    gathered into one row or task, and each round is cut with a table.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(down, "u")
        step = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))).distinct()
        last, e = e, cut(step, "edges")
        discard(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    stars = e.select(F.col("u").alias("v"), F.col("v").alias("label"))
    return stars.union(e.select("v", F.col("v").alias("label")).distinct())


def pivot_pairs(lists: DataFrame, may_match: Column, turn: int) -> DataFrame:
    """(a, b, sa, sb) of each member of a list with the list's pivot, without repeats.

    The pivot is the anchor that comes first in the list's order, and in later turns the one with
    the least hash for that turn; a list of n members yields at most n-1 rows, never n².
    """
    place = F.col("pos") if turn == 0 else F.lit(0)
    order = F.struct(place.alias("o"), F.xxhash64("id", F.lit(turn)).alias("h"), F.col("id").alias("b"), F.col("size").alias("sb"), F.col("pos").alias("pb"))
    pivots = lists.where("anchor").groupBy("key").agg(F.min(order).alias("x")).select("key", "x.b", "x.sb", "x.pb")
    found = lists.select("key", F.col("id").alias("a"), F.col("size").alias("sa"), F.col("pos").alias("pa")).join(pivots, "key").where("a <> b").where(may_match)
    return _ordered(found)


def cross_pairs(lists: DataFrame, may_match: Column) -> DataFrame:
    """(a, b, sa, sb) of the members of a list that carry different labels, without repeats."""
    left, right = (lists.select("key", F.col("id").alias(x), F.col("size").alias("s" + x), F.col("pos").alias("p" + x), F.col("label").alias("l" + x), F.col("anchor").alias("n" + x)) for x in "ab")
    return left.join(right, "key").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & (F.col("na") | F.col("nb")) & may_match).select("a", "sa", "b", "sb").distinct()


def _ordered(pairs: DataFrame) -> DataFrame:
    x, y = F.struct(F.col("a").alias("i"), F.col("sa").alias("s")), F.struct(F.col("b").alias("i"), F.col("sb").alias("s"))
    return pairs.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).select(F.col("x.i").alias("a"), F.col("x.s").alias("sa"), F.col("y.i").alias("b"), F.col("y.s").alias("sb")).distinct()


def link_lists(lists: DataFrame, verify, may_match: Column, turns: int = 4, pairs_per_row: float = 16.0, dense=None) -> tuple[DataFrame, DataFrame]:
    """(labels, links) of the graph whose links are the verified pairs that share a list.

    ``lists``: key, id, size, pos, anchor (cut; each list with two members or more, of
    which one is an anchor). Two members need a look if one of them is an anchor and
    ``may_match`` holds, a condition on their sizes sa and sb and places pa and pb.
    ``verify(pairs)`` keeps the rows (a, b) that are true links. Two ids of one
    component need no further look, so after each turn lists shrink to what is
    still open: first every member meets the list's pivot; what the pivots
    have joined is contracted to components; then the members of a list
    that are still in different components meet each other. Further pivots are
    tried while that last step would be large and they halve it. No pair is
    lost: a pair that is never compared is in one component already.

    With ``dense``, the lists with more than ``pairs_per_row`` open pairs for each member go to
    ``dense(lists, labels, links)`` after the first turn, which returns all links (a, b) among their members.
    """
    links, labels, open_lists, before = None, None, lists, None
    for turn in range(turns):
        pairs = pivot_pairs(open_lists, may_match, turn)
        found = verify(pairs).select("a", "b")
        known, links = links, cut(found if links is None else links.union(found).distinct(), "links")
        discard(known, labels)
        labels = cut(connected_components(links), "labels")
        named = lists.join(labels.withColumnRenamed("v", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        spread = named.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.count("*").alias("labels")).where("labels > 1").select("key", ((F.col("n") * F.col("n") - F.col("n2")) / 2).alias("left"), "n")
        if open_lists is not lists:
            discard(open_lists)
        open_lists = cut(named.join(spread, "key").select("key", "id", "size", "pos", "anchor", "label", "left", "n"), "open")
        rows, total = open_lists.groupBy("key").agg(F.count("*").alias("n"), F.first("left").alias("left")).agg(F.sum("n"), F.sum("left")).first()
        if not rows:
            return labels, links
        if dense or total <= pairs_per_row * rows or (before is not None and total > before / 2):
            break
        before = total
    many = F.col("left") > pairs_per_row * F.col("n")
    found = verify(cross_pairs(open_lists.where(~many) if dense else open_lists, may_match)).select("a", "b")
    if dense and open_lists.where(many).limit(1).count():
        found = found.union(dense(open_lists.where(many), labels, links).select("a", "b"))
    links = cut(links.union(found).distinct(), "links")
    return cut(connected_components(links), "labels"), links
