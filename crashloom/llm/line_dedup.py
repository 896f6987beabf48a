"""Line dedup as a segment-partition edit join, in DataFrame functions only.

Lines of at least ``EXACT`` characters that are equal form a class, and lines of at
least ``FUZZY`` characters within ``EDITS`` edits of each other join their classes, through
chains too. The first line of a class, by (doc_id, line number), stays; the others go.

If two lines are within t edits and the shorter is cut into t+1 segments, the other
holds one of them unchanged, near its place. Each line therefore offers the hashes of its own
segments, keyed by length and segment, and probes those of lines 0 to t characters
shorter at the few places that edits can have moved a segment to. Lines that meet
are cut to what differs between them and verified by a banded bit-parallel edit distance: the cells of a column within t of the
diagonal are bits of one number, and a column takes a dozen operations.

Lines are identified by 64-bit hashes (two of them for equality). Lists of lines that
share a segment go to :func:`common.link_lists`, which emits no pairs of a whole group.

Defined results: null texts stay null; a document of which nothing is left has an empty
text. Short lines always stay. Equal (doc_id, text) rows are one document here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

EDITS = 2
EXACT, FUZZY = 10, 24
#: Pieces of what differs between two lines, for a quick check of long differences.
PIECES = 12
#: Characters whose counts are compared first.
LETTERS = "etaoinsrhldcumg "


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, no, line, n, h, h2) for each line of each document that may go."""
    text = F.col("text").cast("string")
    rows = docs.where(text.isNotNull()).select("doc_id", F.xxhash64(text).alias("rid"), F.posexplode(F.split(text, "\n", -1)).alias("no", "line"))
    rows = rows.withColumn("n", F.length("line")).where(F.col("n") >= EXACT)
    return rows.withColumn("h", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(17), "line"))


def probes(edits: int = EDITS) -> list[tuple[int, int, int]]:
    """(characters less, segment, move) of each key of a line; the first edits+1 are its own segments.

    If the other line is ``less`` characters shorter, edits before segment i can have moved it by up
    to i places and those behind it must make up the difference.
    """
    own = [(0, i, 0) for i in range(edits + 1)]
    moved = [(less, i, m) for less in range(edits + 1) for i in range(edits + 1) for m in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)]
    return own + [x for x in moved if x not in own]


def keyed(rows: DataFrame, edits: int = EDITS) -> DataFrame:
    """(key, id, size, anchor) of ``rows`` (h, n, line); an anchor is one of the line's own segments.

    A line of n characters has segments of n div parts, and the last n mod parts of them one more.
    """
    parts, every = edits + 1, probes(edits)
    pick = lambda k: "element_at(array(" + ", ".join(str(x[k]) for x in every) + "), p + 1)"
    each = rows.select("h", "n", "line", F.explode(F.sequence(F.lit(0), F.lit(len(every) - 1))).alias("p"))
    each = each.selectExpr("h", "n", "line", "p", f"n - {pick(0)} as l", f"{pick(1)} as i", f"{pick(2)} as m")
    each = each.selectExpr("h", "n", "line", "p", "l", "i", f"cast(l div {parts} as int) + if(i >= {parts} - l % {parts}, 1, 0) as size", f"cast(l div {parts} as int) * i + greatest(0, i - ({parts} - l % {parts})) + 1 + m as at")
    each = each.where("at >= 1 and at + size - 1 <= n")
    return each.selectExpr("xxhash64(l, i, substring(line, at, size)) as key", "h as id", "n as size", f"p < {parts} as anchor")


def letter_counts(line: str) -> Column:
    """Counts of sixteen characters, modulo 16, in the nibbles of one number."""
    terms = [f"shiftleft(cast((length({line}) - length(replace({line}, '{c}', ''))) & 15 as bigint), {4 * k})" for k, c in enumerate(LETTERS)]
    return F.expr(" | ".join(terms))


def counts_allow(a: str, b: str, edits: int = EDITS) -> Column:
    """Whether letter counts can belong to lines within ``edits`` edits: an edit changes two counts by one at most."""
    terms = [f"least(({a} >>> {k} & 15) - ({b} >>> {k} & 15) & 15, ({b} >>> {k} & 15) - ({a} >>> {k} & 15) & 15)" for k in range(0, 64, 4)]
    return F.expr(" + ".join(terms) + f" <= {2 * edits}")


def trimmed(pairs: DataFrame, longest: int = 16) -> DataFrame:
    """(a, b, x, y) with the common beginnings and ends cut from x and y, which leaves edit distances as they are.

    The common beginning's length is found by halving steps from 2**longest on; a longer one is
    cut as far as that.
    """
    steps = ", ".join(str(1 << k) for k in range(longest, -1, -1))
    same = f"aggregate(array({steps}), 0, (p, k) -> if(p + k <= least(length(x), length(y)) and substring(x, p + 1, k) = substring(y, p + 1, k), p + k, p))"
    for _ in range(2):
        # a table in between keeps the length from being worked out again for each use
        pairs = common.cut(pairs.selectExpr("a", "b", "x", "y", f"{same} as p"), "line-trim").selectExpr("a", "b", "reverse(substring(x, p + 1)) as x", "reverse(substring(y, p + 1)) as y")
    return pairs


def within(a: str, b: str, edits: int = EDITS) -> Column:
    """Whether columns ``a`` and ``b``, ``a`` not shorter, are within ``edits`` edits: banded bit-parallel edit distance.

    Bit p of a word stands for row j - edits + p of column j. vp and vn hold where a
    cell is one more or one less than the cell above it; d holds where it equals the one up
    and left of it. The distance is the length difference plus the columns in which
    the diagonal that ends in the last cell steps up.
    """
    band, full = 2 * edits + 1, (1 << (2 * edits + 1)) - 1
    rows = f"concat(array_repeat('', {edits}), regexp_extract_all({a}, '(?s).', 0), array_repeat('', {edits}))"
    match = " + ".join(f"if(get(x.r, j + {p}) = c, {1 << p}, 0)" for p in range(band))
    hp = f"(s.vn | ({full} ^ (d | s.vp)))"
    close = f"""struct(((d & s.vp) | ({full} ^ (shiftright(d, 1) | {hp}))) & {full} as vp, shiftright(d, 1) & {hp} as vn,
        s.hit + (shiftright(d, {edits} + length({a}) - length({b})) & 1) as hit)"""
    return F.expr(f"""length({a}) - length({b}) <= {edits} and length({a}) - aggregate(
        transform(array(struct({rows} as r, regexp_extract_all({b}, '(?s).', 0) as c)), x -> transform(x.c, (c, j) -> {match}))[0],
        struct({((1 << (edits + 1)) - 1) << edits} as vp, 0 as vn, 0 as hit),
        (s, pm) -> transform(array(((((pm & s.vp) + s.vp) ^ s.vp) | pm | s.vn) & {full}), d -> {close})[0],
        s -> s.hit) <= {edits}""")


def may_match() -> Column:
    return (F.abs(F.col("sa") - F.col("sb")) <= EDITS) & counts_allow("pa", "pb")


def classes(docs: DataFrame) -> DataFrame:
    """(h, label): the hashes of the lines that are near other lines, with the least hash of their component."""
    # each line once, however many documents hold it; copies are combined before the shuffle
    rows = keyed(lines(docs).where(F.col("n") >= FUZZY).select("h", "n", "line").distinct())
    # one shuffle; a list matters if it holds two different lines and an own segment
    w = Window.partitionBy("key")
    rows = rows.repartition("key").withColumn("low", F.min("id").over(w)).withColumn("high", F.max("id").over(w)).withColumn("own", F.max("anchor").over(w)).where("low <> high and own")
    found = common.cut(rows.groupBy("key", "id", "size").agg(F.max("anchor").alias("anchor")), "segments")
    wanted = common.cut(found.select(F.col("id").alias("h")).distinct(), "wanted-lines")
    texts = lines(docs).select("h", "line").join(common.small(wanted), "h", "left_semi").groupBy("h").agg(F.min("line").alias("line"))
    texts = common.cut(texts.withColumn("counts", letter_counts("line")), "line-texts")
    common.discard(wanted)
    counts = common.small(texts.select(F.col("h").alias("id"), F.col("counts").alias("pos")))
    lists = common.cut(found.join(counts, "id").select("key", "id", "size", "pos", "anchor"), "lists")

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = common.cut(pairs.select("a", "b"), "line-pairs")
        both = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("h").alias("b"), F.col("line").alias("y")), "b")
        longer = F.length("x") >= F.length("y")
        both = both.select("a", "b", F.when(longer, F.col("x")).otherwise(F.col("y")).alias("x"), F.when(longer, F.col("y")).otherwise(F.col("x")).alias("y"))
        near = common.cut(common.cut(trimmed(both), "line-rest").where(_pieces_allow()), "line-check")
        return near.where(within("x", "y")).select("a", "b")

    labels, _ = common.link_lists(lists, verify, may_match())
    return labels.withColumnRenamed("v", "h")


def _pieces_allow() -> Column:
    """Whether enough of the PIECES pieces of y are in x near their places: an edit touches one of them and moves the others by one."""
    return F.expr(f"""length(y) < {4 * PIECES} or size(filter(sequence(0, {PIECES - 1}), i -> instr(substring(x, greatest(1, i * cast(length(y) div {PIECES} as int) + 1 - {EDITS}), cast(length(y) div {PIECES} as int) + {2 * EDITS}),
        substring(y, i * cast(length(y) div {PIECES} as int) + 1, cast(length(y) div {PIECES} as int))) > 0)) >= {PIECES - EDITS}""")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, drop): for each document the numbers of its lines that aren't the first of their class."""
    labels = common.small(classes(docs))
    found = lines(docs).select("doc_id", "rid", "no", "h", "h2").join(labels, "h", "left")
    # lines that are only equal to others keep both hashes as their class
    found = found.withColumn("c1", F.coalesce("label", "h")).withColumn("c2", F.when(F.col("label").isNull(), F.col("h2")).otherwise(F.lit(0)))
    first = found.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "rid", "no")).alias("first"), F.count("*").alias("n")).where("n > 1").select("c1", "c2", "first")
    first = common.small(common.cut(first, "first-lines"))
    later = found.join(first, ["c1", "c2"]).where(~F.struct("doc_id", "rid", "no").eqNullSafe(F.col("first")))
    return common.cut(later.groupBy("doc_id", "rid").agg(F.array_distinct(F.collect_list("no")).alias("drop")), "repeats")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts' repeated lines removed; all rows and columns stay, whatever their names."""
    return _cleaned(docs)[0].select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) for each row of ``docs``."""
    found, lines_of, drop = _cleaned(docs.select("doc_id", "text"))
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return found.select("doc_id", count(lines_of).alias("n_lines"), count(drop).alias("n_dropped"), "text")


def _cleaned(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with clean texts and two more columns: the lines that a text had, and the numbers of those that go."""
    d, r, drop, lines_of = common.fresh(docs, "_repeat_id", "_repeat_row", "_repeats", "_lines")
    gone = common.small(repeats(docs.select("doc_id", "text"))).select(F.col("doc_id").alias(d), F.col("rid").alias(r), F.col("drop").alias(drop))
    text = docs["text"].cast("string")
    found = docs.join(gone, docs["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(text) == F.col(r)), "left")
    found = found.withColumn(lines_of, F.split(text, "\n", -1))
    kept = F.expr(f"array_join(transform(array_except(sequence(0, size(`{lines_of}`) - 1), `{drop}`), i -> `{lines_of}`[i]), '\n')")
    return found.withColumn("text", F.when(F.col(drop).isNull(), text).otherwise(kept)), lines_of, drop
