"""Repair of the turn structure of conversations by cheapest edits, the least of them by prefix doubling.

Rows of a conversation are kept, given another role, deleted, or rows without text are inserted, until
the initials of the roles read ``(s?(ua)+)?``. Costs are below. Of the cheapest ways, the one whose audit (an initial for each
edit, in order) is least in ASCII order is taken.

Cost DP. What a row does to the four states of that pattern is a 4 x 4 matrix of costs, and rows in a sequence
multiply their matrices in (min, +). Conversations are cut into blocks of ``BLOCK`` rows; products of blocks grow by doubling, so
a long conversation is spread over many tasks. Costs from the start and to the end at the edges of
a block give those of all nodes (place, state) in it, and with them the arcs of cheapest ways.

Prefix doubling. ``ranks`` holds for each node the rank of the least audit of 2**k letters from it, and
pointers to where such an audit ends. A round joins pointers with the nodes they lead to: pairs of ranks, ranked anew, are the ranks for
twice the length, and of a node's pointers those of the least rank stay. Up to 16 letters a rank is the letters themselves in a
number. Conversations whose start has reached the end leave the rounds. Then the places at 0, 2**k, ... of
the least way are marked from the longest pointers to the shortest.

Defined results: null roles and texts are one space. Rows are ordered by turn (nulls first), then by role and the
SHA-256 of the text, so equal rows are neighbours. Rows without a conversation id are a conversation. One without rows has no repair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK = 256
#: Costs of the edits; a truncated row that stays costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: start, after the system's turn, after a user's, after an assistant's. The state after each initial, and after the role that must come next.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NEXT = [USER, USER, ASSISTANT, USER]
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Costs to the end of a conversation behind its last row.
LAST = [0, 2 * INSERT, INSERT, 0]
FAR, END = 1 << 40, -1
#: Letters of edits in ASCII order; their places, from 1, are ranks.
LETTERS = "DIKR"
#: Rounds in which ranks are letters of three bits each in one number.
PACKED = 4

WHITE = r"\x20\x09-\x0D"


def numbered(rows: DataFrame) -> DataFrame:
    """(c, turn, role, text, at, n) of rows (conv_id, turn, role, text): c is the conversation as a struct that is never null, at the place in it."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    kept = rows.select(F.struct(F.col("conv_id").alias("id")).alias("c"), "turn", text("role"), text("text"))
    return common.ranked(kept.withColumn("h", F.sha2("text", 256)), ["c"], ["turn", "role", "h"], "at", "turns", total="n")


def faults(turns: DataFrame) -> DataFrame:
    """(c, turn, at, n, initial, fault) of numbered rows; fault is b(lank), d(uplicate), t(runcated) or -. Other initials than s, u, a are x."""
    first = turns.groupBy("c", F.col("role").alias("_r"), F.col("h").alias("_h")).agg(F.min("at").alias("first"))
    met = turns.join(first.withColumnRenamed("c", "_c"), F.expr("c = _c and role = _r and h = _h"))
    letter = F.substring("role", 1, 1)
    fault = F.when(~F.col("text").rlike(f"[^{WHITE}]"), "b").when(F.col("first") < F.col("at"), "d").when(F.col("text").rlike(rf"[^.!?{WHITE}][{WHITE}]*\z"), "t").otherwise("-")
    return met.select("c", "turn", "at", "n", F.when(letter.isin("s", "u", "a"), letter).otherwise("x").alias("initial"), fault.alias("fault"))


def blocks(found: DataFrame, block: int) -> DataFrame:
    """(c, b, n, initials, faults): a block's rows as two strings."""
    rows = found.groupBy("c", F.expr(f"at div {block}").alias("b")).agg(F.array_sort(F.collect_list(F.struct("at", "initial", "fault"))).alias("r"), F.max("n").alias("n"))
    return rows.select("c", "b", "n", F.array_join("r.initial", "").alias("initials"), F.array_join("r.fault", "").alias("faults"))


def _edits(state: int, initial: str, fault: str) -> Iterator[tuple[int, int, int]]:
    """(state after the row, cost, rank of the letter)."""
    yield state, DELETE, 1
    if fault not in "bd":
        extra = TRUNCATED if fault == "t" else 0
        if state in KEEPS.get(initial, ()):
            yield KEEPS[initial][state], extra, 3
        yield NEXT[state], REROLE + extra, 4


def _with_inserts(costs: list[int]) -> list[int]:
    """Least costs if rows may be inserted in any state; two are enough, as three lead where one does."""
    for _ in range(2):
        costs = [min([costs[q], *(costs[p] + INSERT for p in range(4) if NEXT[p] == q)]) for q in range(4)]
    return costs


def _after(costs: list[int], initial: str, fault: str) -> list[int]:
    out = [FAR] * 4
    for q in range(4):
        for to, cost, _ in _edits(q, initial, fault):
            out[to] = min(out[to], costs[q] + cost)
    return out


def matrix(initials: str, faults: str) -> list[int]:
    """Least costs from each state before the rows to each one after them, row by row."""
    out = []
    for start in range(4):
        costs = [FAR] * 4
        costs[start] = 0
        for initial, fault in zip(initials, faults):
            costs = _after(_with_inserts(costs), initial, fault)
        out += costs
    return out


def arcs(first: int, initials: str, faults: str, come: list[int], go: list[int], last: bool) -> tuple[int, list[tuple[int, int, int]]]:
    """(least cost, [(node, rank of the letter, node)]) of a block: the arcs of cheapest ways.

    ``come`` and ``go`` are the costs from the start to the first place and from behind the last one to the end. A node is
    4 * place + state; those behind the last row of the conversation that need no more edits are END.
    """
    size = len(initials)
    here, there = [_with_inserts(come)], [go]
    for initial, fault in zip(initials, faults):
        here.append(_with_inserts(_after(here[-1], initial, fault)))
    for i in range(size - 1, -1, -1):
        costs = [min(there[0][to] + cost for to, cost, _ in _edits(q, initials[i], faults[i])) for q in range(4)]
        for _ in range(2):
            costs = [min(costs[q], costs[NEXT[q]] + INSERT) for q in range(4)]
        there.insert(0, costs)
    least = min(x + y for x, y in zip(here[0], there[0]))
    name = lambda i, q: END if last and i == size and go[q] == 0 else 4 * (first + i) + q
    out = []
    for i in range(size + last):
        for q in range(4):
            if here[i][q] + there[i][q] != least:
                continue
            if here[i][q] + INSERT + there[i][NEXT[q]] == least:
                out.append((name(i, q), 2, name(i, NEXT[q])))
            if i < size:
                out += [(name(i, q), letter, name(i + 1, to)) for to, cost, letter in _edits(q, initials[i], faults[i]) if here[i][q] + cost + there[i + 1][to] == least]
    return least, out


def _times(x: str, y: str) -> str:
    """SQL for the (min, +) product of two matrices."""
    return f"transform(sequence(0, 15), k -> array_min(transform(sequence(0, 3), z -> {x}[cast(k div 4 as int) * 4 + z] + {y}[4 * z + k % 4])))"


def _edges(cut_up: DataFrame) -> DataFrame:
    """The blocks with ``come`` and ``go``, by products of blocks that double in each round."""
    one = cut_up.where("b > 0 or n > size").select("c", "b", "m")
    state = common.cut(one.select("c", "b", F.col("m").alias("left"), F.col("m").alias("right")), "products")
    most, step = state.agg(F.max("b")).first()[0] or 0, 1
    while step <= most:
        before = state.select("c", (F.col("b") + step).alias("b"), F.col("left").alias("_left"))
        behind = state.select("c", (F.col("b") - step).alias("b"), F.col("right").alias("_right"))
        both = state.join(before, ["c", "b"], "left").join(behind, ["c", "b"], "left")
        both = both.select("c", "b", F.expr(f"if(_left is null, left, {_times('_left', 'left')})").alias("left"), F.expr(f"if(_right is null, right, {_times('right', '_right')})").alias("right"))
        last, state = state, common.cut(both, "products")
        common.discard(last)
        step *= 2
    begin, end = f"array({', '.join(f'{0 if q == START else FAR}L' for q in range(4))})", f"array({', '.join(f'{x}L' for x in LAST)})"
    before = state.select("c", (F.col("b") + 1).alias("b"), F.slice("left", 4 * START + 1, 4).alias("come"))
    behind = state.select("c", (F.col("b") - 1).alias("b"), F.expr(f"transform(sequence(0, 3), q -> array_min(transform(sequence(0, 3), z -> right[4 * q + z] + {end}[z])))").alias("go"))
    met = cut_up.join(before, ["c", "b"], "left").join(behind, ["c", "b"], "left")
    return met.withColumn("come", F.coalesce("come", F.expr(begin))).withColumn("go", F.coalesce("go", F.expr(end)))


def ways(found: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(costs, arcs) of rows with faults: costs has (c, cost), arcs (c, v, r, w)."""
    cut_up = blocks(found, block)
    kind = cut_up.schema["c"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [matrix(x, y) for x, y in zip(batch.column("initials").to_pylist(), batch.column("faults").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.int64()))], [*batch.schema.names, "m"])

    text = f"c {kind}, b long, n long, initials string, faults string"
    measured = common.cut(common.in_arrow(cut_up, measure, f"{text}, m array<long>").withColumn("size", F.length("initials")), "blocks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, n, initials, flaws, come, go = (batch.column(x).to_pylist() for x in ("b", "n", "initials", "faults", "come", "go"))
            got = [arcs(b[i] * block, initials[i], flaws[i], come[i], go[i], b[i] * block + len(initials[i]) == n[i]) for i in range(len(b))]
            made = [[{"v": v, "r": r, "w": w} for v, r, w in x[1]] for x in got]
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("b"), pa.array([x[0] for x in got], pa.int64()), pa.array(made, pa.list_(pa.struct([(x, pa.int64()) for x in "vrw"])))], ["c", "b", "cost", "arcs"])

    edged = _edges(measured).select("c", "b", "n", "initials", "faults", "come", "go")
    searched = common.cut(common.in_arrow(edged, search, f"c {kind}, b long, cost long, arcs array<struct<v:long,r:long,w:long>>"), "arcs")
    return searched.where("b = 0").select("c", "cost"), searched.select("c", F.inline("arcs"))


def _ranked_pairs(met: DataFrame) -> DataFrame:
    """``met`` with the ranks of its pairs (r, r2) in r."""
    pairs = common.cut(met.select("r", "r2").distinct(), "rank-pairs")
    ranks = common.small(common.cut(common.ranked(pairs, [], ["r", "r2"], "nth", "ranks"), "ranks-of-pairs"))
    return met.join(ranks, ["r", "r2"]).select("c", "v", (F.col("nth") + 1).alias("r"), "w")


def least_ways(found: DataFrame) -> DataFrame:
    """(c, p, v, r): the nodes of each conversation's least way with their places p and the ranks of the letters that follow them."""
    of_node = Window.partitionBy("c", "v")
    least = lambda df, by: df.withColumn("_low", F.min(by).over(of_node)).where(F.col(by) == F.col("_low")).drop("_low")
    rounds = [common.cut(least(found, "r"), "ways-0")]
    while rounds[-1].where(f"v = 0 and w <> {END}").limit(1).count():
        k, now = len(rounds) - 1, rounds[-1]
        open_ = now.where(f"v = 0 and w <> {END}").select("c").distinct()
        going = now.join(open_, "c", "left_semi")
        behind = going.select("c", F.col("v").alias("w"), F.col("r").alias("r2"), F.col("w").alias("w2"))
        met = going.join(behind, ["c", "w"], "left").select("c", "v", "r", F.coalesce("r2", F.lit(0)).alias("r2"), F.coalesce("w2", F.lit(END)).alias("w"))
        met = least(met, "r2").distinct()
        longer = met.select("c", "v", F.expr(f"shiftleft(r, {3 * 2**k}) | r2").alias("r"), "w") if k < PACKED else _ranked_pairs(common.cut(met, "pairs"))
        rounds.append(common.cut(longer, f"ways-{k + 1}"))
    marked = rounds[0].select("c").distinct().select("c", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("v"))
    for k in range(len(rounds) - 2, -1, -1):
        to = rounds[k].where(f"w <> {END}").groupBy("c", "v").agg(F.min("w").alias("w"))
        marked = common.cut(marked.union(marked.join(to, ["c", "v"]).select("c", F.col("p") + 2**k, "w")), "marked")
    return marked.join(rounds[0].groupBy("c", "v").agg(F.min("r").alias("r")), ["c", "v"]).select("c", "p", "v", "r")


def repair(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(report, repaired) of rows (conv_id, turn, role, text).

    ``report``: conv_id, gaps, blank, duplicate, truncated, illegal, cost. ``repaired``: conv_id, place, edit, role, text for each edit; a
    deleted row has no role and text.
    """
    turns = common.cut(numbered(rows), "turns-numbered")
    found = common.cut(faults(turns), "faults")
    costs, arcs_found = ways(found, block)
    number = F.col("turn").cast("decimal(38,0)")
    by_turn = found.groupBy("c", number.alias("t")).agg(*(F.sum((F.col("fault") == x[0]).cast("long")).alias(x) for x in ("blank", "duplicate", "truncated")))
    gaps = F.coalesce((F.max("t") - F.min("t") + 1 - F.count("t")).try_cast("long"), F.lit(0))
    stats = by_turn.groupBy("c").agg(gaps.cast("long").alias("gaps"), *(F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")))
    stats = stats.join(_illegal(found, block), "c").join(costs, "c")
    path = least_ways(arcs_found).withColumn("at", F.expr("v div 4")).withColumn("edit", F.element_at(F.array(*map(F.lit, LETTERS)), F.col("r").cast("int")))
    given = turns.select(F.col("c").alias("_c"), F.col("at").alias("_at"), F.col("role").alias("_role"), F.col("text").alias("_text"))
    path = path.join(given, F.expr("c = _c and at = _at and edit in ('K', 'R')"), "left")
    must = F.element_at(F.array(*(F.lit(ROLES[x]) for x in NEXT)), (F.col("v") % 4 + 1).cast("int"))
    role = F.when(F.col("edit") == "K", F.col("_role")).when(F.col("edit") != "D", must)
    text = F.when(F.col("edit") == "I", "").otherwise(F.col("_text"))
    return stats.select("c.id", "*").drop("c").withColumnRenamed("id", "conv_id"), path.select(F.col("c.id").alias("conv_id"), F.col("p").alias("place"), "edit", role.alias("role"), text.alias("text"))


def _illegal(found: DataFrame, block: int) -> DataFrame:
    """(c, illegal): neighbours that may not follow each other. A block's last row is in the next block too."""
    each = found.select("c", "at", "initial", F.explode(F.expr(f"if(at % {block} = {block - 1}, array(at div {block}, at div {block} + 1), array(at div {block}))")).alias("b"))
    text = each.groupBy("c", "b").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "initial")))["initial"], "").alias("s"))
    pairs = F.filter(F.transform(F.sequence(F.lit(1), F.length("s")), lambda i: F.substring(F.col("s"), i, F.lit(2))), lambda x: (F.length(x) == 2) & ~x.isin("su", "ua", "au"))
    return text.groupBy("c").agg(F.sum(F.size(pairs)).alias("illegal"))


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, audit, sha256): the edits, and the SHA-256 of the repaired ``role:text``, newline-joined. Rows pass in order, so no conversation is held."""
    kind = repaired.schema["conv_id"].dataType.simpleString()
    rows = repaired.select(F.struct("conv_id").alias("c"), "place", "edit", "role", "text").repartition("c").sortWithinPartitions("c", "place").select("c.conv_id", "edit", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, hashed, any_yet, id_type = None, None, None, False, None
        ended = lambda: pa.RecordBatch.from_arrays([pa.array([now], id_type), pa.array(["".join(audit)]), pa.array([hashed.hexdigest()])], ["conv_id", "audit", "sha256"])
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for conv, edit, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if audit is None or conv != now:
                    if audit is not None:
                        yield ended()
                    now, audit, hashed, any_yet = conv, [], hashlib.sha256(), False
                audit.append(edit)
                if edit != "D":
                    hashed.update(f"{chr(10) if any_yet else ''}{role}:{text}".encode())
                    any_yet = True
        if audit is not None:
            yield ended()

    return common.in_arrow(rows, run, f"conv_id {kind}, audit string, sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults put in, by the CRC-32 of ``conv_id:turn`` modulo 20; nulls are one space.

    0 drops a row, 1 empties its text, 2 removes its sentence marks, 3 repeats it and 4 makes it a user's.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    changed = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), code.cast("int").alias("_code")).where("_code <> 0")
    changed = changed.select("conv_id", "turn", F.when(F.col("_code") == 4, "user").otherwise(F.col("role")).alias("role"), F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), "_code")
    return changed.withColumn("_copy", F.explode(F.expr("if(_code = 3, array(0, 1), array(0))"))).select("conv_id", "turn", "role", "text")
