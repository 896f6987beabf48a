"""Secret scans by multipart credential linking, in DataFrame functions only.

Strong findings are assignments to secret-like names, access key identifiers and long
hexadecimal runs. Weak parts alone mean little: user names, shorter hexadecimal runs, values of other
keys, runs of 40 letters and digits such as the secrets of access keys, and endpoints. An interval join looks, in scopes of ``SCOPE`` characters on either
side, for the complementary part: an identifier needs a secret, a secret an identifier or
an endpoint, an endpoint a secret. Only weak parts with a complement are reported.

The join is by (document, scope cell, class) against the first and last start of each
class in a cell, so dense documents make no pairs: a complement in the same cell is
always near enough, one in a neighbour cell is if its nearest start is.

Positions are code points, ends exclusive. Weak parts are what a pattern finds that has the
strong ones as its first choices where they begin at the same place; one that begins earlier, such as an
endpoint with a secret in its query, can hold a strong one.

Defined results: a null text is an empty one, without findings. Repeated rows get the
same findings each.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

NAMES = "(password|passwd|secret|token|api_?key)"
ASSIGN = "(?i:" + NAMES + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
USER = r"""(?i:user|username|login|client_id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
SHORT = "[0-9a-f]{16,23}"
#: Values of keys whose names ASSIGN doesn't have, and runs as long as the secrets that go with access key identifiers.
KEYED = r"""(?i:access_?key|secret_?key|private_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{16,}"""
RUN, RUN_LENGTH = "[A-Za-z0-9+/]{40,}", 40
#: A run with all of these isn't a word or a path.
MIXED = ["[A-Z]", "[a-z]", "[0-9]"]
ENDPOINT = r"""(?i:https?|postgres|mysql|redis|amqp)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+"""
ANY = "|".join([ASSIGN, ACCESS, HEX, USER, KEYED, RUN, SHORT, ENDPOINT])
#: Least length of an assigned value.
VALUE = 6
SCOPE = 300
#: Kinds in the order in which spans with equal starts are listed, with their class.
KINDS = {"assign": "secret", "access": "id", "hex": "secret", "user": "id", "short_hex": "secret", "endpoint": "endpoint", "keyed": "secret", "run": "secret"}
NEEDS = {"id": ["secret"], "secret": ["id", "endpoint"], "endpoint": ["secret"]}
SPAN = "array<struct<start:int,ord:int,stop:int>>"


def _running(lengths: Column) -> Column:
    """The sums of an array's first 1, 2, ... items, of which there are some. Chunks of about the root of its size are summed first, so n items take n times that root."""
    add = lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y)
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))

    def of_chunk(x: Column, sums: Column, k: Column, c: Column) -> Column:
        chunk, before = F.slice(x, c * k + 1, k), add(F.slice(sums, F.lit(1), c))
        return let(F.struct(chunk.alias("x"), before.alias("b")), lambda s: F.transform(s["x"], lambda _, j: s["b"] + add(F.slice(s["x"], F.lit(1), j + 1))))

    def whole(x: Column, k: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / k).cast("int")), lambda c: add(F.slice(x, c * k + 1, k)))
        return let(sums, lambda sums: F.flatten(F.transform(sums, lambda _, c: of_chunk(x, sums, k, c))))

    return let(lengths, lambda x: let(F.ceil(F.sqrt(F.size(x))).cast("int"), lambda k: whole(x, k)))


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, m>> of the leftmost non-overlapping matches: gaps and matches alternate, so running lengths are the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
    return F.when(text.rlike(pattern), F.transform(F.arrays_zip(found.alias("m"), _running(lengths).alias("stop")), lambda x: F.struct((x["stop"] - F.length(x["m"])).alias("start"), x["stop"].alias("stop"), x["m"].alias("m")))).otherwise(
        F.expr("cast(array() as array<struct<start:int,stop:int,m:string>>)")
    )


def _spans(found: Column, order: int | Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), (F.lit(order) if isinstance(order, int) else order(x)).alias("ord"), x["stop"].alias("stop")))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans): base and all spans as array<struct<start, ord, stop>>."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("_t"), F.xxhash64(text).alias("rid"))
    value = F.regexp_extract_all(F.col("_t"), F.lit(ASSIGN), F.lit(2))
    long_enough = F.filter(F.arrays_zip(_matches(F.col("_t"), ASSIGN).alias("s"), F.when(F.col("_t").rlike(ASSIGN), value).otherwise(F.expr("cast(array() as array<string>)")).alias("v")), lambda x: F.length(x["v"]) >= VALUE)
    weak_kind = lambda x: F.when(x["m"].rlike("^" + ASSIGN + "$") | x["m"].rlike("^" + ACCESS + "$") | x["m"].rlike("^" + HEX + "$"), -1).when(x["m"].rlike("^" + SHORT + "$"), 4).when(x["m"].rlike("^" + ENDPOINT + "$"), 5).when(x["m"].rlike("^" + KEYED + "$"), 6).when(x["m"].rlike("^" + RUN + "$"), F.when((F.length(x["m"]) == RUN_LENGTH) & reduce(and_, (x["m"].rlike(p) for p in MIXED)), 7).otherwise(-1)).otherwise(3)
    each = rows.select(
        "doc_id", "rid",
        _spans(F.transform(long_enough, lambda x: x["s"]), 0).alias("a"),
        _spans(_matches(F.col("_t"), ACCESS), 1).alias("k"),
        _spans(_matches(F.col("_t"), HEX), 2).alias("h"),
        F.filter(_spans(_matches(F.col("_t"), ANY), weak_kind), lambda x: x["ord"] >= 0).alias("w"),
    )
    each = common.cut(each, "findings")
    linked = _linked(each)
    base = F.array_sort(F.concat("a", "k", "h"))
    joined = each.join(linked, each["doc_id"].eqNullSafe(linked["_d"]) & (each["rid"] == linked["_r"]), "left")
    every = F.array_sort(F.concat("a", "k", "h", F.coalesce("linked", F.expr(f"cast(array() as {SPAN})"))))
    return joined.select("doc_id", F.size("a").cast("long").alias("n_assign"), F.size("k").cast("long").alias("n_access"), F.size("h").cast("long").alias("n_hex"), base.alias("base"), every.alias("spans"))


def _linked(each: DataFrame) -> DataFrame:
    """(_d, _r, linked): the weak spans of a document that have a complement."""
    kinds = list(KINDS.values())
    parts = each.where("size(w) > 0").distinct().select(F.col("doc_id").alias("_d"), F.col("rid").alias("_r"), F.explode(F.concat("a", "k", "h", "w")).alias("s"))
    parts = parts.withColumn("class", F.element_at(F.array(*map(F.lit, kinds)), F.col("s.ord") + 1)).withColumn("cell", F.floor(F.col("s.start") / SCOPE))
    cells = parts.groupBy("_d", "_r", "cell", "class").agg(F.min("s.start").alias("low"), F.max("s.start").alias("high"))
    needs = F.create_map(*[x for c, n in NEEDS.items() for x in (F.lit(c), F.array(*map(F.lit, n)))])
    weak = parts.where("s.ord >= 3").select("_d", "_r", "s", F.explode(needs[F.col("class")]).alias("class"), F.col("cell").alias("own"))
    weak = weak.select("*", F.explode(F.expr("sequence(own - 1, own + 1)")).alias("cell"))
    near = weak.alias("w").join(cells.alias("c"), F.expr("w._d <=> c._d and w._r = c._r and w.cell = c.cell and w.class = c.class"))
    near = near.where(f"w.cell = own or (w.cell < own and high >= s.start - {SCOPE}) or (w.cell > own and low <= s.start + {SCOPE})")
    return near.select("w._d", "w._r", "s").distinct().groupBy("_d", "_r").agg(F.collect_list("s").alias("linked"))


def rendered(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["ord"] + 1), x["start"], x["stop"])), ",")
