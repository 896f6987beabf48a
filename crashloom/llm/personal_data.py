"""Personal data in texts, plain and disguised: deobfuscation that keeps offsets.

E-mail addresses, IP addresses, card and phone numbers are first looked for in the text as it is. Then
two transducers rewrite it, each with a map from its output back to its input: the first replaces
look-alike characters and leaves out invisible ones, the second turns spelled digits and the disguises of at,
dot, dash and plus into the characters they stand for. What the same detectors find in the rewritten text is mapped back
through both, and a span whose source reads differently from what was found is reported too, unless it
lies within a plain span of its kind.

A bare "at" between words only counts if a disguised dot follows its next word, as it is a common word.

Positions are code points, ends exclusive. Each detector passes over a text once: addresses start from their
at-signs, and numbers from the first digit of a run, so long runs that match nothing take linear time.

Defined results: a null text is an empty one, without findings. Repeated rows get the same findings each, and other
columns than the id and the text are not looked at.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
SPAN = "struct<kind:string,start:int,stop:int,value:string>"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = {"card": (16, 19), "phone": (8, 15)}

#: Letters of other scripts that look like Latin ones, and the Latin ones.
LOOKALIKES = ("АВЕЅІЈКМНОРСТХУԚԜаеѕіјорсхуԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν", "ABESIJKMHOPCTXYQWaesijopcxydqwhABEZHIKMNOPTYXoav")
#: Characters that don't show.
INVISIBLE = "\u00ad\u180e\u200b\u200c\u200d\u2060\ufeff"
#: Spelled digits.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

#: Spaces that may stand around a disguised sign, and its brackets.
GAP = 3
_BRACKETED = re.compile(r"[\[({<] {0,3}(at|@|dot|\.) {0,3}[\])}>]")
_SIGNS = {"dot": ".", "plus": "+", "dash": "-", "hyphen": "-", "at": "@", "@": "@", ".": "."}
_LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.-")
#: Characters of the longest label that may stand between a bare "at" and a disguised dot.
LABEL = 64
#: The end of a disguised address: a top-level name has letters only.
_TOP = re.compile(r"\.[A-Za-z]{2,}\Z")
_NUMBERS = re.compile(r"[0-9](?:[ .-]?[0-9])+")


@lru_cache(None)
def lookalikes() -> tuple[dict[int, str], frozenset[str]]:
    """Each look-alike with its ASCII character, and the set of look-alikes and invisible characters.

    By rule: decimal digits of all scripts, spaces, dashes, and letters and marks whose compatibility form is
    one ASCII character.
    """
    table = dict(zip(map(ord, LOOKALIKES[0]), LOOKALIKES[1]))
    for code in range(0x80, 0x20000):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Nd":
            table[code] = str(unicodedata.decimal(c))
        elif kind == "Zs":
            table[code] = " "
        elif kind == "Pd":
            table[code] = "-"
        elif kind in ("Lu", "Ll", "Po", "Ps", "Pe", "Sm") and len(plain := unicodedata.normalize("NFKC", c)) == 1 and plain.isascii():
            table[code] = plain
    table[0x2212] = "-"
    return table, frozenset(map(chr, table)).union(INVISIBLE)


def emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        found = DOMAIN.match(text, at + 1)
        start = at
        while found and start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            last = found.end()
            yield start, last
        at = text.find("@", max(last, at + 1))


def luhn(digits: str) -> bool:
    twice = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(twice[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, stop), kinds by their places in KINDS."""
    out = [(0, *span) for span in emails(text)]
    for run in _NUMBERS.finditer(text):
        # addresses and card numbers lie within such runs
        start, stop = run.span()
        if stop - start < 7:
            continue
        for m in ADDRESS.finditer(text, start, stop):
            if all(len(part.lstrip("0")) < 4 and int(part.lstrip("0") or 0) < 256 for part in m[0].split(".")):
                out.append((1, *m.span()))
        if stop - start >= DIGITS["card"][0]:
            out += [(2, *m.span()) for m in CARD.finditer(text, start, stop) if (digits := _digits(m[0], "card")) and luhn(digits)]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if _digits(m[0], "phone")]


def _digits(found: str, kind: str) -> str:
    """The digits of a match, nothing if they are too few or too many."""
    digits = re.sub("[^0-9]", "", found)
    return digits if DIGITS[kind][0] <= len(digits) <= DIGITS[kind][1] else ""


def unmask(text: str) -> tuple[str, list[int] | None]:
    """The text in plain characters, and the source place of each if invisible ones were left out."""
    table, all_of_them = lookalikes()
    if text.isascii() or all_of_them.isdisjoint(text):
        return text, None
    plain = text.translate(table)
    if not any(c in plain for c in INVISIBLE):
        return plain, None
    places = [i for i, c in enumerate(plain) if c not in INVISIBLE]
    return "".join(plain[i] for i in places), places


def _words(low: str, words: Iterable[str]) -> Iterator[tuple[int, int, str]]:
    """(start, stop, word) of the whole words."""
    for word in words:
        start = low.find(word)
        while start >= 0:
            stop = start + len(word)
            if not (start and low[start - 1].isalnum()) and not low[stop : stop + 1].isalnum():
                yield start, stop, word
            start = low.find(word, stop)


def _spaces(text: str, start: int, stop: int) -> tuple[int, int]:
    """The span with up to GAP spaces on either side."""
    left = start - len(text[max(0, start - GAP) : start]) + len(text[max(0, start - GAP) : start].rstrip(" "))
    right = stop + len(text[stop : stop + GAP]) - len(text[stop : stop + GAP].lstrip(" "))
    return left, right


def _between(text: str, start: int, stop: int) -> tuple[int, int] | None:
    """The span with the spaces around it, of which there are some on both sides, if letters or digits come before and after them."""
    left, right = _spaces(text, start, stop)
    if left < start and right > stop and text[left - 1 : left].isalnum() and text[right : right + 1].isalnum():
        return left, right


def undo(text: str) -> tuple[str, list[tuple[int, int, int]]]:
    """The text without disguises, and its pieces as (place, source start, source end) in order.

    A piece of one character stands for all of its source; between such pieces the text is as it was.
    Spelled digits with one space or hyphen between them are put together.
    """
    low = text.lower()
    if len(low) != len(text):
        low = text.translate({c: c + 32 for c in range(65, 91)})
    made = [(*_spaces(text, *m.span()), _SIGNS[m[1]]) for m in _BRACKETED.finditer(low)]
    made += [(*span, _SIGNS[word]) for start, stop, word in _words(low, ("dot", "dash", "hyphen")) if (span := _between(text, start, stop))]
    for start, _, sign in list(made):
        # a bare "at" before the label before a disguised dot
        if sign == ".":
            left = start
            while left > 0 and start - left < LABEL and text[left - 1] in _LABEL:
                left -= 1
            at = low[max(0, left - GAP - 3) : left].rstrip(" ")
            end = max(0, left - GAP - 3) + len(at)
            if at.endswith("at") and not at[-3:-2].isalnum() and (span := _between(text, end - 2, end)):
                made.append((*span, "@"))
    spelled = sorted(_words(low, SPELLED))
    # plus before a digit or a spelled one
    first = {start for start, _, _ in spelled}
    made += [(start, stop + (text[stop : stop + 1] == " "), "+") for start, stop, _ in _words(low, ("plus",)) for n in [stop + (text[stop : stop + 1] == " ")] if n in first or "0" <= text[n : n + 1] <= "9"]
    for n, (start, stop, word) in enumerate(spelled):
        joined = n + 1 < len(spelled) and spelled[n + 1][0] == stop + 1 and text[stop] in " -"
        made.append((start, stop + joined, SPELLED[word]))
    if not made:
        return text, []
    out, pieces, at, size = [], [], 0, 0
    for start, stop, c in sorted(made):
        if start >= at:
            out += [text[at:start], c]
            size += start - at
            pieces.append((size, start, stop))
            size, at = size + 1, stop
    out.append(text[at:])
    return "".join(out), pieces


def find(text: str) -> tuple[list, list]:
    """Plain spans and all spans as (kind, start, stop, value), by kind and start; a value is what the identifier reads without disguises."""
    base = sorted((k, b, e, text[b:e]) for k, b, e in detect(text))
    plain, places = unmask(text)
    clear, pieces = undo(plain)
    if clear == text:
        return base, base
    starts = [p[0] for p in pieces]

    def source(i: int) -> tuple[int, int]:
        """Where the character at ``i`` of the clear text comes from."""
        n = bisect_right(starts, i) - 1
        if n >= 0 and pieces[n][0] == i:
            start, stop = pieces[n][1:]
        else:
            start = i if n < 0 else pieces[n][2] + i - pieces[n][0] - 1
            stop = start + 1
        return (start, stop) if places is None else (places[start], places[stop - 1] + 1)

    plain_spans = [sorted((b, e) for k, b, e, _ in base if k == kind) for kind in range(len(KINDS))]
    more = []
    for k, b, e in detect(clear):
        start, stop = source(b)[0], source(e - 1)[1]
        n = bisect_right(plain_spans[k], (start, len(text))) - 1
        within = n >= 0 and plain_spans[k][n][1] >= stop
        if text[start:stop] != clear[b:e] and not within and (k > 0 or _TOP.search(clear, b, e)):
            more.append((k, start, stop, clear[b:e]))
    return base, sorted(base + more)


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, base, spans): plain spans and all spans of each text as array<struct<kind, start, stop, value>>."""
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda spans: [{"kind": KINDS[k], "start": b, "stop": e, "value": v} for k, b, e, v in spans]
        for batch in batches:
            found = [find(t.as_py()) for t in batch.column(1)]
            base, spans = (pa.array([named(x[i]) for x in found], pa.list_(span)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), base, spans], ["id", "base", "spans"])

    kind = docs.schema[id].dataType.simpleString()
    return common.in_arrow(rows, run, f"id {kind}, base array<{SPAN}>, spans array<{SPAN}>").withColumnRenamed("id", id)


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def rendered(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
