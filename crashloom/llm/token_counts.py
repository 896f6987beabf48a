"""Token counts with a whole-token shortcut, and the tokenizer that packing shares.

A byte-level BPE splits a text into pre-tokens and merges within each of them.
Offline, each vocabulary string is tried: it is *whole* if it is exactly one
pre-token and encodes alone as one token. Online, a pre-token that is whole counts
one; only the rest is merged.

Texts are cut at single spaces between two characters that are no white space, where
the pre-tokenizer always cuts too, and what a cut-out piece encodes to is remembered.
A text that holds a special string, or characters outside well-settled letter
blocks, goes to the library whole, so results are the library's own.

Defined results: a null text counts as an empty one, with no token.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

#: Pieces of at most so many characters that a worker remembers.
REMEMBERED, LONGEST = 60_000, 48
#: A space beside other white space; no other kinds are left in a settled text.
_ADJACENT = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ", " \xa0", "\xa0 ")
_CUT = re.compile(r"(?<=\S)(?= \S)")
_UNSETTLED = re.compile("[^\n\r\t\x20-\x7e\xa0-ɏΆ-ώЀ-џぁ-ゖァ-ヺ一-龥가-힣‐-‧€]")


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ids(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _remember(seen: dict, piece: str, value) -> None:
    if len(piece) <= LONGEST:
        if len(seen) >= REMEMBERED:
            seen.clear()
        seen[piece] = value


class Counter(dict):
    """Pieces to their number of tokens."""

    def __init__(self, bpe: "Bpe"):
        self.bpe = bpe

    def __missing__(self, piece: str) -> int:
        b = self.bpe
        n = sum(1 if x in b.whole else len(b.merge(x)) for x in b.split(piece))
        _remember(self, piece, n)
        return n


class Encoder(dict):
    """Pieces to the little-endian 32-bit ids of their tokens."""

    def __init__(self, bpe: "Bpe"):
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        ids = _ids(self.bpe.merge(piece))
        _remember(self, piece, ids)
        return ids


class Bpe:
    """A byte-level BPE of a tokenizers file, given as its JSON text.

    The library's own tokenizer is made only for a text that it must see whole.
    """

    def __init__(self, spec: str, whole: frozenset[str] | None = None):
        import regex
        import tiktoken

        import public_tokenizers

        self.spec = spec
        said = json.loads(spec)
        kind = said["pre_tokenizer"]
        if said["model"]["type"] != "BPE" or kind["type"] != "ByteLevel" or kind.get("add_prefix_space") or said["normalizer"] or not kind.get("use_regex", True):
            raise ValueError("not a byte-level BPE without normalizer and prefix space")
        self.special = [t["content"] for t in said["added_tokens"]]
        of = _bytes_of()
        vocab = {t: i for t, i in said["model"]["vocab"].items() if t not in self.special}
        ranks = {bytes(of[c] for c in t): i for t, i in vocab.items()}
        self.merge = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.whole = whole if whole is not None else self.prove_whole(ranks)
        self.counts, self.ids = Counter(self), Encoder(self)

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.spec)

    def prove_whole(self, ranks: dict[bytes, int]) -> frozenset[str]:
        """The vocabulary strings that are one pre-token and encode alone as one token."""
        out = set()
        for raw, i in ranks.items():
            try:
                s = raw.decode()
            except UnicodeDecodeError:
                continue
            if self.split(s) == [s] and not _UNSETTLED.search(s) and self.library.encode(s, add_special_tokens=False).ids == [i]:
                out.add(s)
        return frozenset(out)

    def pieces(self, text: str) -> list[str] | None:
        """``text`` in pieces that encode independently of each other; None if the library must see it whole."""
        if _UNSETTLED.search(text) or any(s in text for s in self.special):
            return None
        if text[0] == " " or text[-1] == " " or any(x in text for x in _ADJACENT):
            return _CUT.split(text)
        first, *rest = text.split(" ")
        return [first, *map(" ".__add__, rest)]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        got = self.pieces(text)
        return len(self.library.encode(text, add_special_tokens=False).ids) if got is None else sum(map(self.counts.__getitem__, got))

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        got = self.pieces(text)
        if got is None:
            return _ids(self.library.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.ids.__getitem__, got))


@lru_cache(maxsize=1)
def shared_bpe(spec: str, whole: frozenset[str]) -> Bpe:
    """One for each worker process, which serves many tasks."""
    return Bpe(spec, whole)


def load(path: str) -> str:
    """The tokenizer file's text; the driver reads it and executors get it by broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs``."""
    spec = load(path)
    shared = docs.sparkSession.sparkContext.broadcast((spec, Bpe(spec).whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared_bpe(*shared.value)
        for x in batches:
            n = [bpe.count(t) for t in x.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(2), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("_text"), F.octet_length(text).cast("long").alias("_bytes"))
    return in_arrow(rows, run, f"doc_id {rows.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
