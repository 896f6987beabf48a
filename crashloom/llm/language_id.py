"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text is built. A
text is cross-parsed against each automaton: from left to right it is cut into the
longest phrases that occur in the language's sample. The language that needs the
fewest phrases per byte wins; ties go to the smallest name.

The parse runs over whole texts. All blocks of ``BLOCK`` bytes of an Arrow batch first advance together
through dense transition tables in numpy, each as if a phrase began with it. Then each block is
parsed again from the state that the block before it ended in, as far as the states
differ, which is a few phrases; where that changes a block's last state the next one is parsed again,
too. So the phrases are those of one parse from the text's beginning to its end.

Defined results: a null text, and one without a letter, is ``und`` with score 0, as is
any text if no label was learned. With one language learned, a text is compared
with the parse into single bytes. The score is 1 - best / second best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

#: Bytes of labelled text that are learned, over all languages together.
SAMPLE_BYTES = 96 * 1024
#: Documents that they are taken from, for each language, in the mean.
SAMPLE_DOCS = 64
BLOCK = 256
#: Bytes of text that are parsed at a time; a longer text is parsed alone.
CHUNK = 1 << 20
_FLAG, _STATE = np.int32(-(2**31)), np.int32(2**31 - 1)


def symbols(text: str) -> bytes:
    """Lower-case UTF-8 with every ASCII byte that is no letter as a space."""
    return text.lower().encode("utf-8", "replace").translate(_FOLD)


_FOLD = bytes(b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """The transitions of the suffix automaton of ``data``; state 0 is the start."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        cur = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return go


class Model:
    """Dense transition tables, one for each language, over the bytes that the samples hold.

    An entry holds the next state's row offset; its sign bit says that a phrase
    began. Class 0 is any byte that was not learned, class 1 the padding.
    """

    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(samples)
        seen = sorted(set(b"".join(samples.values())))
        self.classes = np.zeros(256, np.uint8 if len(seen) < 254 else np.uint16)
        self.classes[seen] = np.arange(len(seen)) + 2
        self.width = len(seen) + 2
        self.tables = [self._table(samples[x]) for x in self.langs]

    def _table(self, data: bytes) -> np.ndarray:
        go = suffix_automaton(data)
        w = self.width
        start = np.full(w, _FLAG, np.int32)
        for c, to in go[0].items():
            start[self.classes[c]] = to * w | _FLAG
        out = np.tile(start, (len(go), 1))
        for s, edges in enumerate(go):
            out[s, 1] = s * w
            # what follows the start, or a byte that was not learned, begins a phrase
            for c, to in edges.items() if s else ():
                out[s, self.classes[c]] = to * w
        return out.ravel()

    def phrases(self, blocks: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The phrases that each row of byte classes adds to its text's parse, a column for each language.

        ``first`` marks rows that begin a text; another row goes on where the one before it ends.
        """
        columns = np.ascontiguousarray(blocks.T)
        out = np.empty((len(blocks), len(self.langs)), np.int32)
        held = np.empty(columns.shape, np.int32)
        for k, table in enumerate(self.tables):
            state = np.zeros(len(blocks), np.int32)
            for c, was in zip(columns, held):
                state += c
                table.take(state, out=was)
                np.bitwise_and(was, _STATE, out=state)
            begun = (held < 0).sum(axis=0, dtype=np.int32)
            todo = np.flatnonzero(~first)
            while len(todo):
                at, now = todo, state[todo - 1]
                for c, was in zip(columns, held):
                    old, new = was[at], table.take(now + c[at])
                    begun[at] += (new < 0).astype(np.int32) - (old < 0)
                    was[at] = new
                    now = new & _STATE
                    apart = now != old & _STATE
                    at, now = at[apart], now[apart]
                    if not len(at):
                        break
                state[at] = now
                todo = at[at + 1 < len(blocks)] + 1
                todo = todo[~first[todo]]
            out[:, k] = begun
        return out


def _parse(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data = [symbols(t) for t in texts]
    size = np.array([len(x) for x in data])
    blocks = -(-size // BLOCK)
    at = np.cumsum(np.append(0, blocks))
    flat = np.ones(at[-1] * BLOCK, model.classes.dtype)
    for x, a in zip(data, at):
        flat[a * BLOCK : a * BLOCK + len(x)] = model.classes[np.frombuffer(x, np.uint8)]
    first = np.zeros(at[-1], bool)
    first[at[:-1]] = True
    got = model.phrases(flat.reshape(-1, BLOCK), first)
    return np.add.reduceat(got, at[:-1], axis=0), size


def judge(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    todo = [i for i, t in enumerate(texts) if model.langs and t and any(map(str.isalpha, t))]
    while todo:
        part, total = [], 0
        while todo and (not part or total + len(texts[todo[-1]]) <= CHUNK):
            total += len(texts[todo[-1]])
            part.append(todo.pop())
        need, size = _parse(model, [texts[i] for i in part])
        if len(model.langs) == 1:
            need = np.column_stack([need, np.maximum(size, need[:, 0])])
        best = need[:, : len(model.langs)].argmin(axis=1)
        two = np.partition(need, 1, axis=1)[:, :2]
        for i, b, (x, y) in zip(part, best, two):
            langs[i], scores[i] = model.langs[b], float(1 - x / max(y, 1))
    return langs, scores


def learn(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_bytes: int = SAMPLE_BYTES, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model of the labelled rows for which ``train`` holds.

    The sample is bounded: ``sample_bytes`` are shared out over the languages, and
    each language's share over about ``sample_docs`` documents chosen by a hash
    of their key, with a window of each at a hashed place.
    """
    rows = docs.where(train & F.col(lang).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(lang).alias("l"), F.col(text).alias("t"))
    counts = {r[0]: r[1] for r in rows.groupBy("l").count().collect()}
    if not counts:
        return Model({})
    share = max(1024, sample_bytes // len(counts))
    window = max(64, share // sample_docs)
    # about twice as many as are needed: some are short; the rest is cut off below
    rate = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, min(1.0, 2 * sample_docs / n))])[F.col("l")]
    draw = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / float(1 << 30)
    begin = F.pmod(F.xxhash64("k", F.lit("place")), F.greatest(F.lit(1), F.length("t") - window)).cast("int") + 1
    found = rows.where((draw < rate) & F.col("t").isNotNull()).select("l", F.xxhash64("k").alias("h"), F.substr("t", begin, F.lit(window)).alias("t")).collect()
    samples: dict[str, bytes] = {x: b"" for x in counts}
    for r in sorted(found, key=lambda r: (r["l"], r["h"], r["t"])):
        if len(samples[r["l"]]) < share:
            samples[r["l"]] += symbols(r["t"])[:window] + b" "
    return Model({k: v[:share] for k, v in samples.items()})


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` of each row with lang_pred and score."""
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            langs, scores = judge(spread.value, x.column(x.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*x.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    rows = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return in_arrow(rows, run, f"{types}, lang_pred string, score double")
