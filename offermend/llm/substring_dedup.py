"""Substring dedup by suffix automata of reference shards.

A window is ``WINDOW`` consecutive words. Its anchor is the smallest hash among its runs of ``GRAM``
words, so equal windows have equal anchors wherever they stand. Anchors that only one document has are
dropped; the windows that keep one are cut into passages (neighbouring windows with the same anchor).
All passages with one anchor form a shard: in order of document id they are streamed through the
suffix automaton of the shard's earlier passages, whose matching statistic says for each word how long
a run ending there has occurred before; runs of ``WINDOW`` words and more are removed, then the passage
joins the reference. A passage equal to an earlier one adds nothing to it.

Sending the automata of all shards to all documents would make every document meet every shard. Here
the anchors tell which shards a document can match, and its passages go only there.

An anchor in more than ``HOT`` documents would make a shard without bound. Its windows become shards of
their own, keyed by the whole window; a task forwards only the first document it meets with each and
removes the others at once, so such a shard has one passage per task. Within that task windows are told
apart by a 128-bit digest of their words, not by an automaton; everywhere else the words decide.

Spans go back to the row they were found in, by id and text: ``row`` is 0, or the hash of the text of a
row without an id, and spreads such rows over tasks; ``mark`` is another hash of the text, checked when
spans are cut out. Rows that share an id are told apart by these; equal rows get equal results.

Defined results: null text has no words; a row without an id counts as the last document; rows that
share an id are not compared with each other; windows are judged on the input, not on what is left; an
empty text, and one of fewer words than a window, loses nothing; a text of any length is read whole; an
empty table has an empty result. Columns other than id and text are ignored, whatever their names. Ids are
integers below 2^63 - 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 13
GRAM = 4
#: Documents that may share an anchor before its windows are kept apart.
HOT = 500
#: Words, and hot windows, that a task remembers before it starts anew.
REMEMBERED = 400_000
LAST = (1 << 63) - 1
#: Characters of text whose anchors are worked out at a time.
SLICE_CHARS = 4_000_000

_ODD = [pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(GRAM)]


class Automaton:
    """Suffix automaton of a growing set of word sequences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _copy(self, of: int, length: int) -> int:
        self.next.append(dict(self.next[of]))
        self.link.append(self.link[of])
        self.length.append(length)
        return len(self.next) - 1

    def _redirect(self, state: int, word, old: int, new: int) -> None:
        while state != -1 and self.next[state].get(word) == old:
            self.next[state][word] = new
            state = self.link[state]

    def _split(self, state: int, word) -> int:
        """The state that stands for exactly the words of ``state`` and then ``word``."""
        target = self.next[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        twin = self._copy(target, self.length[state] + 1)
        self.link[target] = twin
        self._redirect(state, word, target, twin)
        return twin

    def add(self, words: list) -> None:
        last = 0
        for word in words:
            if word in self.next[last]:
                last = self._split(last, word)
                continue
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            made, state = len(self.next) - 1, last
            while state != -1 and word not in self.next[state]:
                self.next[state][word] = made
                state = self.link[state]
            if state != -1:
                self.link[made] = self._split(state, word)
            last = made

    def statistics(self, words: list) -> Iterator[int]:
        """For each word the length of the longest run ending there that some added sequence holds."""
        state, length = 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state].get(word, 0)
            length = length + 1 if state else 0
            yield length


class Hasher(dict):
    """Word -> 64-bit hash; remembers what it has met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def anchors(texts: list[str | None], known: Hasher, window: int = WINDOW) -> list[np.ndarray]:
    """The anchor of each window of each text, as signed longs; all texts at once, their words numbered by Arrow."""
    cut = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pa.array([t or "" for t in texts], pa.large_string())))
    bounds, words = cut.offsets.to_numpy(), cut.flatten()
    empty = np.flatnonzero(pc.binary_length(words).to_numpy() == 0)  # the one word of a blank text
    if len(empty):
        bounds = bounds - np.searchsorted(empty, bounds)
        words = words.filter(pc.greater(pc.binary_length(words), 0))
    numbered = words.dictionary_encode()
    h = np.fromiter((known[w] for w in numbered.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(numbered.dictionary))[numbered.indices.to_numpy()]
    n = max(0, len(h) - GRAM + 1)
    g = np.zeros(n, np.uint64)
    for i, m in enumerate(_ODD):
        g += h[i:i + n] * np.uint64(m)
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    low = g[: max(0, len(h) - window + 1)].copy()
    for i in range(1, window - GRAM + 1):
        np.minimum(low, g[i:i + len(low)], out=low)
    low = low.view(np.int64)
    # windows that reach into the next text are left out
    return [low[a:max(a, b - window + 1)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts of about ``SLICE_CHARS`` characters."""
    at, chars = 0, 0
    for i, t in enumerate(texts):
        if i > at and chars + len(t or "") > SLICE_CHARS:
            yield at, i
            at, chars = i, 0
        chars += len(t or "")
    if at < len(texts):
        yield at, len(texts)


def _all_anchors(texts: list[str | None], known: Hasher, window: int) -> Iterator[np.ndarray]:
    for a, b in _slices(texts):
        yield from anchors(texts[a:b], known, window)


def _distinct(values: np.ndarray) -> np.ndarray:
    if len(values) < 2:
        return values
    return np.unique(values[np.concatenate(([True], values[1:] != values[:-1]))])


def _anchor_rows(rows: DataFrame, window: int) -> DataFrame:
    """(anchor, id, row), once per row and anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hasher()
        for batch in batches:
            found = [_distinct(a) for a in _all_anchors(batch.column(2).to_pylist(), known, window)]
            own = [pa.array(np.repeat(np.array(batch.column(i).to_pylist(), np.int64), [len(f) for f in found])) for i in range(2)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.int64)])), *own], names=["anchor", "id", "row"])

    return rows.select("id", "row", "text").mapInArrow(run, "anchor long, id long, row long")


_PASSAGE = "key long, id long, start int, words binary, stop int, more array<int>, row long, mark long"


def _mark(text: str | None) -> int:
    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) - (1 << 63)


def _passages(rows: DataFrame, window: int) -> DataFrame:
    """Passages (``stop`` null) to their shards, and spans of hot windows (``words`` null) that are settled here.

    A passage that a document repeats goes once; ``more`` holds its other places.

    A task forwards a hot window of the smallest id it has met and settles those of larger ones. Rows come
    sorted by id, so it forwards one document's; in another order it forwards more, with the same result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first = Hasher(), {}
        for batch in batches:
            out: list[tuple] = []
            key_, row_, text_, cold_, hot_ = (batch.column(i).to_pylist() for i in range(5))
            for key, row, text, cold, hot, anchor in zip(key_, row_, text_, cold_, hot_, _all_anchors(text_, known, window), strict=True):
                if not len(anchor):
                    continue
                words = words_of(text)
                is_hot = np.isin(anchor, np.array(hot, np.int64))
                is_cold = np.isin(anchor, np.array(cold, np.int64))
                starts = np.concatenate(([0], np.flatnonzero(np.diff(anchor) != 0) + 1))
                own: dict[tuple[int, bytes], list[int]] = {}  # passages of this document, each once
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(anchor)], strict=True):
                    if is_cold[a]:
                        own.setdefault((int(anchor[a]), b" ".join(words[a:b + window - 1])), []).append(a)
                settled = np.zeros(len(words), bool)
                for a in np.flatnonzero(is_hot).tolist():
                    some = b" ".join(words[a:a + window])
                    mark = hashlib.blake2b(some, digest_size=16).digest()
                    if first.setdefault(mark, key) < key:
                        settled[a:a + window] = True
                    else:
                        first[mark] = key
                        own.setdefault((int.from_bytes(mark[:8], "little", signed=True), some), []).append(a)
                edges = np.flatnonzero(np.diff(np.concatenate(([False], settled, [False]))))
                of = (row, _mark(text))
                out += [(key, key, a, None, b, None, *of) for a, b in edges.reshape(-1, 2).tolist()]
                out += [(shard, key, at[0], some, None, at[1:] or None, *of) for (shard, some), at in own.items()]
                if len(first) > REMEMBERED:
                    first.clear()
            columns = list(zip(*out, strict=True)) or [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "id", "start", "words", "stop", "more", "row", "mark"])

    return rows.select("id", "row", "text", "cold", "hot").mapInArrow(run, _PASSAGE)


def shard_spans(passages: list[tuple[tuple[int, int, int], list[int], bytes]], window: int = WINDOW) -> Iterator[tuple[tuple[int, int, int], int, int]]:
    """((id, row, mark), start, stop) in words of what a shard's passages, ((id, row, mark), starts, words) in order of id, repeat of earlier documents."""
    seen: set[bytes] = set()  # passages of earlier documents
    automaton: Automaton | None = None
    pending: list[list[bytes]] = []  # those not yet in the automaton
    for _, same in groupby(passages, key=lambda p: p[0][0]):
        fresh: list[bytes] = []
        for key, starts, raw in same:
            words = raw.split()
            if raw in seen:
                yield from ((key, at, at + len(words)) for at in starts)
                continue
            fresh.append(raw)
            if not seen:
                continue
            if automaton is None:
                automaton = Automaton()
            for earlier in pending:
                automaton.add(earlier)
            pending.clear()
            begin = stop = -1
            for i, length in enumerate(automaton.statistics(words)):
                if length >= window:
                    if i - window + 1 > stop:
                        if stop >= 0:
                            yield from ((key, at + begin, at + stop) for at in starts)
                        begin = i - window + 1
                    stop = i + 1
            if stop >= 0:
                yield from ((key, at + begin, at + stop) for at in starts)
        pending += [raw.split() for raw in fresh]
        seen.update(fresh)


def _spans(passages: DataFrame, window: int) -> DataFrame:
    """(id, row, mark, start, stop) of all words to remove, shard by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple[tuple[int, int, int], list[int], bytes]] = []
        now = None

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*((*of, a, b) for of, a, b in rows), strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "row", "mark", "start", "stop"])

        for batch in batches:
            out: list[tuple[tuple[int, int, int], int, int]] = []
            for key, one, start, words, stop, more, row, mark in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                of = (one, row, mark)
                if words is None:
                    out.append((of, start, stop))
                    continue
                if key != now:
                    if len(shard) > 1:
                        out += shard_spans(shard, window)
                    shard, now = [], key
                shard.append((of, [start, *(more or ())], words))
            yield made(out)
        if len(shard) > 1:
            yield made(list(shard_spans(shard, window)))

    return passages.repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "id long, row long, mark long, start int, stop int")


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256 (and the kept words as ``kept``)."""
    known = F.col(id_col).cast("long")
    row = F.when(known.isNull(), F.xxhash64(text)).otherwise(F.lit(0))
    rows = docs.select(F.coalesce(known, F.lit(LAST)).alias("id"), row.alias("row"), F.col(text).alias("text"))
    found = _anchor_rows(rows, window)
    # counted where they are dealt: one exchange, one pass over the texts
    shared = found.withColumn("n", F.count("*").over(Window.partitionBy("anchor"))).where("n > 1")
    mine = shared.groupBy("id", "row").agg(F.collect_set(F.when(F.col("n") <= hot, F.col("anchor"))).alias("cold"), F.collect_set(F.when(F.col("n") > hot, F.col("anchor"))).alias("hot"))
    spans = _spans(_passages(rows.join(mine, ["id", "row"]).sortWithinPartitions("id"), window), window).groupBy("id", "row").agg(F.collect_set(F.struct("mark", "start", "stop")).alias("spans"))
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, some in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = words_of(raw)
                keep = np.ones(len(words), bool)
                mark = _mark(raw) if some else 0
                for s in some or ():
                    if s["mark"] == mark:
                        keep[s["start"]:s["stop"]] = False
                kept = b" ".join([words[i] for i in np.flatnonzero(keep).tolist()]) if some else b" ".join(words)
                out.append((len(words), int((~keep).sum()), hashlib.sha256(kept).hexdigest()) + ((kept.decode("utf-8", "replace"),) if with_text else ()))
            columns = list(zip(*out, strict=True)) or [[]] * (3 + with_text)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()][: 3 + with_text]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + with_text])

    done = rows.join(spans, ["id", "row"], "left").select("id", "text", "spans").mapInArrow(run, schema)
    return done.withColumn("id", F.when(F.col("id") != LAST, F.col("id")).cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)
