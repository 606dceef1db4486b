"""Phrase collocations by SON partitioning: mine shards completely at lowered support, then count exactly.

A shard is what one task reads, in blocks of about ``BLOCK_BYTES`` of text. A language's weight in a
block is its share of that language's bytes; a phrase that occurs ``support`` times in all must, in some
block, occur at least support times the block's weight, rounded up. Blocks are mined at that support, a
length at a time: a phrase of k words is counted only where both its parts of k - 1 words are frequent in
the block. Words are numbers and phrases pairs of numbers there, so a length is one sort.

The union of what blocks find, less what cannot reach the support even with all that blocks may hide, may
grow with the corpus and is never broadcast: it fills a bitmap of at
most ``MOST_BITS`` bits by hash. A second pass counts, in every block, each phrase whose bit is set and
whose parts passed as well. As a phrase passes in all blocks or in none, the sums are exact for false
positives too; what sums below the support goes. The words, the two parts of every cut and the longer
phrases meet by joins on the phrase itself; hashes only decide what is counted.

With a fixed support the local one falls to a single occurrence once the corpus has about ``support``
blocks, and blocks would hand on all their distinct phrases. Where it would be below ``LEAST_LOCAL``, phrases
are found by length instead: a pass counts those whose parts are frequent in all, by a code of 64 bits each, and the codes that reach the support make the bitmap that the next pass and the exact count use.
Phrases of one code are summed together, so none is lost.

Defined results: null text is empty, a null language is ``und`` (together with documents that say so);
texts without words count nothing; ranks within equal score and count follow the phrase's bytes; rows that
repeat count again; an empty table has an empty result. A text longer than a block is a block of its own.
Columns of the input other than text and language are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offermend.llm.common import small, text_or_empty
from offermend.session import staged

SUPPORT, LONGEST, TOP = 100, 5, 2000
BLOCK_BYTES = 48_000_000
#: Below this local support of a block, phrases are found a length at a time.
LEAST_LOCAL = 3
#: Phrases of up to so many words get a pass for each length then.
ALONE = 3
#: Phrases handed on at a time.
SLICE = 100_000
#: Fewer, larger shards than the scan has tasks, down to this number, keep the local support up.
LEAST_SHARDS = 16
#: Bits for each phrase that was found, and of the whole bitmap: 32 MB are the most that is broadcast.
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 1 << 20, 1 << 28
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes.maketrans(bytes(range(65, 91)) + SEPARATORS, bytes(range(97, 123)) + b"." * len(SEPARATORS))
ODD, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: bytes) -> list[bytes]:
    """The words in order; ``.``, which no word holds, ends each piece."""
    return (text.translate(FOLD) + b".").replace(b".", b" . ").split()


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Block:
    """The texts of one language in a block, as numbers of words; 0 is the end of a piece."""

    def __init__(self, texts: list[bytes]):
        numbers = _Numbers({b".": 0})
        self.words = np.concatenate([np.fromiter(map(numbers.__getitem__, words_of(t)), np.int32) for t in texts])
        self.known = list(numbers)

    def phrases(self, passes, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, where one stands, counts) of the distinct phrases that pass; ``passes(k, counts, where)`` is a mask over them.

        Every part of a phrase must pass too: one begins where its two longest parts begin at neighbouring
        words, and the numbers of these make its own.
        """
        at = np.flatnonzero(self.words).astype(np.int32)  # where phrases of the length at hand begin
        number = self.words[at].astype(np.int64)
        for k in range(1, longest + 1):
            if k > 1:
                follows = np.flatnonzero(at[1:] == at[:-1] + 1)
                number = number[follows] * (int(number.max(initial=0)) + 1) + number[follows + 1]
                at = at[follows]
            if not len(at):
                return
            order = np.argsort(number)
            number = number[order]
            first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
            counts = np.diff(np.r_[first, len(number)])
            one = at[order[first]]
            mask = passes(k, counts, one)
            yield k, one[mask], counts[mask]
            number[order] = np.repeat(np.where(mask, np.arange(len(first)), -1), counts)
            at, number = at[number >= 0], number[number >= 0]

    def spelled(self, k: int, where: np.ndarray) -> list[bytes]:
        return [b" ".join([self.known[i] for i in row]) for row in self.words[where[:, None] + np.arange(k)].tolist()]


def _code(hashes: np.ndarray) -> np.ndarray:
    """Codes of 64 bits of phrases given by the hashes of their words, a row each."""
    h = np.zeros(len(hashes), np.uint64)
    for column in hashes.T:
        h = (h ^ column) * ODD
        h ^= h >> np.uint64(32)
    return h * SPREAD


def _shift(bits: int) -> int:
    """By how much a code is shifted to become a place in a bitmap."""
    return 64 - int(math.log2(bits))


def _coded(block: Block):
    """A function of (k, where) that gives the codes of the block's phrases."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, block.known), np.uint64, len(block.known))
    return lambda k, where: _code(hashes[block.words[where[:, None] + np.arange(k)]])


def _through(codes, bitmap: np.ndarray):
    """A function of (k, counts, where) that says which of a block's phrases have their bit set."""
    shift = np.uint64(_shift(8 * len(bitmap)))

    def passes(k: int, _counts, where: np.ndarray) -> np.ndarray:
        out = np.empty(len(where), bool)
        for i in range(0, len(where), SLICE):
            at = (codes(k, where[i:i + SLICE]) >> shift).astype(np.int64)
            out[i:i + SLICE] = bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
        return out

    return passes


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[str, int, int, Block]]:
    """The rows (language, text, total) of a task as (language, bytes, total, block), block after block.

    A full block waits until the next is half full: a short rest, whose local support would be low, joins it.
    """
    full: list[tuple] = []
    now: list[tuple] = []
    held = 0

    def made(rows: list[tuple]) -> Iterator[tuple[str, int, int, Block]]:
        by: dict[str, list[bytes]] = {}
        totals = {}
        while rows:
            lang, text, totals[lang] = rows.pop()
            by.setdefault(lang, []).append(text)
        for lang in list(by):
            texts = by.pop(lang)
            yield lang, sum(map(len, texts)), totals[lang], Block(texts)

    for batch in batches:
        for row in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            now.append(row)
            held += len(row[1])
            if full and 2 * held >= block_bytes:
                yield from made(full)
            if held >= block_bytes:
                full, now, held = now, [], 0
    yield from made(full + now)


def _said(schema: pa.Schema, lang: str, block: Block, k: int, where: np.ndarray, numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(where), SLICE):
        phrases = pa.array(block.spelled(k, where[i:i + SLICE]), pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), phrases, pa.array(numbers[i:i + SLICE], pa.int64())], schema=schema)


def _weighed(docs: DataFrame, text: str, lang: str, block_bytes: int) -> tuple[DataFrame, int]:
    """(lang, text, total bytes of the language), in as few partitions as blocks of that size need, and all bytes."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text).alias("text"))
    totals = staged(rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("total")))
    whole = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    shards = max(LEAST_SHARDS, -(-whole // block_bytes))
    return rows.join(small(totals), "lang").select("lang", "text", "total").coalesce(shards), whole


def mine(weighed: DataFrame, support: int = SUPPORT, longest: int = LONGEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, phrase) of 1 to ``longest`` words that are frequent in some block and may be so in all.

    A block at local support s may hide up to s - 1 occurrences of a phrase it does not report, so what
    reporting blocks count above that, ``over``, must make up for the support less all blocks' s - 1.
    """
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("over", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, weight, total, block in _blocks(batches, block_bytes):
            local = max(1, -(-support * weight // max(1, total)))
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([None], pa.string()), pa.array([local - 1], pa.int64())], schema=schema)
            for k, where, counts in block.phrases(lambda _k, counts, _w, local=local: counts >= local, longest):
                yield from _said(schema, lang, block, k, where, counts - (local - 1))

    found = staged(weighed.mapInArrow(run, "lang string, phrase string, over long").groupBy("lang", "phrase").agg(F.sum("over").alias("over")))
    hidden = found.where(F.col("phrase").isNull()).select("lang", F.col("over").alias("hidden"))
    return found.where(F.col("phrase").isNotNull()).join(small(staged(hidden)), "lang").where(F.col("over") + F.col("hidden") >= support).select("lang", "phrase")


def bitmap_of(found: DataFrame) -> np.ndarray:
    """The bitmap of the phrases found (a written table), as bytes of eight bits, of a bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed: dict[bytes, int] = {}
        for batch in batches:
            by_length: dict[int, list] = {}
            for phrase in batch.column(0).cast(pa.binary()).to_pylist():
                words = phrase.split(b" ")
                for w in words:
                    if w not in hashed:
                        hashed[w] = xxhash.xxh64_intdigest(w)
                by_length.setdefault(len(words), []).append([hashed[w] for w in words])
            if len(hashed) > 500_000:
                hashed.clear()
            for rows_ in by_length.values():
                yield pa.RecordBatch.from_arrays([pa.array(_code(np.array(rows_, np.uint64)).view(np.int64))], names=["code"])

    return _bitmap(found.select("phrase").mapInArrow(run, "code long"), found.count())


def _bitmap(codes: DataFrame, rows: int) -> np.ndarray:
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * rows - 1).bit_length()))
    at = F.shiftrightunsigned("code", _shift(bits)) + 1  # Spark's buckets of 32768 bits begin at 1
    buckets = codes.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    whole = np.zeros(bits // 8, np.uint8)
    for row in buckets.toLocalIterator():  # at most MOST_BITS in all
        start = (row["bucket"] - 1) * 4096
        whole[start:start + 4096] = np.frombuffer(row["bits"], np.uint8)
    return whole


def mine_lengths(weighed: DataFrame, shortest: int, longest: int, bitmap: np.ndarray | None, support: int = SUPPORT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(code) of all phrases of ``shortest`` to ``longest`` words whose code occurs ``support`` times in all, of those
    whose shorter parts the bitmap lets through."""
    shared = weighed.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, block in _blocks(batches, block_bytes):
            codes = _coded(block)
            known = _through(codes, shared.value) if shortest > 1 else None
            passes = lambda k, counts, where, known=known: known(k, counts, where) if k < shortest else np.ones(len(where), bool)
            for k, where, counts in block.phrases(passes, longest):
                for i in range(0, len(where) if k >= shortest else 0, SLICE):
                    yield pa.RecordBatch.from_arrays([pa.array(codes(k, where[i:i + SLICE]).view(np.int64)), pa.array(counts[i:i + SLICE], pa.int64())], names=["code", "n"])

    # a block's codes are distinct, so they are dealt as they are
    found = weighed.mapInArrow(run, "code long, n long").repartition("code").groupBy("code").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= support).select("code")


def bitmap_by_length(weighed: DataFrame, support: int = SUPPORT, longest: int = LONGEST, block_bytes: int = BLOCK_BYTES) -> np.ndarray:
    """The bitmap of all phrases that may be frequent in all, found step by step: a pass hands on a code and a count for
    each phrase of a block whose parts are frequent in all. Phrases of over ``ALONE`` words, which are few, share a pass."""
    found, rows, bitmap = None, 0, None
    steps = [(k, k) for k in range(1, min(ALONE, longest) + 1)] + [(ALONE + 1, longest)] * (longest > ALONE)
    for first, last in steps:
        part = staged(mine_lengths(weighed, first, last, bitmap, support, block_bytes))
        here = part.count()
        if bitmap is not None and not here:
            break
        found, rows = part if found is None else found.union(part), rows + here
        bitmap = _bitmap(found, rows)
    return bitmap


def count(weighed: DataFrame, bitmap: np.ndarray, longest: int = LONGEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, phrase, a): exact occurrences of every phrase the bitmap lets through; a null phrase counts all words."""
    shared = weighed.sparkSession.sparkContext.broadcast(bitmap)
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, _, _, block in _blocks(batches, block_bytes):
            words, passes = block.words, _through(_coded(block), shared.value)
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([None], pa.string()), pa.array([int(np.count_nonzero(words))], pa.int64())], schema=schema)
            for k, where, counts in block.phrases(passes, longest):
                yield from _said(schema, lang, block, k, where, counts)

    return weighed.mapInArrow(run, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def frequent(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, longest: int = LONGEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, phrase, a) of all phrases of 1 to ``longest`` words that occur ``support`` times or more, and a null phrase with all words of the language; a written table."""
    weighed, whole = _weighed(docs, text, lang, block_bytes)
    if support * block_bytes > (LEAST_LOCAL - 1) * whole:
        bitmap = bitmap_of(staged(mine(weighed, support, longest, block_bytes)))
    else:
        bitmap = bitmap_by_length(weighed, support, longest, block_bytes)
    counted = count(weighed, bitmap, longest, block_bytes)
    return staged(counted.where((F.col("a") >= support) | F.col("phrase").isNull()))


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of phrases of two words or more, by their lowest cut, without those that a longer one explains."""
    phrases = counts.where(F.col("phrase").isNotNull())
    total = counts.where(F.col("phrase").isNull()).select("lang", F.col("a").alias("n"))
    words = F.split("phrase", " ")
    longer = phrases.select("lang", "phrase", "a", words.alias("w"), F.size(words).alias("k")).where("k > 1")
    part = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    k, cut = F.col("k"), F.col("cut")
    # a longer phrase as frequent as one inside it is so by way of phrases that are a word longer each
    inside = longer.where("k > 2").select("lang", "a", F.explode(F.array(part(F.lit(1), k - 1), part(F.lit(2), k - 1))).alias("phrase"))
    explained = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    cuts = longer.withColumn("cut", F.explode(F.sequence(F.lit(1), k - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), cut).alias("first"), part(cut + 1, k - cut).alias("rest"))
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    cuts = cuts.join(small(staged(total)), "lang")
    # both products fit 38 digits, and a score 19: 1000 a n / (l r) <= 1000 n / support
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    lowest = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("low")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")
    return best.join(explained, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a").drop("longer")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: every language's first ``top`` phrases."""
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = scored(frequent(docs, text, lang, support, longest, block_bytes)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", F.col("score").cast("long"))
