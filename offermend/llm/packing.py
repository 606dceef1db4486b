"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

``pieces`` tokenises; only a document longer than the capacity is cut. ``place`` packs: items above a
third of the capacity go at most two to a sequence and are matched greedily, the largest with the
largest that still fits, which needs the fewest sequences for such items; the smaller ones follow in
order of size, each into the smallest gap that holds it.

Which item goes where depends only on its length, so the plan is made over the counts per length: at
most ``capacity`` numbers reach the driver, whatever the input. Sequences in the same state are one
range of ids, a step of the plan places a range of ranks of one length, and the number of steps is
bounded by the capacity, not by the rows. Items find their step by their rank among those of their
length. Ranks are counted in salted groups of about ``RANKED_ROWS`` rows, so a length that a third of
all rows share is spread over tasks.

Defined results: null text counts as empty; an empty document is the end id alone; rows that repeat
and null ids are packed like any other; an empty table has an empty result. Only the id and the text are
read, so columns of any other name do not matter; the input must not call its id like a result.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offermend.llm.common import released
from offermend.llm.tokens import Encoder
from offermend.session import staged

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Rows of one length that one window counts.
RANKED_ROWS = 1000
#: Pieces handed on at a time.
SLICE = 500


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False, width: int = 4) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids as little-endian unsigned integers of ``width`` bytes) of each piece of each row."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = Encoder(path), np.array([END_ID], "<u4")
        for batch in batches:
            keys, texts = batch[id_col].tolist(), [t or "" for t in batch[text]]
            rows = []
            for key, ids in zip(keys, enc.encode_all(texts), strict=True):
                ids = np.concatenate([ids, end])
                if with_ids and ids.max() >> 8 * width:
                    raise ValueError(f"the tokenizer has ids that {width} bytes do not hold")
                for piece, first in enumerate(range(0, len(ids), capacity)):
                    part = ids[first:first + capacity]
                    rows.append((key, piece, first, len(part), zlib.crc32(part.tobytes())) + ((part.astype(f"<u{width}").tobytes(),) if with_ids else ()))
                if len(rows) >= SLICE:
                    yield pd.DataFrame(rows, columns=[id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
                    rows = []
            yield pd.DataFrame(rows, columns=[id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.select(id_col, text).mapInPandas(released(cut), schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Steps (length, first rank, first sequence, items per sequence, offset) in order of length and rank."""
    steps: list[tuple[int, int, int, int, int]] = []
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    sequences = 0
    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, sequences), sorted

    def take(length: int, n: int, first: int, per: int, offset: int) -> None:
        steps.append((length, used[length], first, per, offset))
        used[length] += n
        left[length] -= n

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for i, length in enumerate(large):
        while left[length]:
            mate = next((m for m in large[i:] if m + length <= capacity and left[m] > (m == length)), None)
            if mate is None:
                n = left[length]
                take(length, n, sequences, 1, 0)
            elif mate == length:
                n = left[length] // 2
                take(length, 2 * n, sequences, 2, 0)
            else:
                n = min(left[length], left[mate])
                take(length, n, sequences, 1, 0)
                take(mate, n, sequences, 1, length)
            gap = capacity - length - (mate or 0)
            if gap:
                bisect.insort(gaps, (gap, sequences, n))
            sequences += n
    for length in sorted((n for n in left if left[n]), reverse=True):
        while left[length]:
            at = bisect.bisect_left(gaps, (length,))
            if at < len(gaps):
                gap, first, wide = gaps.pop(at)
                per = gap // length  # a gap stays the smallest that fits until it holds no more
                full, rest = divmod(left[length], per)
                n = min(wide, full)
                if n:
                    take(length, n * per, first, per, capacity - gap)
                    if gap - per * length:
                        bisect.insort(gaps, (gap - per * length, first, n))
                if n < wide and rest and n == full:
                    take(length, rest, first + n, rest, capacity - gap)
                    if gap - rest * length:
                        bisect.insort(gaps, (gap - rest * length, first + n, 1))
                    n += 1
                if n < wide:
                    bisect.insort(gaps, (gap, first + n, wide - n))
            else:
                per = capacity // length
                full, rest = divmod(left[length], per)
                for n, held in ((full, per), (min(rest, 1), rest)):
                    if n:
                        take(length, n * held, sequences, held, 0)
                        if capacity - held * length:
                            bisect.insort(gaps, (capacity - held * length, sequences, n))
                        sequences += n
    return sorted(steps)


def place(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The items (a written table with ``length``) with sequence_id and offset.

    Only lengths are read for the plan. Ranks follow a hash of the whole row, so a repeated run of a
    task gives the same ranks; rows that are equal in all columns may trade places.
    """
    known = staged(items.groupBy("length").agg(F.count("*").alias("n")))  # at most ``capacity`` rows
    steps = np.array(plan({int(r["length"]): int(r["n"]) for r in known.collect()}, capacity), dtype=np.int64).reshape(-1, 5)
    told = [c for c in items.columns if c != "ids"]  # ids_crc32 stands for them
    mark = F.xxhash64(*told)
    wide = F.broadcast(known.select(F.col("length").alias("__k"), F.ceil(F.col("n") / RANKED_ROWS).alias("__w")))
    salted = items.join(wide, F.col("length") == F.col("__k")).withColumn("__salt", F.pmod(mark, F.col("__w")).cast("int")).drop("__k", "__w")
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "__salt").agg(F.count("*").alias("n")).withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    offsets = staged(offsets.select(F.col("length").alias("__l"), F.col("__salt").alias("__s"), "__before"))
    order = Window.partitionBy("length", "__salt").orderBy(mark, *told)
    ranked = salted.withColumn("__rank", F.row_number().over(order) - 1)
    ranked = ranked.join(offsets, (F.col("length") == F.col("__l")) & (F.col("__salt") == F.col("__s"))).withColumn("__rank", F.col("__rank") + F.col("__before"))
    key = steps[:, 0] << 44 | steps[:, 1]  # by length, then rank

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(np.int64), batch.pop("__rank").to_numpy(np.int64)
            at = np.searchsorted(key, length << 44 | rank, side="right") - 1
            within, per = rank - steps[at, 1], steps[at, 3]
            yield batch.assign(sequence_id=steps[at, 2] + within // per, offset=steps[at, 4] + within % per * length)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", sequence_id long, offset long"
    return ranked.select(*items.columns, "__rank").mapInPandas(released(look_up), schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False, width: int = 4) -> DataFrame:
    """Tokenise and place every document."""
    return place(staged(pieces(docs, id_col, text, capacity, tokenizer, with_ids, width)), capacity)


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """sequence_id, n_pieces, length, ids and the documents' ids in order of each full sequence; ``packed`` must carry ids. A group is one capacity at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", F.col(id_col).alias("of"))))
    gathered = packed.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("length"))
    ids = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), ""))
    return gathered.select("sequence_id", F.size("p").alias("n_pieces"), "length", ids.alias("ids"), F.transform("p", lambda x: x["of"]).alias(f"{id_col}s"))
