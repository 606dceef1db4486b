"""Line dedup: a line that documents share stays in the smallest document only.

Every line long enough travels as a 128-bit digest of its key with its document and position, never as
text. The digests are dealt by range over (digest, document, position) and sorted alike, so a line that a
third of all documents hold is cut into as many partitions as its rows need. Each partition is streamed:
the first document met with a digest keeps its lines, all later ones lose theirs. Only a partition's first
digest may have begun in an earlier partition: rows of that digest's first document wait for the smallest
document among the partitions' border digests, at most two rows a partition, which are broadcast. What a
document loses comes back as one compressed bitmap (run lengths of kept and dropped lines), and the texts
are cut where they are read.

Defined results: a null or empty text is one empty line. Keys of fewer than ``shortest`` code points, so
all blank lines, stay. A document's own repeats stay with its first occurrence or go with it. Rows that
share an id are one document: a line in several of them is no repeat; rows without an id are one document
behind all others. Equal rows have equal results. An empty table has an empty result. A text of any length
is split in the task that reads it. Columns ``n_lines`` and ``n_dropped`` of the input are replaced, all
others pass through; names that start with ``__line`` are reserved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offermend.llm.common import text_or_empty
from offermend.session import staged

SHORTEST = 10
BLANK = b" \t\n\x0b\x0c\r"
#: What the streamed pass says of a row: it loses its line; it waits for the borders; it is a border.
LOSES, WAITS, BORDER = 0, 1, 2


def key_of(line: bytes, shortest: int = SHORTEST) -> bytes | None:
    """The key that lines are compared by, None where it is too short."""
    key = line.strip(BLANK).lower()  # of bytes: only A-Z
    if len(key) < shortest or (len(key) < 4 * shortest and len(key.decode()) < shortest):
        return None
    return key


def _row_key(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Rows with their id and a hash of their text, which together tell rows apart whose results differ."""
    return docs.withColumns({"__line_id": F.col(id_col), "__line_tag": F.xxhash64(text_or_empty(text))})


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """__line_id, __line_tag, pos, hi, lo of every line whose key is long enough."""
    rows = _row_key(docs, id_col, text).select("__line_id", "__line_tag", text_or_empty(text).alias("x"))
    kind = rows.schema["__line_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, pos, out = [], [], []
            for i, text_ in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                for p, line in enumerate(text_.split(b"\n")):
                    key = key_of(line, shortest)
                    if key is not None:
                        of.append(i)
                        pos.append(p)
                        out.append(hashlib.blake2b(key, digest_size=16).digest())
            both = np.frombuffer(b"".join(out), "<i8").reshape(-1, 2)
            at = pa.array(of, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(pos, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["__line_id", "__line_tag", "pos", "hi", "lo"])

    return rows.mapInArrow(run, f"__line_id {kind}, __line_tag long, pos int, hi long, lo long")


def _differs(ids: pa.Array) -> np.ndarray:
    """Whether each id but the first differs from the one before it; nulls are equal to each other."""
    a, b = ids.slice(1), ids.slice(0, len(ids) - 1)
    unlike = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(unlike, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition sorted by digest, document, position: what is lost, what waits, and the borders."""
    names = ["kind", "__line_id", "__line_tag", "pos", "hi", "lo"]

    def said(kind: int, batch: pa.RecordBatch, at: np.ndarray, with_digest: bool) -> pa.RecordBatch:
        rows = batch.take(pa.array(at))
        n = len(at)
        digest = [rows.column(3), rows.column(4)] if with_digest else [pa.nulls(n, pa.int64())] * 2
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), *rows.columns[:3], *digest], names=names)

    last = None  # the last row so far
    head = None  # the first row of the digest at hand
    lost, first_digest = False, True
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is None:
            yield said(BORDER, batch, np.array([0]), True)
        joined = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        hi, lo, tag, pos = (joined.column(c).to_numpy() for c in (3, 4, 1, 2))
        group = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        doc = _differs(joined.column(0)) & ~group
        same = ~group & ~doc & (tag[1:] == tag[:-1]) & (pos[1:] == pos[:-1])
        if last is None:  # the very first row begins a digest
            group, doc, same = np.r_[True, group], np.r_[False, doc], np.r_[False, same]
        seen = np.cumsum(doc)
        start = np.maximum.accumulate(np.where(group, np.arange(len(group)), -1))
        later = seen - np.where(start >= 0, seen[start], -int(lost)) > 0
        begun = group.copy()
        if last is None:
            begun[0] = False
        open_ = first_digest & (np.cumsum(begun) == 0)
        loses = np.flatnonzero(later & ~same)
        if len(loses):
            yield said(LOSES, batch, loses, False)
        waits = np.flatnonzero(open_ & ~later & ~same)
        if len(waits):
            yield said(WAITS, batch, waits, True)
        if start[-1] >= 0:
            head = batch.slice(int(start[-1]), 1)
        lost, first_digest, last = bool(later[-1]), bool(open_[-1]), batch.slice(batch.num_rows - 1, 1)
    if head is not None:
        yield said(BORDER, head, np.array([0]), True)


def runs_of(dropped: list[int]) -> bytes:
    """A sorted list of dropped positions as run lengths of kept and dropped lines in turn, seven bits a byte."""
    out, at, i = bytearray(), 0, 0
    while i < len(dropped):
        j = i + 1
        while j < len(dropped) and dropped[j] == dropped[j - 1] + 1:
            j += 1
        for run in (dropped[i] - at, j - i):
            while run >= 128:
                out.append(run & 127 | 128)
                run >>= 7
            out.append(run)
        at, i = dropped[j - 1] + 1, j
    return bytes(out)


def kept_lines(lines: list, bitmap: bytes | None) -> list:
    """The lines that a bitmap keeps; what follows its last run stays."""
    if not bitmap:
        return lines
    out, at, run, shift, keep = [], 0, 0, 0, True
    for byte in bitmap:
        run |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            if keep:
                out += lines[at:at + run]
            at, run, shift, keep = at + run, 0, 0, not keep
    return out + lines[at:]


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """__line_id, __line_tag, n_dropped, keep of every document that loses a line."""
    order = ("hi", "lo", F.col("__line_id").asc_nulls_last(), "__line_tag", "pos")
    found = digests(docs, id_col, text, shortest)
    dealt = found.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "kind tinyint, " + ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in ("__line_id", "__line_tag", "pos", "hi", "lo"))
    told = staged(dealt.mapInArrow(_first_occurrences, schema))
    # at most two border rows a partition
    least = told.where(F.col("kind") == BORDER).groupBy("hi", "lo").agg(F.min("__line_id").alias("least"))
    settled = told.where(F.col("kind") == WAITS).join(F.broadcast(least), ["hi", "lo"]).where(~F.col("__line_id").eqNullSafe(F.col("least")))
    lost = told.where(F.col("kind") == LOSES).select("__line_id", "__line_tag", "pos").union(settled.select("__line_id", "__line_tag", "pos"))
    gathered = lost.groupBy("__line_id", "__line_tag").agg(F.array_sort(F.collect_set("pos")).alias("p"))  # one document's lines

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drops = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(d) for d in drops], pa.int64()), pa.array([runs_of(d) for d in drops], pa.binary())], names=["__line_id", "__line_tag", "n_dropped", "keep"])

    kind = found.schema["__line_id"].dataType.simpleString()
    return gathered.mapInArrow(pack, f"__line_id {kind}, __line_tag long, n_dropped long, keep binary")


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """The rows with the lines that stay as their text, and n_lines and n_dropped."""
    bitmaps = keep_bitmaps(docs, id_col, text, shortest).withColumnsRenamed({"__line_id": "__line_i", "__line_tag": "__line_t", "n_dropped": "__line_n", "keep": "__line_keep"})
    others = [c for c in docs.columns if c not in (text, "n_lines", "n_dropped")]
    rows = _row_key(docs.select(*[F.col(f"`{c}`") for c in others], text_or_empty(text).alias("__line_x")), id_col, "__line_x")
    joined = rows.join(bitmaps, F.col("__line_id").eqNullSafe(F.col("__line_i")) & (F.col("__line_tag") == F.col("__line_t")), "left")
    n_lines = (F.octet_length("__line_x") - F.octet_length(F.replace("__line_x", F.lit("\n"))) + 1).cast("long")

    @F.arrow_udf("string")
    def cut(texts: pa.Array, keep: pa.Array) -> pa.Array:
        return pa.array([t if k is None else "\n".join(kept_lines(t.split("\n"), k)) for t, k in zip(texts.to_pylist(), keep.to_pylist(), strict=True)], pa.string())

    kept = {text: cut("__line_x", "__line_keep")}
    columns = [kept[c].alias(c) if c in kept else F.col(f"`{c}`") for c in docs.columns if c in kept or c in others]
    return joined.select(*columns, n_lines.alias("n_lines"), F.coalesce("__line_n", F.lit(0)).cast("long").alias("n_dropped"))
