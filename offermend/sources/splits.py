"""Delimited files with line breaks in their cells, one file read by many tasks.

Spark's line reader hands each byte range of a file to a task. Whether a line begins inside a quoted cell
depends on all that stands before it, but only by one bit: a line maps (outside, inside) to the state it
ends in, and so does a byte range. A first pass works out that map, and how many rows begin, for every
range; the driver chains the maps in file order (a row a range, as many as the scan's own list of ranges);
a second pass, told each range's first state, puts lines together to rows. A row that runs over the end of
a range is put together from its pieces, one or two a range, in a group of its own. Rows carry their number
in file order, and cells are cut by Spark's CSV parser.

Rows end with LF or CRLF. A quote opens a cell only at the cell's start, two quotes are one within it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offermend.functions import ship_by_value

ship_by_value(__name__)

QUOTE = b'"'
#: What the second pass says of a row: it is whole, or one of its pieces.
WHOLE, PIECE = 0, 1


def ends_inside(line: bytes, inside: bool, sep: bytes) -> bool:
    """Whether a quoted cell is open at the end of a line."""
    if QUOTE not in line:
        return inside
    at = 0
    while True:
        if inside:
            close = line.find(QUOTE, at)
            if close < 0:
                return True
            if line[close + 1:close + 2] == QUOTE:
                at = close + 2
                continue
            at, inside = close + 1, False
        elif line[at:at + 1] == QUOTE:
            at, inside = at + 1, True
            continue
        at = line.find(sep, at) + 1  # the next cell
        if at == 0:
            return False


def _blank(line: bytes) -> bool:
    """A line that is no row where it stands between rows."""
    return not line or line == b"\r"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, lineSep="\n")
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def _text(record: bytes) -> str:
    """Without the CR of its line end; bytes that are not UTF-8 are replaced."""
    return record.removesuffix(b"\r").decode("utf-8", "replace")


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[bytes]]]:
    """Runs of lines of one range."""
    for batch in batches:
        files, blocks, lines = (batch.column(i) for i in range(3))
        at = 0
        keys = list(zip(files.to_pylist(), blocks.to_pylist()))
        while at < len(keys):
            stop = at
            while stop < len(keys) and keys[stop] == keys[at]:
                stop += 1
            yield keys[at], lines.slice(at, stop - at).to_pylist()
            at = stop


def block_maps(lines: DataFrame, sep: bytes) -> list[tuple[str, int, bool, bool, int, int]]:
    """(file, block, state at its end if begun outside / inside, rows begun if so) of every byte range, in file order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, states, rows = None, [False, True], [0, 0]

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, *states, *rows)], names=["file", "block", "from_out", "from_in", "rows_out", "rows_in"])

        for key, some in _by_block(batches):
            if key != now:
                if now is not None:
                    yield told()
                now, states, rows = key, [False, True], [0, 0]
            for line in some:
                for i in (0, 1):
                    rows[i] += not states[i] and not _blank(line)
                states = [ends_inside(line, s, sep) for s in states]
        if now is not None:
            yield told()

    found = lines.mapInArrow(run, "file string, block long, from_out boolean, from_in boolean, rows_out long, rows_in long")
    return sorted(tuple(r) for r in found.collect())  # a row a byte range


def chained(maps: list[tuple[str, int, bool, bool, int, int]]) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """(file, block) -> (begins inside, number of the first row that begins in it, number of the file's first row)."""
    out, now, inside, number, first = {}, None, False, 0, 0
    for file, block, from_out, from_in, rows_out, rows_in in maps:
        if file != now:
            now, inside, first = file, False, number
        out[file, block] = (inside, number, first)
        number += rows_in if inside else rows_out
        inside = from_in if inside else from_out
    return out


def rows_of(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """number (in order of file name and row, from 0), in_file (likewise in its file), record: the rows of delimited files as they stand."""
    cut = sep.encode()
    lines = _lines(spark, path)
    begins = spark.sparkContext.broadcast(chained(block_maps(lines, cut)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, held, number, first = None, False, [], 0, 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*[(*r[:4], None if r[0] == WHOLE else r[4], _text(r[4]) if r[0] == WHOLE else None) for r in rows])) or [()] * 6
            kinds = (pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["kind", "number", "in_file", "block", "piece", "record"])

        def open_piece() -> list[tuple]:
            return [(PIECE, number, number - first, now[1], b"\n".join(held))] if held else []

        for key, some in _by_block(batches):
            out = []
            if key != now:
                out += open_piece()
                now, held = key, []
                inside, number, first = begins.value[key]
                carried = inside  # what is held began in an earlier range
                number -= carried
            for line in some:
                if not held and not inside and _blank(line):
                    continue
                held.append(line)
                inside = ends_inside(line, inside, cut)
                if not inside:
                    out.append((PIECE if carried else WHOLE, number, number - first, now[1], b"\n".join(held)))
                    held, carried = [], False
                    number += 1
            yield batch_of(out)
        yield batch_of(open_piece() if now is not None else [])

    made = lines.mapInArrow(run, "kind tinyint, number long, in_file long, block long, piece binary, record string")
    pieces = made.where(F.col("kind") == PIECE).groupBy("number", "in_file").agg(F.array_sort(F.collect_list(F.struct("block", "piece"))).alias("p"))  # one row's

    @F.arrow_udf("string")
    def joined(rows: pa.Array) -> pa.Array:
        return pa.array([_text(b"\n".join([x["piece"] for x in row])) for row in rows.to_pylist()], pa.string())

    return made.where(F.col("kind") == WHOLE).select("number", "in_file", "record").union(pieces.select("number", "in_file", joined("p").alias("record")))
