"""Embedding near-dedup by an epsilon grid order join.

Unit vectors with a cosine of at least ``threshold`` are at most epsilon = sqrt(2 - 2 threshold)
apart. The vectors are turned to their principal axes (of all vectors; the sums are made in the tasks)
and sorted by grid cells of width epsilon along the leading ones. The sorted sequence is cut into
intervals that stay within one cell of the first ``depth`` axes and hold at most ``INTERVAL`` vectors,
each with its bounding box. Consecutive intervals form a group; a group's parts, one per cell, meet
parts of cells next to theirs in an equi-join on the cell, and those whose boxes are provably further
apart than epsilon are skipped. What is left are tiles: two groups each, to which an interval travels
once, whatever number of partners it has there. A group holds about the square root of the number of
intervals (at most ``GROUP``, and ``GROUP_BYTES``), so an interval travels to that many tiles at most
until the bound is reached. In a tile pairs of intervals are joined recursively: halves are compared by
their boxes before any vector is; those out of reach are skipped, those wholly within reach linked by
count, and only small halves between are multiplied out. No pair of vectors leaves the task: per vector
it hands on the number of its links, and a link to the smallest vector of its connected set.

Equal vectors are one vector with a count, so copies of any number cost nothing. ``depth`` follows from
the number of filled cells, so that cells stay small as the data grow; results do not depend on it.

Defined results: null vectors, empty ones, zero ones and those with a null or non-finite component link
with nothing; vectors of other lengths do not link; rows without an id link with nothing; rows that
repeat an id count as copies. An empty table has an empty result. Other columns of the input are not
read, whatever their names; vectors may be of any length (a few intervals of one tile are in memory).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offermend.llm.common import components, schema_of
from offermend.session import staged

THRESHOLD = 0.95
#: Vectors of one interval, and of a half that is multiplied out.
INTERVAL = 1024
LEAF = 256
#: Intervals of one group at most, and bytes of their vectors.
GROUP = 64
GROUP_BYTES = 32 << 20
#: Leading axes whose cells order the sequence, and of which the first ``depth`` are joined on.
AXES = 6
#: Added to epsilon against rounding; every link is decided by its cosine.
SLACK = 1e-6
#: Cosines this close to the threshold are computed again from the vectors as given.
DOUBT = 1e-9


def keyed(vectors: DataFrame, id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id, key (digest of the vector; null if it links with nothing), dim, vector (bytes of its numbers, as wide as given)."""
    kind = vectors.schema[embedding].dataType
    wide = np.float32 if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raws, dims = [], [], []
            for known, v in zip(batch.column(0).is_valid().to_pylist(), batch.column(1), strict=True):
                good = known and v.is_valid and len(v.values) > 0 and v.values.null_count == 0
                x = v.values.to_numpy(zero_copy_only=False).astype(wide) + wide(0) if good else None
                good = good and bool(np.isfinite(x).all()) and bool(x.any())
                raw = x.tobytes() if good else None
                raws.append(raw)
                keys.append(hashlib.blake2b(raw, digest_size=16).digest() if good else None)
                dims.append(len(x) if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())], names=[id_col, "key", "dim", "vector"])

    return vectors.select(id_col, embedding).mapInArrow(run, schema_of(vectors, [id_col]) + ", key binary, dim int, vector binary")


def _numbers(raw: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * rows * dim else np.float64).reshape(rows, dim)


def _unit(given: np.ndarray) -> np.ndarray:
    x = given.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # lengths neither over- nor underflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(distinct: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length the axes as columns, widest first. dim squared numbers reach the driver."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, rows in batch.groupby("dim"):
                x = np.hstack([np.ones((len(rows), 1)), _unit(_numbers(b"".join(rows["vector"]), len(rows), dim))])
                total[dim] = total.get(dim, 0) + x.T @ x
        for dim, m in total.items():
            yield pd.DataFrame({"dim": dim, "i": np.arange(m.size), "x": m.ravel()})

    found: dict[int, dict[int, float]] = {}
    for r in distinct.select("dim", "vector").mapInPandas(sums, "dim int, i int, x double").groupBy("dim", "i").agg(F.sum("x").alias("x")).collect():
        found.setdefault(r["dim"], {})[r["i"]] = r["x"]
    axes = {}
    for dim, cells in found.items():
        m = np.array([cells[i] for i in range((dim + 1) ** 2)]).reshape(dim + 1, dim + 1)
        mean = m[0, 1:] / m[0, 0]
        axes[dim] = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))[1][:, ::-1]
    return axes


def _cells(frame: DataFrame, axes: dict[int, np.ndarray], eps: float) -> DataFrame:
    """The rows with ``cell``, the grid cell on the leading axes."""
    columns = frame.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell = np.empty(len(batch), object)
            for dim, rows in batch.groupby("dim"):
                y = np.floor(_unit(_numbers(b"".join(rows["vector"]), len(rows), dim)) @ axes[dim][:, :AXES] / eps).astype(int)
                for i, c in zip(batch.index.get_indexer(rows.index), y, strict=True):
                    cell[i] = c
            yield batch.assign(cell=cell)

    return frame.mapInPandas(run, schema_of(frame, columns) + ", cell array<int>")


def intervals(sorted_rows: DataFrame, axes: dict[int, np.ndarray], depth: int, together: int = GROUP) -> DataFrame:
    """grp, dim, cell (of the first axes), low, high (bounding box), ids, copies, vectors: pieces of the sorted sequence.

    ``grp`` numbers groups of consecutive pieces, of the vectors of about ``together`` full ones.
    """
    schema = "grp long, dim int, cell array<int>, low array<double>, high array<double>, ids array<long>, copies array<long>, vectors binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        key = None
        grp, taken, size = TaskContext.get().partitionId() << 32, 0, 0

        def close() -> pd.DataFrame:
            nonlocal grp, taken, size
            raw = b"".join(h[2] for h in held)
            if taken and (taken + len(held) > together * INTERVAL or size + len(raw) > GROUP_BYTES):
                grp, taken, size = grp + 1, 0, 0
            taken, size = taken + len(held), size + len(raw)
            y = _unit(_numbers(raw, len(held), key[0])) @ axes[key[0]]
            row = {"grp": grp, "dim": key[0], "cell": list(key[1]), "low": y.min(axis=0), "high": y.max(axis=0), "ids": [h[0] for h in held], "copies": [h[1] for h in held], "vectors": raw}
            held.clear()
            return pd.DataFrame([row])

        for batch in batches:
            for rep, n, dim, cell, vector in batch[["rep", "copies", "dim", "cell", "vector"]].itertuples(index=False):
                now = (dim, tuple(cell[:depth]))
                if held and (now != key or len(held) == INTERVAL):
                    yield close()
                key = now
                held.append((rep, n, vector))
        if held:
            yield close()

    return sorted_rows.mapInPandas(run, schema)


def _parts(blocks: DataFrame) -> DataFrame:
    """grp, dim, cell, low, high: the box of a group's intervals in one cell."""

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        one = rows.iloc[:1].copy()
        one["low"], one["high"] = [np.min(np.stack(rows["low"]), axis=0)], [np.max(np.stack(rows["high"]), axis=0)]
        return one

    schema = "grp long, dim int, cell array<int>, low array<double>, high array<double>"
    return blocks.select("grp", "dim", "cell", "low", "high").groupBy("grp", "dim", "cell").applyInPandas(merged, schema)


def _tiles(parts: DataFrame, eps: float) -> DataFrame:
    """(g, h, grp, dim, cell): the parts that a tile of two groups needs, as their cells touch and their boxes are within epsilon."""
    schema = "grp long, dim int, own array<int>, cell array<int>, low array<double>, high array<double>"

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cells at or after a part's own in the order that its box, grown by epsilon, reaches."""
        for batch in batches:
            out = []
            for grp, dim, cell, low, high in batch[["grp", "dim", "cell", "low", "high"]].itertuples(index=False):
                reached = [((), 0.0)]
                for c, lo, hi in zip(cell, low, high, strict=False):
                    options = ((c - 1, max(0.0, lo - c * eps)), (c, 0.0), (c + 1, max(0.0, (c + 1) * eps - hi)))
                    reached = [((*prefix, k), far + gap * gap) for prefix, far in reached for k, gap in options if far + gap * gap <= eps * eps]
                out += [(grp, dim, cell, list(k), low, high) for k, _ in reached if k >= tuple(cell)]
            yield pd.DataFrame(out, columns=["grp", "dim", "own", "cell", "low", "high"])

    reach = parts.mapInPandas(around, schema).withColumnRenamed("grp", "a")
    there = parts.select(F.col("grp").alias("b"), "dim", "cell", F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    met = reach.join(there, ["dim", "cell"]).where((F.col("cell") != F.col("own")) | (F.col("a") <= F.col("b")))
    gap = lambda lo, hi: F.greatest(lo, hi, F.lit(0.0))
    ways = F.zip_with(F.arrays_zip("low", "high"), F.arrays_zip("low_b", "high_b"), lambda p, q: gap(p["low"] - q["high_b"], q["low_b"] - p["high"]))
    met = met.where(F.aggregate(ways, F.lit(0.0), lambda s, x: s + x * x) <= eps * eps)
    both = F.array(F.struct(F.col("a").alias("grp"), F.col("own").alias("cell")), F.struct(F.col("b").alias("grp"), "cell"))
    needed = met.select(F.least("a", "b").alias("g"), F.greatest("a", "b").alias("h"), "dim", F.explode(both).alias("part"))
    return needed.select("g", "h", F.col("part.grp").alias("grp"), "dim", F.col("part.cell").alias("cell")).distinct()


class _Side:
    """An interval in a tile; ``start`` is the place of its first vector there."""

    def __init__(self, row, axes: dict[int, np.ndarray], start: int):
        self.grp, self.dim, self.start, self.n = row.grp, row.dim, start, len(row.ids)
        self.given = _numbers(row.vectors, self.n, row.dim)
        self.unit = _unit(self.given)
        self.turned = self.unit @ axes[row.dim]
        self.copies = np.asarray(row.copies, np.int64)
        self.boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if (a, b) not in self.boxes:
            part = self.turned[a:b]
            self.boxes[a, b] = part.min(axis=0), part.max(axis=0)
        return self.boxes[a, b]


def _bunches(linked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of each connected set of a matrix of links."""
    left = linked.any(axis=1)
    while left.any():
        rows = np.zeros(len(left), bool)
        rows[left.argmax()] = True
        while True:
            columns = linked[rows].any(axis=0)
            grown = linked[:, columns].any(axis=1)
            if grown.sum() == rows.sum():
                break
            rows = grown
        left &= ~rows
        yield np.flatnonzero(rows), np.flatnonzero(columns)


class _Tile:
    """Counts of links and connected sets over the vectors of a tile."""

    def __init__(self, ids: np.ndarray, threshold: float):
        self.ids, self.threshold = ids, threshold
        self.counts = np.zeros(len(ids), np.int64)
        self.root = list(range(len(ids)))
        reach = math.sqrt(2 - 2 * threshold)
        self.eps, self.sure = reach + SLACK, max(0.0, reach - SLACK)

    def top(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def unite(self, places: np.ndarray) -> None:
        tops = {self.top(i) for i in places.tolist()}
        if len(tops) > 1:
            least = min(tops, key=lambda k: self.ids[k])
            for t in tops:
                self.root[t] = least

    def join(self, x: _Side, y: _Side) -> None:
        """All links between two intervals, or within one, by recursion on their halves."""
        same = x is y
        work = [(0, x.n, 0, y.n)]
        while work:
            a, b, c, d = work.pop()
            if same and a >= d:
                continue
            (lo, hi), (low, high) = x.box(a, b), y.box(c, d)
            gap = np.maximum(0, np.maximum(lo - high, low - hi))
            if gap @ gap > self.eps * self.eps:
                continue
            far = np.maximum(hi - low, high - lo)
            mine, yours = slice(x.start + a, x.start + b), slice(y.start + c, y.start + d)
            diagonal = same and a == c
            if far @ far < self.sure * self.sure:
                self.counts[mine] += y.copies[c:d].sum() - (x.copies[a:b] if diagonal else 0)
                if not diagonal:
                    self.counts[yours] += x.copies[a:b].sum()
                self.unite(np.r_[mine, yours])
            elif b - a > LEAF or d - c > LEAF:
                left = [(a, b)] if b - a <= LEAF else [(a, (a + b) // 2), ((a + b) // 2, b)]
                right = [(c, d)] if d - c <= LEAF else [(c, (c + d) // 2), ((c + d) // 2, d)]
                work += [(*p, *q) for p in left for q in right]
            else:
                linked = self._linked(x, y, a, b, c, d)
                if diagonal:
                    np.fill_diagonal(linked, False)
                self.counts[mine] += linked @ y.copies[c:d]
                if not diagonal:
                    self.counts[yours] += linked.T @ x.copies[a:b]
                if np.count_nonzero(linked) > b - a + d - c:
                    for rows, columns in _bunches(linked):
                        self.unite(np.concatenate([rows + mine.start, columns + yours.start]))
                else:
                    for i, j in np.argwhere(linked):
                        self.unite(np.array([i + mine.start, j + yours.start]))

    def _linked(self, x: _Side, y: _Side, a: int, b: int, c: int, d: int) -> np.ndarray:
        cosine = x.unit[a:b] @ y.unit[c:d].T
        linked = cosine >= self.threshold
        for i, j in np.argwhere(np.abs(cosine - self.threshold) < DOUBT):
            p, q = x.given[a + i].astype(np.float64), y.given[c + j].astype(np.float64)
            linked[i, j] = p @ q / (math.sqrt(p @ p) * math.sqrt(q @ q)) >= self.threshold
        return linked


def links(blocks: DataFrame, axes: dict[int, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """(node, links, root): per tile how many vectors (copies counted) a vector links to there, and one it is connected with."""
    tiles = _tiles(staged(_parts(blocks)), math.sqrt(2 - 2 * threshold) + SLACK)
    members = blocks.select("grp", "dim", "cell", "ids", "copies", "vectors").join(tiles, ["grp", "dim", "cell"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        g, h = rows["g"].iloc[0], rows["h"].iloc[0]
        ids = np.concatenate([np.asarray(r, np.int64) for r in rows["ids"]])
        starts = np.cumsum([0, *map(len, rows["ids"])])
        sides = [_Side(r, axes, s) for r, s in zip(rows.itertuples(index=False), starts.tolist(), strict=False)]
        tile = _Tile(ids, threshold)
        for i, x in enumerate(sides):
            for y in sides[i:] if g == h else sides:
                if x.dim == y.dim and x.grp == g and y.grp == h:
                    tile.join(x, y)
        some = np.flatnonzero(tile.counts)
        return pd.DataFrame({"node": ids[some], "links": tile.counts[some], "root": ids[np.array([tile.top(i) for i in some.tolist()], int)]})

    return members.select("g", "h", "grp", "dim", "ids", "copies", "vectors").groupBy("g", "h").applyInPandas(run, "node long, links long, root long")


def classes(vectors: DataFrame, id_col: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    eps = math.sqrt(2 - 2 * threshold) + SLACK
    rows = staged(keyed(vectors, id_col, embedding))
    good = rows.where(F.col("key").isNotNull())
    distinct = staged(good.groupBy("key").agg(F.min(id_col).alias("rep"), F.count("*").alias("copies"), F.min("dim").alias("dim"), F.min("vector").alias("vector")))
    axes = principal_axes(distinct)
    celled = staged(_cells(distinct.select("rep", "copies", "dim", "vector"), axes, eps))
    filled = celled.agg(F.count("*").alias("n"), *[F.approx_count_distinct(F.slice("cell", 1, d)).alias(f"d{d}") for d in range(1, AXES + 1)]).first()
    depth = next((d for d in range(1, AXES + 1) if filled["n"] <= INTERVAL * filled[f"d{d}"]), AXES)
    in_order = celled.repartitionByRange("dim", "cell", "rep").sortWithinPartitions("dim", "cell", "rep")
    together = min(GROUP, max(1, round(math.sqrt(filled["n"] / INTERVAL))))
    blocks = staged(intervals(in_order, axes, depth, together))
    found = staged(links(blocks, axes, threshold))
    counts = found.groupBy(F.col("node").alias("rep")).agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = distinct.select("key", "rep", "copies").join(counts, "rep", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    known = staged(known.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    alone = rows.where(F.col("key").isNull()).select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"), F.lit(True).alias("kept"))
    return good.select(id_col, "key").join(known, "key").select(id_col, "n_links", "component_id", (F.col(id_col) == F.col("component_id")).alias("kept")).union(alone)
