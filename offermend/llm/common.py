"""What several operators share: word rules, hidden column names, connected components."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offermend.session import staged

#: A word is a run without ASCII white space; ``bytes.split()`` cuts the same words.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
LETTER = re.compile(r"[^\W\d_]")

#: Rows of a small table that a broadcast may carry; a larger one is joined by shuffling.
BROADCAST_ROWS = 50_000


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives Arrow's unused memory back when its task ends: workers live on through later stages."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return wrapped


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The staged table with a broadcast hint if its counted rows allow it, else as it is."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge list; component is the smallest node reachable.

    Alternating large and small stars: every node's links are moved to its smallest neighbour until
    nothing changes, in a number of rounds that grows with the logarithm of the longest chain. A
    node's smallest neighbour is an aggregate (combined before the shuffle) joined back to its links,
    so a hub's links are never gathered. Each round is a table in the shared folder; only its row
    count and checksum reach the driver. Self links and repeated links are allowed, null ends are
    ignored.
    """
    high, low = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now = staged(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(high, low).distinct())
    nodes = now.select("u").union(now.select("v")).distinct()
    links = now.where("u <> v")
    mark = None
    while True:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = staged(moved.union(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        seen = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen == mark:
            break
        mark = seen
    return nodes.select(F.col("u").alias("node")).join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def schema_of(frame: DataFrame, columns: list[str]) -> str:
    """The columns' names and types as a schema string."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name in columns)
