"""What runs learn, kept by key: changes of each run, snapshots in buckets, one published list of both.

A run writes the rows it learned for all tables into folders of its own and then publishes them with one row, in a
folder of its own too. Readers see published folders only: a failed run changes nothing, several writers at a time
lose nothing, and the tables of one run become visible together. A snapshot folds the changes it names into rows
bucketed by key; readers take one snapshot and the changes that it does not name, so that snapshots made at the same
time as each other or as changes do no harm.

Of several rows of a key the newest counts (learned rules: the oldest), by the clocks of the publishing drivers, then
by the name of the change.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offermend import schemas

STAMP = "learned_at timestamp, change string"
#: table -> (columns after the key, whether the newest row of a key counts)
TABLES = {
    "categories": ("category string", True),
    "attributes": ("attributes map<string,string>", True),
    "done": ("request string, char_name string", True),
    "rules": ("exclude string, category string, ordinal bigint", False),
    "knowledge": (schemas.PRODUCT_KNOWLEDGE, True),
}
CHANGES = "change string, kind string, names array<string>, buckets int, published_at timestamp"


def columns(table: str) -> list[str]:
    return [c.split()[0] for c in TABLES[table][0].split(", ")]


@dataclass(frozen=True)
class Version:
    """What a reader sees: a snapshot with its number of buckets, if there is one, and later changes."""

    snapshot: str | None
    buckets: int
    changes: tuple[str, ...]
    folded: tuple[str, ...]


class Learned:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # ------------------------------------------------------------ versions

    def history(self) -> DataFrame:
        """Published changes and snapshots; empty before the first."""
        try:
            return self.spark.read.schema(CHANGES).parquet(f"{self.root}/published/*")
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            return self.spark.createDataFrame([], CHANGES)

    def version(self) -> Version:
        """The published state; the driver gets one row a run."""
        rows = self.history().collect()
        snapshots = [r for r in rows if r.kind == "snapshot"]
        best = max(snapshots, key=lambda r: (len(r.names), r.published_at, r.change), default=None)
        folded = set(best.names) if best else set()
        open_ = sorted(r.change for r in rows if r.kind == "change" and r.change not in folded)
        return Version(best.change if best else None, best.buckets if best else 0, tuple(open_), tuple(sorted(folded)))

    def _announce(self, change: str, kind: str, names: list[str]) -> None:
        # a list of names may be empty, so it is built from its schema
        row = self.spark.createDataFrame([(change, kind, names, self.buckets, dt.datetime.now(dt.timezone.utc))], CHANGES)
        row.coalesce(1).write.parquet(f"{self.root}/published/{change}")

    def publish(self, tables: dict[str, DataFrame]) -> str:
        """Write the rows of a run, one per key in each table, then show them all at once. Returns the change's name."""
        change = uuid.uuid4().hex
        now = F.lit(dt.datetime.now(dt.timezone.utc))
        for table, rows in tables.items():
            stamped = rows.where("key IS NOT NULL").select("key", *columns(table), now.alias("learned_at"), F.lit(change).alias("change"))
            stamped.write.parquet(self._folder(table, change))
        empty = [t for t in TABLES if t not in tables]
        for table in empty:
            self.spark.createDataFrame([], self._schema(table)).write.parquet(self._folder(table, change))
        self._announce(change, "change", [])
        return change

    def compact(self) -> Version:
        """Fold the published changes into a new snapshot, every table bucketed and sorted by key."""
        now, name = self.version(), uuid.uuid4().hex
        if not now.changes:
            return now
        for table in TABLES:
            rows = self._fold(table, self._all(table, now)).repartition(self.buckets, "key")
            path = self._folder(table, name)
            rows.write.format("parquet").bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(self._registered(path))
        self._announce(name, "snapshot", [*now.folded, *now.changes])
        return self.version()

    # ------------------------------------------------------------ rows

    def _folder(self, table: str, name: str) -> str:
        return f"{self.root}/{table}/{name}"

    @staticmethod
    def _schema(table: str) -> str:
        return f"key string, {TABLES[table][0]}, {STAMP}"

    @staticmethod
    def _registered(path: str) -> str:
        return "learned_" + hashlib.md5(path.encode()).hexdigest()

    def _snapshot(self, table: str, version: Version) -> DataFrame | None:
        if version.snapshot is None:
            return None
        path = self._folder(table, version.snapshot)
        name = self._registered(path)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({self._schema(table)}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {version.buckets} BUCKETS LOCATION '{path}'"
        )
        return self.spark.table(name)

    def _changes(self, table: str, version: Version) -> DataFrame | None:
        if not version.changes:
            return None
        return self.spark.read.schema(self._schema(table)).parquet(*[self._folder(table, c) for c in version.changes])

    def _all(self, table: str, version: Version) -> DataFrame:
        parts = [p for p in (self._snapshot(table, version), self._changes(table, version)) if p is not None]
        if not parts:
            return self.spark.createDataFrame([], self._schema(table))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _fold(self, table: str, rows: DataFrame) -> DataFrame:
        """One row per key, combined before the shuffle."""
        whole = F.struct(*[c for c in rows.columns if c != "key"])
        pick = F.max_by if TABLES[table][1] else F.min_by
        return rows.groupBy("key").agg(pick(whole, F.struct("learned_at", "change")).alias("_r")).select("key", "_r.*")

    def read(self, table: str, version: Version | None = None) -> DataFrame:
        """The whole table, one row per key."""
        return self._fold(table, self._all(table, version or self.version()))

    def lookup(self, table: str, keys: DataFrame, version: Version | None = None) -> DataFrame:
        """The rows of the given keys (key). Only the asked keys move to the snapshot's buckets, its rows stay."""
        now = version or self.version()
        asked = keys.select("key").where("key IS NOT NULL").distinct()
        hits = [p.join(asked, "key", "left_semi") for p in (self._snapshot(table, now), self._changes(table, now)) if p is not None]
        if not hits:
            return self.spark.createDataFrame([], self._schema(table))
        return self._fold(table, hits[0] if len(hits) == 1 else hits[0].unionByName(hits[1]))
