"""Stored tables: reference data per marketplace, runs, logs, retention.

Every table is Parquet (logs: JSON) under one root. Reference tables are partitioned by marketplace
and import run; a reader follows the latest published run, so the three tables of an import become
visible together and a failed import is never seen.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offermend import schemas
from offermend.operators.validation import latest_import

REFERENCE = ("categories", "characteristics", "characteristic_values")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ------------------------------------------------------------ plain tables

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read(self, table: str) -> DataFrame:
        """A table, empty with its schema when nothing is stored yet."""
        schema = schemas.TABLES.get(table)
        try:
            reader = self.spark.read.schema(schema) if schema else self.spark.read
            return reader.parquet(self.path(table))
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in str(exc) or schema is None:
                raise
            return self.spark.createDataFrame([], schema)

    def append(self, table: str, rows: DataFrame, *partition_by: str) -> None:
        rows.write.mode("append").partitionBy(*partition_by).parquet(self.path(table))

    # ------------------------------------------------------------ reference tables

    def replace_marketplace(self, marketplace_id: str, run_id: str, tables: dict[str, DataFrame]) -> None:
        """Write one run's three tables; other marketplaces are untouched. Repeating it is harmless:
        only this run's partitions are overwritten. The run shows once it is published."""
        for name in REFERENCE:
            rows = tables[name].withColumn("marketplace_id", F.lit(marketplace_id)).withColumn("import_run_id", F.lit(run_id))
            rows.withColumn("created_at", F.current_timestamp()).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy("marketplace_id", "import_run_id").parquet(self.path(name))

    def log_run(self, marketplace_id: str, run_id: str, status: str, source_type: str = "", notes: str | None = None) -> None:
        """Append a state of an import run; ``completed`` publishes it."""
        row = self.spark.range(1).select(
            F.lit(run_id).alias("import_run_id"), F.lit(marketplace_id).alias("marketplace_id"), F.lit(source_type).alias("source_type"),
            F.lit(status).alias("status"), F.lit(notes).cast("string").alias("notes"), F.current_timestamp().alias("logged_at"),
        )
        self.append("import_runs", row)

    def published_run(self, marketplace_id: str) -> str | None:
        latest = latest_import(self.read("import_runs").where(F.col("marketplace_id") == marketplace_id)).first()
        return latest["import_run_id"] if latest else None

    def load_marketplace(self, marketplace_id: str) -> dict[str, DataFrame]:
        """The three tables of the published run; both filters prune partitions."""
        run_id = self.published_run(marketplace_id)
        pick = (F.col("marketplace_id") == marketplace_id) & (F.col("import_run_id") == (run_id or ""))
        return {name: self.read(name).where(pick) for name in REFERENCE}

    def clear_marketplace(self, marketplace_id: str) -> None:
        """Nothing of the marketplace is readable afterwards: its runs are withdrawn, then its
        partitions go, so that no reader is led to files that are being deleted."""
        self.log_run(marketplace_id, f"cleared-{dt.datetime.now().timestamp()}", "completed", "clear")
        for name in REFERENCE:
            self._drop_partitions(name, f"marketplace_id={marketplace_id}")

    def _drop_partitions(self, table: str, partition: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path(table)}/{partition}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    # ------------------------------------------------------------ registry

    def upsert_marketplace(self, marketplace_id: str, name: str) -> None:
        """Insert or update one registry row; rows are appended and the newest per id counts."""
        row = self.spark.range(1).select(
            F.lit(marketplace_id).alias("marketplace_id"), F.lit(name).alias("marketplace_name"), F.lit(True).alias("is_active"),
            F.current_timestamp().alias("updated_at"),
        )
        self.append("marketplaces", row)

    def marketplaces(self) -> DataFrame:
        rows = self.read("marketplaces")
        newest = F.max_by(F.struct(*[c for c in rows.columns if c != "marketplace_id"]), F.struct("updated_at", "marketplace_name"))
        return rows.groupBy("marketplace_id").agg(newest.alias("r")).select("marketplace_id", "r.*")

    # ------------------------------------------------------------ runs and logs

    def save_run(self, results: DataFrame, marketplace: str, run_id: str) -> None:
        """Store the results of a run; saving it again replaces it. A row in ``run_index`` announces it."""
        rows = results.withColumn("marketplace", F.lit(marketplace)).withColumn("run_id", F.lit(run_id)).withColumn("run_ts", F.current_timestamp())
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("marketplace", "run_id").parquet(self.path("process_runs"))
        entry = self.spark.range(1).select(F.lit(marketplace).alias("marketplace"), F.lit(run_id).alias("run_id"), F.current_timestamp().alias("run_ts"))
        self.append("run_index", entry)

    def last_run(self, marketplace: str) -> DataFrame:
        """The newest run's results: found in the index, read from its own partition."""
        newest = self.read("run_index").where(F.col("marketplace") == marketplace).agg(F.max_by("run_id", "run_ts").alias("run_id")).first()["run_id"]
        runs = self.spark.read.parquet(self.path("process_runs"))
        return runs.where((F.col("marketplace") == marketplace) & (F.col("run_id") == F.lit(newest)))

    def write_run_log(self, rows: DataFrame, run_id: str) -> None:
        """Run log as JSON under its day and run: old days can be let go whole, one run is read alone."""
        rows.withColumn("run_id", F.lit(run_id)).withColumn("logged_at", F.current_timestamp()).withColumn(
            "day", F.current_date()
        ).write.mode("append").partitionBy("day", "run_id").json(self.path("run_logs"))

    def list_logs(self) -> DataFrame:
        """run_id, logged_at and rows of every stored log, newest first."""
        logs = self.spark.read.schema("logged_at string, day date, run_id string").json(self.path("run_logs"))
        return logs.groupBy(F.col("run_id").cast("string").alias("run_id")).agg(F.max("logged_at").alias("logged_at"), F.count("*").alias("entries")).orderBy(F.desc("logged_at"))

    def read_log(self, run_id: str, schema: str | None = None) -> DataFrame:
        """Rows of a stored log. Without a ``schema`` (``schemas.RUN_LOG`` for logs of repairs) all logs are read once more
        beforehand for their columns."""
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.json(self.path("run_logs")).where(F.col("run_id") == run_id)

    def expire(self, table: str, max_age_days: int, today: dt.date | None = None) -> list[str]:
        """Drop the day partitions older than ``max_age_days``; returns the days dropped."""
        oldest = (today or dt.date.today()) - dt.timedelta(days=max_age_days)
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path(table))
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        dropped = []
        for status in fs.listStatus(root) if fs.exists(root) else []:
            name = status.getPath().getName()
            if name.startswith("day=") and dt.date.fromisoformat(name[4:]) < oldest:
                fs.delete(status.getPath(), True)
                dropped.append(name[4:])
        return sorted(dropped)


# ---------------------------------------------------------------- folders


def write_reference_set(tables: dict[str, DataFrame], folder: str) -> None:
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_reference_set(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet") for name in ("categories", "characteristics", "values")}


def discover_marketplaces(spark: SparkSession, folder: str, registry: DataFrame) -> DataFrame:
    """Folders that hold all three Parquet sets, with whether the registry knows their name.

    Only path names are listed on the driver.
    """
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    complete = []
    for status in fs.listStatus(root):
        sub = status.getPath()
        wanted = [jvm.org.apache.hadoop.fs.Path(sub, f"{n}.parquet") for n in ("categories", "characteristics", "values")]
        if status.isDirectory() and all(fs.exists(p) for p in wanted):
            complete.append((sub.getName(),))
    found = spark.createDataFrame(complete, "marketplace_name string")
    known = registry.select("marketplace_name").distinct().withColumn("registered", F.lit(True))
    return found.join(known, "marketplace_name", "left").withColumn("registered", F.coalesce("registered", F.lit(False)))


def reconcile_counts(source: DataFrame, target: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Counts (what, n) before and after a move: categories must agree, values within 5 %."""
    both = source.select("what", F.col("n").alias("source")).join(target.select("what", F.col("n").alias("target")), "what", "full").na.fill(0)
    apart = F.abs(F.col("target") - F.col("source")) / F.nullif(F.col("source"), F.lit(0))
    ok = F.when(F.col("what") == "values", F.coalesce(apart <= tolerance, F.col("target") == 0)).otherwise(
        (F.col("source") == F.col("target")) | (F.col("what") != "categories")
    )
    return both.withColumn("ok", ok)
