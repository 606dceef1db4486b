"""Session settings the jobs rely on.

A cluster brings its own session; ``tune`` only sets runtime options. ``local_session`` is for
tests and the bench.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME = {
    # results must not depend on the machine's zone
    "spark.sql.session.timeZone": "UTC",
    # run-time re-planning: size-checked broadcasts, skewed join splits, small partition merging
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # one marketplace (or run date) is replaced without touching the others
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = 8, app: str = "offermend", memory: str = "12g") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(os.environ.get("SHUFFLE_PARTITIONS", cpus)))
    )
    for key, value in RUNTIME.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for tables a job writes to cut lineage, named by ``spark.checkpoint.dir``.

    Only a local session, whose tasks all run on this machine, gets one of its own where the setting
    is missing; it is recorded so that later calls agree. A cluster without the setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="offermend-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(frame: DataFrame) -> DataFrame:
    """The frame as a table written once in the shared folder.

    For a result that several later steps read: their work does not repeat what made it, and a lost
    executor costs only its tasks.
    """
    path = f"{shared_folder(frame.sparkSession)}/staged-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
