"""Incremental runs: offers as they arrive, and telemetry as it is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from offermend import schemas
from offermend.operators.indexes import ReferenceIndex
from offermend.plans.process_offers import Options, process_offers


def offer_stream(spark: SparkSession, folder: str, schema: str = schemas.OFFERS, files_per_batch: int = 25) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def process_offers_stream(
    offers: DataFrame, index: ReferenceIndex, out: str, checkpoint: str, options: Options | None = None, available_now: bool = True
) -> StreamingQuery:
    """Repair each micro-batch and add it to ``out``.

    A batch lands under its own ``batch_id`` partition, which a repeated batch overwrites, so a run
    that is cut off resumes from its checkpoint without losing or doubling offers.
    """

    index = index.stored()

    def repair(batch: DataFrame, batch_id: int) -> None:
        results = process_offers(batch.withColumn("existing_chars", F.coalesce("existing_chars", F.create_map().cast("map<string,string>"))), index, options)
        results.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out)

    writer = offers.writeStream.foreachBatch(repair).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def log_stream(events: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append events as JSON lines under their day; retention drops whole days."""
    rows = events.withColumn("day", F.to_date("ts"))
    writer = rows.writeStream.format("json").outputMode("append").partitionBy("day").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
