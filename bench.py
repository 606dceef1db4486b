"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    from pyspark.sql import functions as F

    from offermend.operators import matching
    from offermend.plans import registry, runs
    from offermend.plans.fixtures import reference
    from offermend.plans.import_marketplace import import_marketplace
    from offermend.session import local_session
    from offermend.sources.store import Store

    spark = local_session(CPUS)
    times: dict[str, float] = {}
    info: dict[str, float] = {}

    def timed(name, work):
        start = time.time()
        out = work()
        times[name] = round(time.time() - start, 3)
        return out

    sink = lambda frame: frame.write.format("noop").mode("overwrite").save()

    fx, index = timed("reference_index", lambda: _warm(reference(spark, SF_DIR)))
    store = Store(spark, tempfile.mkdtemp(prefix="offermend-bench-"))

    # values import: every lineitem as a value row of its part's attribute
    line = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    part = spark.read.parquet(f"{SF_DIR}/part.parquet")
    characteristics = part.select(
        F.col("p_partkey").cast("string").alias("characteristic_id"), F.col("p_partkey").cast("string").alias("external_characteristic_id"),
        F.concat(F.lit("c"), F.substring(F.md5("p_type"), 1, 6)).alias("category_id"), F.col("p_name").alias("characteristic_name"),
        (F.col("p_size") % 2 == 0).alias("mandatory"), F.lit(True).alias("restrictive"), F.col("p_partkey").alias("ordinal"),
    )
    values = line.select(
        F.when(F.col("l_linenumber") % 2 == 0, F.lit("gap")).alias("category_id"), F.col("l_partkey").cast("string").alias("characteristic_id"),
        F.lit(None).cast("string").alias("characteristic_name"), F.concat_ws("-", "l_shipdate", "l_quantity").alias("value"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"),
    )
    categories = fx["fx_categories"].withColumn("parent_category_id", F.lit(None).cast("string"))
    timed("import_marketplace", lambda: import_marketplace(store, "bench", categories, characteristics, values))
    info["import_rows"] = line.count()
    info["import_rows_per_sec"] = round(info["import_rows"] / times["import_marketplace"])

    timed("resolve_category", lambda: sink(matching.resolve_categories(fx["fx_offers"], index)))
    timed("validate_gate", lambda: sink(registry.QUERIES["validate_gate"](spark, SF_DIR)))
    timed("detect_attributes", lambda: sink(registry.QUERIES["detect_attributes"](spark, SF_DIR)))
    results = timed("process_offers", lambda: runs.saved_run(spark, SF_DIR))
    info["offers"] = results.count()
    info["offers_per_sec"] = round(info["offers"] / times["process_offers"])
    for name in ("run_kpis", "export_attributes", "telemetry_summary", "knowledge_upsert", "palette_color", "norm_text"):
        timed(name, lambda name=name: sink(registry.QUERIES[name](spark, SF_DIR)))
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "offer_repair_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")), **info}))
    spark.stop()


def _warm(pair):
    for frame in pair[1].frames():
        frame.count()
    return pair


if __name__ == "__main__":
    main()
