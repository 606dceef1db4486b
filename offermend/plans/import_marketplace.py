"""Import of a marketplace's three reference tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offermend.functions.text import norm_id, strip
from offermend.operators.validation import enrich_values, remap_external_ids, validate_reference
from offermend.session import staged
from offermend.sources.store import Store


def prepare_reference(categories: DataFrame, characteristics: DataFrame, enriched: DataFrame) -> dict[str, DataFrame]:
    """Tables as they are stored: ids normalised, external category ids replaced, empty values left
    out. ``enriched``: values with their gaps filled."""
    kept = enriched.where(strip(F.coalesce("value", F.lit(""))) != "").withColumn("value", strip("value"))
    return {
        "categories": categories.withColumn("category_id", norm_id("category_id")).withColumn("external_id", norm_id("external_id")),
        "characteristics": remap_external_ids(characteristics, categories),
        "characteristic_values": remap_external_ids(kept, categories),
    }


def import_marketplace(
    store: Store, marketplace_id: str, categories: DataFrame, characteristics: DataFrame, values: DataFrame, source_type: str = "files"
) -> str:
    """Validate and publish one marketplace's tables; returns the run id.

    A run that fails leaves its message in ``import_runs`` and the earlier import in place.
    """
    run_id = str(uuid.uuid4())
    store.log_run(marketplace_id, run_id, "started", source_type)
    try:
        enriched = staged(enrich_values(values, characteristics))
        issues = validate_reference(categories, characteristics, enriched)
        issues = issues.withColumn("import_run_id", F.lit(run_id)).withColumn("marketplace_id", F.lit(marketplace_id))
        store.append("import_issues", issues.select("import_run_id", "marketplace_id", "severity", "issue_type", "entity_type", "entity_id", "message"))
        store.replace_marketplace(marketplace_id, run_id, prepare_reference(categories, characteristics, enriched))
    except Exception as exc:
        store.log_run(marketplace_id, run_id, "failed", source_type, str(exc)[:2000])
        raise
    store.log_run(marketplace_id, run_id, "completed", source_type)
    return run_id
