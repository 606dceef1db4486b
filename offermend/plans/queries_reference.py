"""Queries over the reference tables: defects, repairs, lookup tables, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from offermend.operators import indexes, validation
from offermend.plans.check_sql import REFERENCE, VIEWS, with_views
from offermend.plans.fixtures import reference
from offermend.plans.registry import query

REF = ("fx_categories", "fx_characteristics", "fx_values")


def _gaps(fx):
    """Values of every third ordinal without category and name, as an incomplete file has them."""
    gap = F.col("ordinal") % 3 == 0
    return fx["fx_values"].withColumn("category_id", F.when(~gap, F.col("category_id"))).withColumn(
        "characteristic_name", F.when(~gap, F.col("characteristic_name"))
    )


GAPS = (
    "SELECT CASE WHEN ordinal % 3 <> 0 THEN category_id END AS category_id, characteristic_id, "
    "CASE WHEN ordinal % 3 <> 0 THEN characteristic_name END AS characteristic_name, value, ordinal FROM fx_values"
)


@query(
    with_views(*REF, gaps=GAPS)
    + "SELECT coalesce(g.category_id, h.category_id) AS category_id, g.characteristic_id, "
    "coalesce(g.characteristic_name, h.characteristic_name) AS characteristic_name, g.value "
    "FROM gaps g LEFT JOIN fx_characteristics h USING (characteristic_id)"
)
def enrich_values(spark, sf_dir):
    fx, _ = reference(spark, sf_dir)
    rows = validation.enrich_values(_gaps(fx), fx["fx_characteristics"])
    return rows.select("category_id", "characteristic_id", "characteristic_name", "value")


@query(
    with_views(*REF)
    + "SELECT h.characteristic_id, h.category_id FROM fx_characteristics h"
)
def remap_external_ids(spark, sf_dir):
    """Attributes given by external category ids get the internal ones back."""
    fx, _ = reference(spark, sf_dir)
    outside = fx["fx_characteristics"].join(fx["fx_categories"].select("category_id", "external_id"), "category_id")
    outside = outside.withColumn("category_id", F.when(F.col("ordinal") % 2 == 0, F.col("external_id")).otherwise(F.col("category_id"))).drop("external_id")
    return validation.remap_external_ids(outside, fx["fx_categories"]).select("characteristic_id", "category_id")


@query(with_views(*REF) + "SELECT category_id, external_id AS join_id FROM fx_categories")
def join_id(spark, sf_dir):
    fx, _ = reference(spark, sf_dir)
    return indexes.category_joins(fx["fx_categories"])


@query(
    with_views(*REF)
    + "SELECT characteristic_id, characteristic_name FROM fx_characteristics WHERE ordinal % 5 = 0"
)
def orphan_characteristics(spark, sf_dir):
    fx, _ = reference(spark, sf_dir)
    lost = F.when(F.col("ordinal") % 5 == 0, F.concat(F.lit("lost-"), "category_id")).otherwise(F.col("category_id"))
    rows = validation.orphan_characteristics(fx["fx_characteristics"].withColumn("category_id", lost), fx["fx_categories"])
    return rows.select("characteristic_id", "characteristic_name")


@query(with_views(*REF) + "SELECT DISTINCT characteristic_name FROM fx_values WHERE characteristic_name NOT IN (SELECT characteristic_name FROM fx_characteristics)")
def orphan_values(spark, sf_dir):
    fx, _ = reference(spark, sf_dir)
    return validation.orphan_values(fx["fx_values"], fx["fx_characteristics"])


@query(
    with_views(*REF)
    + "SELECT h.characteristic_id FROM fx_characteristics h WHERE h.mandatory AND NOT EXISTS (SELECT 1 FROM fx_values v "
    "WHERE v.category_id = h.category_id AND v.characteristic_name = h.characteristic_name)"
)
def mandatory_no_values(spark, sf_dir):
    fx, _ = reference(spark, sf_dir)
    return validation.mandatory_no_values(fx["fx_characteristics"], fx["fx_values"]).select("characteristic_id")


@query("SELECT p_name AS key, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_categories(spark, sf_dir):
    """Part names taken as category names repeat a lot."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return validation.duplicate_categories(parts, "p_name")


@query(
    "SELECT p_type AS category_id, p_brand AS characteristic_name, count(*) AS n, arg_min(CAST(p_partkey AS VARCHAR), p_partkey) AS characteristic_id "
    "FROM part GROUP BY p_type, p_brand HAVING count(*) > 1"
)
def duplicate_characteristics(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_type").alias("category_id"), F.col("p_brand").alias("characteristic_name"),
        F.col("p_partkey").cast("string").alias("characteristic_id"), F.col("p_partkey").alias("ordinal"),
    )
    return validation.duplicate_characteristics(parts)


@query("SELECT count(*) FILTER (WHERE trim(text) = '' OR text IS NULL) AS empty_values, count(*) FILTER (WHERE source IS NULL) AS null_names FROM documents")
def empty_and_null_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("text").alias("value"), F.col("source").alias("characteristic_name"))
    return validation.empty_value_count(docs).withColumnRenamed("n", "empty_values").join(
        validation.null_name_count(docs).withColumnRenamed("n", "null_names")
    )


@query(
    with_views(
        *REF, gaps=GAPS,
        full_values="SELECT coalesce(g.category_id, h.category_id) AS category_id, coalesce(g.characteristic_name, h.characteristic_name) AS characteristic_name "
        "FROM gaps g LEFT JOIN fx_characteristics h USING (characteristic_id)",
        issues="""SELECT 'mandatory_no_values' AS issue_type, 'warning' AS severity FROM fx_characteristics h WHERE h.mandatory AND NOT EXISTS (
          SELECT 1 FROM full_values v WHERE v.category_id = h.category_id AND v.characteristic_name = h.characteristic_name)
        UNION ALL SELECT 'orphan_value', 'warning' FROM (SELECT DISTINCT characteristic_name FROM full_values
          WHERE characteristic_name NOT IN (SELECT characteristic_name FROM fx_characteristics)) t""",
    )
    + "SELECT severity, issue_type, count(*) AS n FROM issues GROUP BY 1, 2"
)
def validate_reference(spark, sf_dir):
    """All checks over values repaired from their gaps, counted per kind."""
    fx, _ = reference(spark, sf_dir)
    repaired = validation.enrich_values(_gaps(fx), fx["fx_characteristics"])
    issues = validation.validate_reference(fx["fx_categories"], fx["fx_characteristics"], repaired)
    return issues.groupBy("severity", "issue_type").agg(F.count("*").alias("n"))


@query(
    with_views(*REF, **REFERENCE)
    + "SELECT 'categories' AS what, count(*) AS n FROM fx_categories UNION ALL SELECT 'characteristics', count(*) FROM fx_characteristics "
    "UNION ALL SELECT 'values', count(*) FROM vals"
)
def reference_stats(spark, sf_dir):
    fx, index = reference(spark, sf_dir)
    return validation.reference_stats(index, fx["fx_categories"], fx["fx_characteristics"])


@query(with_views(*REF) + "SELECT category_name, external_id AS cat, lower(category_name) AS category_key FROM fx_categories")
def category_index(spark, sf_dir):
    fx, _ = reference(spark, sf_dir)
    return indexes.category_index(fx["fx_categories"]).select("category_name", "cat", "category_key")


_BRANDS = "SELECT p_brand AS category_name, p_name AS category_id, min(p_partkey) AS ordinal FROM part GROUP BY 1, 2"


@query(
    "WITH c AS (" + _BRANDS + "), n AS (SELECT p_name AS category_id, count(*) AS n FROM part GROUP BY 1) "
    "SELECT category_name, arg_max(category_id, n * 10000000 - ordinal) AS cat FROM c JOIN n USING (category_id) GROUP BY category_name"
)
def category_index_most_chars(spark, sf_dir):
    """Repeated category names keep the category with most attributes (parts per name)."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    cats = parts.groupBy(F.col("p_brand").alias("category_name"), F.col("p_name").alias("category_id")).agg(
        F.min("p_partkey").alias("ordinal")
    ).withColumn("external_id", F.lit(None).cast("string"))
    attributes = parts.select(F.col("p_name").alias("category_id"))
    return indexes.category_index(cats, attributes, prefer_most_chars=True).select("category_name", "cat")


@query(
    "SELECT p_type, p_brand, arg_max(p_name, p_retailprice * 1000000 - p_partkey) AS p_name FROM part GROUP BY 1, 2"
)
def keep_best_duplicate(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    best = indexes.keep_best_duplicate(parts, ["p_type", "p_brand"], F.col("p_retailprice") * 1000000 - F.col("p_partkey"), F.col("p_partkey"))
    return best.select("p_type", "p_brand", "p_name")


@query(with_views(*REF, **REFERENCE) + "SELECT cat, string_agg(char_name, '; ' ORDER BY ordinal) AS names FROM attrs WHERE mandatory GROUP BY cat")
def mandatory_index(spark, sf_dir):
    _, index = reference(spark, sf_dir)
    return indexes.mandatory_lists(index.attributes).select("cat", F.array_join("mandatory", "; ").alias("names"))


@query(
    with_views(*REF, **REFERENCE)
    + "SELECT a.cat, a.char_key, a.char_name AS canonical, 'e' || split_part(h.characteristic_id, '-', 2) AS external_characteristic_id, "
    "a.restrictive FROM attrs a JOIN fx_characteristics h ON h.ordinal = a.ordinal AND h.characteristic_name = a.char_name"
)
def char_index(spark, sf_dir):
    _, index = reference(spark, sf_dir)
    return index.chars


@query(with_views(*REF, **REFERENCE) + "SELECT cat, char_name, value FROM vals")
def value_index(spark, sf_dir):
    _, index = reference(spark, sf_dir)
    return index.values.select("cat", "char_name", "value")


@query(with_views(*REF) + "SELECT DISTINCT characteristic_id, trim(value) AS value FROM fx_values")
def value_index_by_char_id(spark, sf_dir):
    fx, _ = reference(spark, sf_dir)
    return indexes.value_index_by_char_id(fx["fx_values"])


@query(with_views(*REF, **REFERENCE) + "SELECT cat, char_name, lower(value) AS value_norm, min(value) AS value FROM vals GROUP BY 1, 2, 3")
def value_norm_index(spark, sf_dir):
    _, index = reference(spark, sf_dir)
    return indexes.value_norm_index(index.values)


@query(with_views(*REF, **REFERENCE) + "SELECT DISTINCT lower(rtrim(char_name, ':')) AS char_key, value, lower(value) AS value_norm FROM vals")
def marketplace_value_index(spark, sf_dir):
    _, index = reference(spark, sf_dir)
    return indexes.marketplace_value_index(index.values)


@query(with_views(*REF) + "SELECT category_id FROM fx_categories UNION SELECT external_id FROM fx_categories")
def category_ids(spark, sf_dir):
    fx, _ = reference(spark, sf_dir)
    return validation.category_ids(fx["fx_categories"])


@query(
    with_views(*REF, **REFERENCE)
    + "SELECT DISTINCT cat FROM attrs WHERE mandatory AND cat NOT IN (SELECT cat FROM vals)"
)
def mandatory_categories_without_values(spark, sf_dir):
    _, index = reference(spark, sf_dir)
    return validation.mandatory_categories_without_values(index)


# import runs: an event is a state change of one run
_RUNS = (
    "SELECT CAST(user_id AS VARCHAR) AS import_run_id, event_type AS marketplace_id, "
    "CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'completed' END AS status, props AS notes, ts AS logged_at FROM events"
)


def _runs(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    return spark.sql(_RUNS.replace("AS VARCHAR", "AS STRING"))


def _loads(spark, sf_dir):
    """Loaded rows per run and marketplace, from the events themselves."""
    rows = _runs(spark, sf_dir)
    values = rows.withColumn("characteristic_name", F.col("notes"))
    return rows, rows.where("status = 'completed'"), values, rows.where("status = 'failed'")


@query(
    f"""WITH r AS ({_RUNS}) SELECT import_run_id, arg_max(status, logged_at) AS status, arg_max(notes, logged_at) AS notes,
  count(*) FILTER (WHERE status = 'completed') AS categories, count(*) AS characteristics, count(*) FILTER (WHERE status = 'failed') AS "values",
  count(*) FILTER (WHERE status = 'completed') AS warnings, count(*) FILTER (WHERE status = 'failed') AS errors FROM r GROUP BY 1"""
)
def import_summary(spark, sf_dir):
    runs, cats, chars, vals = _loads(spark, sf_dir)
    issues = runs.withColumn("severity", F.when(F.col("status") == "failed", "error").otherwise("warning"))
    return validation.import_summary(runs, cats, chars, vals, issues)


@query(
    f"""WITH r AS ({_RUNS}) SELECT marketplace_id, arg_max(import_run_id, logged_at) FILTER (WHERE status = 'completed') AS import_run_id,
  count(*) FILTER (WHERE status = 'completed') AS categories, count(*) AS characteristics, count(*) FILTER (WHERE status = 'failed') AS "values",
  true AS available FROM r GROUP BY 1"""
)
def db_status(spark, sf_dir):
    runs, cats, chars, vals = _loads(spark, sf_dir)
    return validation.db_status(runs, cats, chars, vals).drop("completed_at")


@query(f"WITH r AS ({_RUNS}) SELECT marketplace_id, arg_max(import_run_id, logged_at) AS import_run_id FROM r WHERE status = 'completed' GROUP BY 1")
def latest_import(spark, sf_dir):
    return validation.latest_import(_runs(spark, sf_dir)).select("marketplace_id", "import_run_id")


@query(
    f"""WITH r AS ({_RUNS}) SELECT marketplace_id, count(*) FILTER (WHERE status = 'completed') AS categories,
  count(DISTINCT notes) AS characteristics, count(*) FILTER (WHERE status = 'failed') AS "values" FROM r GROUP BY 1"""
)
def marketplace_card(spark, sf_dir):
    _, cats, chars, vals = _loads(spark, sf_dir)
    return validation.marketplace_card(cats, chars, vals)
