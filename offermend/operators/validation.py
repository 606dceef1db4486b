"""Defects of reference tables and counts over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offermend.functions.fuzzy import union_all
from offermend.functions.text import norm_id, strip
from offermend.operators.indexes import ReferenceIndex

ISSUE = ["severity", "issue_type", "entity_type", "entity_id", "message"]


def _issues(rows: DataFrame, severity: str, issue_type: str, entity_type: str, entity_id, message) -> DataFrame:
    return rows.select(
        F.lit(severity).alias("severity"), F.lit(issue_type).alias("issue_type"), F.lit(entity_type).alias("entity_type"),
        entity_id.cast("string").alias("entity_id"), message.alias("message"),
    )


def enrich_values(values: DataFrame, characteristics: DataFrame, drop_unmatched: bool = False, prefer_own_name: bool = True) -> DataFrame:
    """Values without a category take category and missing name from their attribute id.

    A repeated attribute id counts with its first row. ``drop_unmatched`` leaves out values that
    stay without a category (the file repair variant).
    """
    owner = characteristics.groupBy("characteristic_id").agg(
        F.min_by("category_id", "ordinal").alias("_cat"), F.min_by("characteristic_name", "ordinal").alias("_name")
    )
    rows = values.join(owner, "characteristic_id", "left")
    needs = F.col("category_id").isNull() & F.col("characteristic_id").isNotNull()
    name = F.coalesce("characteristic_name", "_name") if prefer_own_name else F.coalesce("_name", "characteristic_name")
    rows = rows.select(
        *[
            F.when(needs, F.col("_cat")).otherwise(F.col("category_id")).alias("category_id") if c == "category_id"
            else F.when(needs, name).otherwise(F.col("characteristic_name")).alias(c) if c == "characteristic_name"
            else F.col(c)
            for c in values.columns
        ]
    )
    return rows.where("category_id IS NOT NULL AND value IS NOT NULL") if drop_unmatched else rows


def remap_external_ids(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """``category_id`` given as external id replaced by the internal one; the last duplicate wins."""
    known = (
        categories.select(norm_id("external_id").alias("category_id"), norm_id("category_id").alias("_internal"), "ordinal")
        .where("category_id IS NOT NULL AND (_internal IS NULL OR category_id <> _internal)")
        .groupBy("category_id").agg(F.max_by("_internal", "ordinal").alias("_internal"))
    )
    normed = rows.withColumn("category_id", norm_id("category_id"))
    joined = normed.join(known, "category_id", "left").withColumn("category_id", F.coalesce("_internal", "category_id"))
    return joined.select(*rows.columns)


def category_ids(categories: DataFrame) -> DataFrame:
    """All internal and external ids."""
    ids = categories.select(norm_id("category_id").alias("category_id")).union(categories.select(norm_id("external_id")))
    return ids.where("category_id IS NOT NULL").distinct()


def orphan_characteristics(characteristics: DataFrame, categories: DataFrame) -> DataFrame:
    """Attributes whose category is unknown, one row per attribute id."""
    rows = characteristics.withColumn("_raw", F.col("category_id")).withColumn("category_id", norm_id("category_id"))
    lost = rows.join(category_ids(categories), "category_id", "left_anti")
    return lost.groupBy("characteristic_id").agg(
        F.min_by("characteristic_name", "ordinal").alias("characteristic_name"), F.min_by("_raw", "ordinal").alias("category_id")
    )


def orphan_values(values: DataFrame, characteristics: DataFrame) -> DataFrame:
    """Attribute names of values that no characteristic has."""
    names = values.where("characteristic_name IS NOT NULL").select("characteristic_name").distinct()
    return names.join(characteristics.select("characteristic_name").distinct(), "characteristic_name", "left_anti")


def mandatory_no_values(characteristics: DataFrame, values: DataFrame) -> DataFrame:
    """Mandatory attributes without any value under exactly their category and name."""
    pairs = values.select(norm_id("category_id").alias("_c"), "characteristic_name").distinct()
    wanted = characteristics.where("mandatory").withColumn("_c", norm_id("category_id"))
    return wanted.join(pairs, ["_c", "characteristic_name"], "left_anti").select(*characteristics.columns)


def duplicate_categories(categories: DataFrame, column: str) -> DataFrame:
    return categories.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_characteristics(characteristics: DataFrame) -> DataFrame:
    return (
        characteristics.groupBy("category_id", "characteristic_name")
        .agg(F.count("*").alias("n"), F.min_by("characteristic_id", "ordinal").alias("characteristic_id")).where("n > 1")
    )


def null_name_count(values: DataFrame) -> DataFrame:
    return values.agg(F.count(F.when(F.col("characteristic_name").isNull(), 1)).alias("n"))


def empty_value_count(values: DataFrame) -> DataFrame:
    return values.agg(F.count(F.when(F.col("value").isNull() | (strip("value") == ""), 1)).alias("n"))


def validate_reference(categories: DataFrame, characteristics: DataFrame, values: DataFrame) -> DataFrame:
    """All defects as issue rows."""
    quoted = lambda c: F.concat(F.lit("'"), F.coalesce(c.cast("string"), F.lit("")), F.lit("'"))
    name, cat = F.col("characteristic_name"), F.col("category_id")
    parts = [
        _issues(orphan_characteristics(characteristics, categories), "warning", "orphan_characteristic", "characteristic",
                F.col("characteristic_id"), F.concat(F.lit("characteristic "), quoted(name), F.lit(" has unknown category "), quoted(cat)))
    ]
    for column in ("category_id", "category_name"):
        parts.append(_issues(duplicate_categories(categories, column), "warning", "duplicate_category", "category", F.col("key"),
                             F.concat(F.lit(f"{column} "), quoted(F.col("key")), F.lit(" is duplicated"))))
    parts.append(_issues(duplicate_characteristics(characteristics), "warning", "duplicate_characteristic", "characteristic",
                         F.col("characteristic_id"), F.concat(F.lit("characteristic "), quoted(name), F.lit(" is duplicated in category "), quoted(cat))))
    parts.append(_issues(mandatory_no_values(characteristics, values), "warning", "mandatory_no_values", "characteristic",
                         F.col("characteristic_id"), F.concat(F.lit("mandatory characteristic "), quoted(name), F.lit(" has no values"))))
    parts.append(_issues(null_name_count(values).where("n > 0"), "warning", "null_characteristic_name", "value", F.lit(None),
                         F.concat(F.col("n"), F.lit(" values without characteristic name"))))
    parts.append(_issues(empty_value_count(values).where("n > 0"), "error", "empty_value", "value", F.lit(None),
                         F.concat(F.col("n"), F.lit(" empty values"))))
    parts.append(_issues(orphan_values(values, characteristics), "warning", "orphan_value", "value", F.lit(None),
                         F.concat(F.lit("characteristic name "), quoted(name), F.lit(" is not in characteristics"))))
    return union_all(parts)


def reference_stats(index: ReferenceIndex, categories: DataFrame, characteristics: DataFrame) -> DataFrame:
    """Rows of categories and attributes, distinct listed values per (category, attribute)."""
    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")

    return union_all([counted(categories, "categories"), counted(characteristics, "characteristics"), counted(index.values, "values")])


def mandatory_categories_without_values(index: ReferenceIndex) -> DataFrame:
    """Categories with mandatory attributes but not a single listed value."""
    wanted = index.attributes.where("mandatory").select("cat").distinct()
    return wanted.join(index.values.select("cat").distinct(), "cat", "left_anti")


def import_summary(run: DataFrame, categories: DataFrame, characteristics: DataFrame, values: DataFrame, issues: DataFrame) -> DataFrame:
    """One row per import run: rows per table, warnings, errors, status, notes.

    ``run``: the state rows of ``import_runs``; the latest state counts.
    """
    state = run.groupBy("import_run_id").agg(
        F.max_by("status", "logged_at").alias("status"), F.max_by("notes", "logged_at").alias("notes")
    )
    for name, rows in (("categories", categories), ("characteristics", characteristics), ("values", values)):
        state = state.join(rows.groupBy("import_run_id").agg(F.count("*").alias(name)), "import_run_id", "left")
    counts = issues.groupBy("import_run_id").agg(
        F.count(F.when(F.col("severity") == "warning", 1)).alias("warnings"), F.count(F.when(F.col("severity") == "error", 1)).alias("errors")
    )
    return state.join(counts, "import_run_id", "left").na.fill(0, ["categories", "characteristics", "values", "warnings", "errors"])


def latest_import(runs: DataFrame) -> DataFrame:
    """marketplace -> its latest completed import. State rows are few per marketplace, and only
    maxima travel."""
    done = runs.where("status = 'completed'")
    return done.groupBy("marketplace_id").agg(
        F.max_by("import_run_id", "logged_at").alias("import_run_id"), F.max("logged_at").alias("completed_at")
    )


def db_status(runs: DataFrame, categories: DataFrame, characteristics: DataFrame, values: DataFrame) -> DataFrame:
    """marketplace -> availability, latest import and row counts."""
    out = latest_import(runs)
    for name, rows in (("categories", categories), ("characteristics", characteristics), ("values", values)):
        out = out.join(rows.groupBy("marketplace_id").agg(F.count("*").alias(name)), "marketplace_id", "left")
    return out.na.fill(0, ["categories", "characteristics", "values"]).withColumn("available", F.col("categories") > 0)


def marketplace_card(categories: DataFrame, characteristics: DataFrame, values: DataFrame) -> DataFrame:
    """marketplace -> categories, distinct attribute names, values."""
    return (
        categories.groupBy("marketplace_id").agg(F.count("*").alias("categories"))
        .join(characteristics.groupBy("marketplace_id").agg(F.countDistinct("characteristic_name").alias("characteristics")), "marketplace_id", "full")
        .join(values.groupBy("marketplace_id").agg(F.count("*").alias("values")), "marketplace_id", "full")
        .na.fill(0)
    )
