"""A processed run over the fixture offers, saved once per session for the reports that read it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offermend.functions.text import null_if_blank
from offermend.operators.indexes import ReferenceIndex
from offermend.plans.fixtures import reference
from offermend.plans.process_offers import Options, process_offers
from offermend.session import staged

_SAVED: dict[tuple[str, ...], DataFrame] = {}


def fixture_offers(fx: dict[str, DataFrame]) -> DataFrame:
    """Fixture offers in the engine's offer schema."""
    pairs = F.create_map(
        F.lit("Color"), F.col("color"), F.lit("Size"), F.col("size_value"), F.lit("Kind"), F.col("kind_value"),
        F.lit("Foreign"), F.col("foreign_value"),
    )
    return fx["fx_offers"].select(
        "offer_id", "ordinal", "ts", "title", "brand", "ean", "error", "description", "category",
        F.map_filter(pairs, lambda k, v: v.isNotNull()).alias("existing_chars"),
    )


def run_options(**changes) -> Options:
    return Options(codes=["1007", "1009", "1010"], **changes)


def fresh_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx, index = reference(spark, sf_dir)
    return process_offers(fixture_offers(fx), index, run_options())


def saved_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of ``process_offers`` as a table written once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SAVED:
        _SAVED[key] = staged(fresh_run(spark, sf_dir))
    return _SAVED[key]


def saved_image_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run with images, written once: every listed attribute is seen twice, with its first value and with one that no
    list holds, and one attribute that no category has; two offers in three have a hint of a category."""
    key = (spark.sparkContext.applicationId, sf_dir, "images")
    if key not in _SAVED:
        fx, index, offers = located(spark, sf_dir)
        first = index.values.groupBy("cat", "char_name").agg(F.min("value").alias("value"))
        listed = staged(index.attributes.select("cat", "char_name").distinct().join(first, ["cat", "char_name"]))
        seen = offers.select("offer_id", "cat").join(listed, "cat").select("offer_id", F.col("char_name").alias("char_input"), F.explode(F.array("value", F.lit("zzqq"))).alias("value_input"))
        seen = seen.unionByName(offers.select("offer_id", F.lit("Nope").alias("char_input"), F.lit("red").alias("value_input")))
        hints = fx["fx_offers"].where("ordinal % 3 < 2").select(
            "offer_id", F.expr("IF(ordinal % 3 = 0, 'LARGE', 'qqqq')").alias("image_candidate"), F.lit(0.9).alias("image_confidence")
        )
        _SAVED[key] = staged(process_offers(fixture_offers(fx), index, run_options(image_values=seen, image_hints=hints)))
    return _SAVED[key]


def located(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], ReferenceIndex, DataFrame]:
    """Fixture tables, index, and offers with their resolved category (null when unknown)."""
    from offermend.operators.matching import resolve_categories

    fx, index = reference(spark, sf_dir)
    offers = fixture_offers(fx)
    cats = resolve_categories(offers.where("category <> ''"), index).select("category", "cat")
    return fx, index, offers.join(cats, "category", "left")


def attribute_rows(offers: DataFrame) -> DataFrame:
    """Existing attributes in long form (offer_id, cat, position, char_input, value_input)."""
    return offers.select("offer_id", "cat", F.posexplode("existing_chars").alias("position", "char_input", "value_input")).where(
        null_if_blank("value_input").isNotNull()
    )
