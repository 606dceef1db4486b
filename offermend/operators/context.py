"""Marketplace context: language, request context, eligible error codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offermend import fixed_values as V
from offermend.functions.text import error_code, strip


def _tokens(c: Column) -> Column:
    return F.split(c, r"[\s_\-]+")


def locale_table(spark: SparkSession, locales: dict[str, str] | None = None) -> DataFrame:
    rows = [(i, k, lang) for i, (k, lang) in enumerate((locales or V.LOCALES).items())]
    return spark.createDataFrame(rows, "position int, registry_key string, language string").withColumn(
        "tokens", F.array_distinct(_tokens(F.lower("registry_key")))
    )


def locale(marketplaces: DataFrame, table: DataFrame) -> DataFrame:
    """marketplace -> language: exact key, else the key whose tokens are all in the name, most
    tokens first. Unknown names have a null language. Found through one shared token."""
    names = marketplaces.select("marketplace").distinct().withColumn("name", F.lower(strip("marketplace")))
    names = names.withColumn("name_tokens", _tokens(F.col("name")))
    probes = names.withColumn("token", F.explode(F.array_distinct("name_tokens")))
    keyed = table.withColumn("token", F.element_at("tokens", 1))
    by_tokens = probes.join(keyed, "token").where(F.size(F.array_except("tokens", "name_tokens")) == 0)
    exact = names.join(table, F.col("name") == F.col("registry_key"))
    hits = exact.select("marketplace", F.lit(0).alias("tier"), F.lit(0).alias("n"), "position", "language").unionByName(
        by_tokens.select("marketplace", F.lit(1).alias("tier"), (-F.size(_tokens(F.col("registry_key")))).alias("n"), "position", "language")
    )
    best = hits.groupBy("marketplace").agg(F.min_by("language", F.struct("tier", "n", "position")).alias("language"))
    return names.select("marketplace").join(best, "marketplace", "left")


def marketplace_context(marketplaces: DataFrame) -> DataFrame:
    """marketplace -> context text: the first alias whose tokens are in the name or that is part of
    it; the name itself when none is."""
    names = marketplaces.select("marketplace").distinct()
    key = F.lower(strip("marketplace"))
    tokens = _tokens(key)
    out = None
    for aliases, text in V.MARKETPLACE_CONTEXTS:
        hit = F.lit(False)
        for alias in aliases:
            wanted = F.split(F.lit(alias.lower()), r"[\s_\-]+")
            hit = hit | (F.size(F.array_except(wanted, tokens)) == 0) | F.contains(key, F.lit(alias.lower()))
        out = F.when(hit, F.lit(text)) if out is None else out.when(hit, F.lit(text))
    return names.withColumn("context", out.otherwise(F.col("marketplace")))


def error_code_table(spark: SparkSession, saved: dict[str, list[str]] | None = None) -> DataFrame:
    """(marketplace, code): the saved codes of a marketplace, else its defaults."""
    config = {**V.DEFAULT_ERROR_CODES, **(saved or {})}
    return spark.createDataFrame([(m, c) for m, codes in config.items() for c in codes], "marketplace string, code string")


def eligible_offers(offers: DataFrame, codes: DataFrame) -> DataFrame:
    """Offers (marketplace, error, …) whose code is configured; no code counts as ``empty``.

    """
    coded = offers.withColumn("error_code", error_code("error")).withColumn("_code", F.coalesce("error_code", F.lit("empty")))
    keys = codes.select("marketplace", F.col("code").alias("_code")).distinct()
    return coded.join(keys, ["marketplace", "_code"], "left_semi").drop("_code")


def filter_category(offers: DataFrame, category: str) -> DataFrame:
    return offers.where(F.lower(strip(F.coalesce("category", F.lit("")))) == category.strip().lower())
