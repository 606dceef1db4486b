"""What earlier runs learned: product knowledge, cached replies, learned rules, finished offers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offermend.functions.text import char_request_key, done_key, title_key
from offermend.operators.detect import learn_keywords


def knowledge_lookup(offers: DataFrame, knowledge: DataFrame, any_marketplace: bool = False) -> DataFrame:
    """Offers with the stored row of the same product.

    ``offers``: offer_id, ean, brand, normalized_title, marketplace_id. An offer with an ean is
    looked up by it alone, one without by brand and title among rows without ean.
    """
    market = [] if any_marketplace else ["marketplace_id"]
    stored = ["category", "final_attributes", "confidence"]
    newest = lambda c: F.max_by(c, F.struct("updated_at", "run_id")).alias(c)
    by_ean = knowledge.where("ean IS NOT NULL").groupBy("ean", *market).agg(*[newest(c) for c in stored])
    by_title = knowledge.where("ean IS NULL").groupBy("brand", "normalized_title", *market).agg(*[newest(c) for c in stored])
    with_ean = offers.where("coalesce(ean, '') <> '' AND coalesce(marketplace_id, '') <> ''")
    without = offers.where(
        "coalesce(ean, '') = '' AND coalesce(brand, '') <> '' AND coalesce(normalized_title, '') <> '' AND coalesce(marketplace_id, '') <> ''"
    )
    hit = ["offer_id", *stored]
    return with_ean.select("offer_id", "ean", *market).join(by_ean, ["ean", *market]).select(*hit).unionByName(
        without.select("offer_id", "brand", "normalized_title", *market)
        .join(by_title, ["brand", "normalized_title", *market]).select(*hit)
    )


def knowledge_upsert(knowledge: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rows with the new ones: one row per (ean, marketplace) or, without ean, per (brand,
    title, marketplace); the newest replaces. Partial maxima travel, not the rows of a hot key."""
    rows = knowledge.unionByName(new.select(*knowledge.columns))
    key = F.when(F.col("ean").isNotNull(), F.struct(F.col("ean").alias("a"), F.lit("").alias("b"))).otherwise(
        F.struct(F.col("brand").alias("a"), F.col("normalized_title").alias("b"))
    )
    packed = F.struct(*[F.col(c) for c in rows.columns])
    return (
        rows.withColumn("_k", key).withColumn("_e", F.col("ean").isNotNull())
        .groupBy("marketplace_id", "_e", "_k")
        .agg(F.max_by(packed, F.struct("updated_at", "run_id", "offer_id")).alias("_r"))
        .select("_r.*")
    )


def cached_categories(offers: DataFrame, cache: DataFrame, marketplace: str) -> DataFrame:
    """(offer_id, category) for titles a model already classified; ``cache``: key, category."""
    keyed = offers.select("offer_id", title_key("title", F.lit(marketplace)).alias("key"))
    return keyed.join(cache, "key").select("offer_id", "category")


def uncached(offers: DataFrame, cache: DataFrame, marketplace: str) -> DataFrame:
    keyed = offers.withColumn("key", title_key("title", F.lit(marketplace)))
    return keyed.join(cache.select("key"), "key", "left_anti").drop("key")


def category_cache_rows(accepted: DataFrame, marketplace: str) -> DataFrame:
    """Cache rows of accepted categories (title, category)."""
    return accepted.groupBy(title_key("title", F.lit(marketplace)).alias("key")).agg(F.min("category").alias("category"))


def cached_attributes(requests: DataFrame, cache: DataFrame, values: DataFrame, marketplace: str) -> DataFrame:
    """(offer_id, char_name, value) from cached replies that still hold.

    ``requests``: offer_id, title, category, cat, missing (array); ``cache``: key, char_name, value.
    A value counts if its attribute is asked for and its list is empty or still holds it.
    """
    keyed = requests.select(
        "offer_id", "cat", "missing", char_request_key("title", "category", F.lit(marketplace), F.col("missing")).alias("key")
    )
    hits = keyed.join(cache, "key").where(F.array_contains("missing", F.col("char_name")))
    listed = values.select("cat", "char_name", "value", F.lit(True).alias("listed"))
    lists = values.select("cat", "char_name").distinct().withColumn("has_values", F.lit(True))
    return (
        hits.join(lists, ["cat", "char_name"], "left").join(listed, ["cat", "char_name", "value"], "left")
        .where("has_values IS NULL OR listed")
        .select("offer_id", "char_name", "value")
    )


def update_done(done: DataFrame, accepted: DataFrame, marketplace: str) -> DataFrame:
    """key -> set of mandatory names ever resolved, with those of ``accepted`` (title, category,
    char_name) added. ``done``: key, char_name (one row per name)."""
    new = accepted.select(done_key("title", "category", F.lit(marketplace)).alias("key"), "char_name")
    return done.unionByName(new).distinct()


def not_done(requests: DataFrame, done: DataFrame, marketplace: str) -> DataFrame:
    """Requests (offer_id, title, category, mandatory array) with a mandatory name not yet resolved."""
    keyed = requests.withColumn("key", done_key("title", "category", F.lit(marketplace)))
    names = keyed.select("key", F.explode("mandatory").alias("char_name")).distinct()
    known = done.select("key").distinct()
    # a key is settled when it is known and none of its wanted names is missing
    open_keys = names.join(done, ["key", "char_name"], "left_anti").select("key").distinct().withColumn("_open", F.lit(True))
    return (
        keyed.join(open_keys, "key", "left")
        .join(known.withColumn("_known", F.lit(True)), "key", "left")
        .where("_open OR _known IS NULL OR size(mandatory) = 0")
        .drop("key", "_open", "_known")
    )


def learned_rules(accepted: DataFrame) -> DataFrame:
    """Rules (keywords, exclude, category) learned from accepted (title, category, ordinal): the
    first category seen for a keyword text wins."""
    rows = accepted.select(learn_keywords(F.col("title")).alias("keywords"), "category", "ordinal").where("keywords <> ''")
    return rows.groupBy("keywords").agg(F.min_by("category", "ordinal").alias("category"), F.min("ordinal").alias("ordinal")).select(
        "keywords", F.lit("").alias("exclude"), "category", "ordinal"
    )


def merge_learned_rules(known: DataFrame, new: DataFrame) -> DataFrame:
    """Known rules first, then new ones whose keyword text is not there yet."""
    rows = known.select("keywords", "exclude", "category", F.lit(0).alias("gen"), "ordinal").unionByName(
        new.select("keywords", "exclude", "category", F.lit(1).alias("gen"), "ordinal")
    )
    order = F.struct("gen", "ordinal", "category")
    return rows.where("keywords <> ''").groupBy("keywords").agg(
        F.min_by("exclude", order).alias("exclude"), F.min_by("category", order).alias("category")
    )


def pending(offers: DataFrame, done: DataFrame) -> DataFrame:
    """Offers not yet processed."""
    return offers.join(done.select("offer_id").distinct(), "offer_id", "left_anti")


def resume(done: DataFrame, fresh: DataFrame) -> DataFrame:
    """Earlier results kept in place, with the fresh ones for the rest."""
    return done.unionByName(fresh.join(done.select("offer_id"), "offer_id", "left_anti"))
