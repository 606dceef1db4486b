"""Scored resolution: colours to listed colours, and model values to listed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offermend import fixed_values as V
from offermend.functions.fuzzy import cosine, hybrid_score, rank_candidates, token_overlap, token_set_ratio_udf
from offermend.functions.text import norm_color, strip
from offermend.operators.indexes import ReferenceIndex


def apply_threshold(value: Column, score: Column) -> tuple[Column, Column]:
    """(value or null, needs_review) by the accept and review thresholds."""
    return (
        F.when(score >= V.SOFT_REVIEW, value),
        value.isNull() | (score < V.AUTO_ACCEPT),
    )


def near_tie(first: Column, second: Column, delta: float) -> Column:
    return F.coalesce(first - second < delta, F.lit(False))


def with_ties(ranked: DataFrame, keys: list[str], delta: float) -> DataFrame:
    """Ranked candidates with the score of the next one and whether it is a near tie."""
    nxt = F.lead("score").over(W.partitionBy(*keys).orderBy("rank"))
    return ranked.withColumn("next_score", nxt).withColumn("near_tie", near_tie(F.col("score"), F.col("next_score"), delta))


def _top_k(ranked: DataFrame, keys: list[str], digits: int | None = None) -> DataFrame:
    """keys -> top_k array (at most k entries), best value, best and second score."""
    score = F.round("score", digits) if digits else F.col("score")
    return ranked.groupBy(*keys).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "value", score.alias("score")))),
            lambda c: F.struct(c["value"].alias("value"), c["score"].alias("score")),
        ).alias("top_k"),
        F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("best"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best_score"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second_score"),
        F.max(F.when(F.col("rank") == 1, F.col("synonym"))).alias("best_synonym"),
    )


# ---------------------------------------------------------------- model values


def adaptive_floor(n: Column) -> Column:
    return F.when(n <= 10, 0.55).when(n <= 50, 0.62).otherwise(0.70)


def resolve_values(
    requests: DataFrame,
    index: ReferenceIndex,
    choices: DataFrame | None = None,
    budget: int = V.REPAIR_BUDGET,
) -> DataFrame:
    """Values a list does not hold, resolved to a listed one or left for review.

    ``requests``: offer_id, cat, char_name, value_input, is_mandatory, position. ``choices``
    (cat, char_name, value_input, choice) are repair answers; a choice counts if it is among the
    three best, for a mandatory attribute, and within the offer's budget in attribute order.
    Adds value, method, score, top_k, needs_review, soft_review, low_confidence, reason.
    """
    group = ["cat", "char_name"]
    queries = requests.select(*group, F.col("value_input").alias("query")).distinct().withColumn("query_norm", norm_color("query"))
    allowed = index.values.select(*group, "value").withColumn("value_norm", norm_color("value"))
    ranked = _top_k(rank_candidates(queries, allowed, group, 3), [*group, "query"])
    sizes = allowed.groupBy(*group).agg(F.count("*").alias("n_allowed"))
    exact = (
        queries.join(allowed.withColumnRenamed("value_norm", "query_norm"), [*group, "query_norm"])
        .groupBy(*group, "query").agg(F.min("value").alias("exact_value"))
    )
    scored = (
        requests.withColumn("query", F.col("value_input"))
        .join(ranked, [*group, "query"], "left")
        .join(exact, [*group, "query"], "left")
        .join(sizes, group, "left")
    )
    if choices is not None:
        scored = scored.join(choices.select(*group, "value_input", "choice"), [*group, "value_input"], "left")
    else:
        scored = scored.withColumn("choice", F.lit(None).cast("string"))

    tie = near_tie(F.col("best_score"), F.col("second_score"), V.RESOLVER_TIE)
    accepted = F.col("exact_value").isNotNull() | (F.col("best_score") >= V.AUTO_ACCEPT)
    repairable = F.coalesce(
        ~F.coalesce(accepted, F.lit(False)) & F.col("is_mandatory")
        & F.exists("top_k", lambda c: c["value"] == F.col("choice")),
        F.lit(False),
    )
    # the budget is spent on successful repairs only, in attribute order; an offer's attributes are few
    spent = F.sum(F.col("repairable").cast("int")).over(W.partitionBy("offer_id").orderBy("position", "char_name", "value_input"))
    scored = scored.withColumn("repairable", repairable).withColumn("repair", F.col("repairable") & (spent <= budget))
    scored = scored.withColumn("floor", adaptive_floor(F.col("n_allowed"))).withColumn("tie", tie)
    rescue = F.col("is_mandatory") & (F.col("best_score") >= F.col("floor")) & ~F.col("tie")
    method = (
        F.when(F.col("top_k").isNull(), F.lit("none"))
        .when(F.col("exact_value").isNotNull(), F.lit("exact"))
        .when(F.col("best_score") >= V.AUTO_ACCEPT, F.lit("fuzzy"))
        .when(F.col("repair"), F.lit("repair"))
        .when(rescue, F.lit("rescue"))
        .otherwise(F.lit("none"))
    )
    chosen = F.element_at(F.filter("top_k", lambda c: c["value"] == F.col("choice")), 1)["score"]
    return scored.withColumn("method", method).select(
        *requests.columns,
        F.when(F.col("method") == "exact", F.col("exact_value"))
        .when(F.col("method") == "repair", F.col("choice"))
        .when(F.col("method").isin("fuzzy", "rescue"), F.col("best")).alias("value"),
        "method",
        F.when(F.col("method") == "exact", F.lit(1.0))
        .when(F.col("method") == "repair", F.greatest(chosen, F.lit(V.SOFT_ACCEPT)))
        .otherwise(F.coalesce("best_score", F.lit(0.0))).alias("score"),
        "top_k",
        ((F.col("method") != "exact") & ((F.col("method") != "fuzzy") | F.col("tie"))).alias("needs_review"),
        (F.col("method").isin("repair", "rescue") | ((F.col("method") == "fuzzy") & F.col("tie"))).alias("soft_review"),
        (F.col("method") == "rescue").alias("low_confidence"),
        F.when(F.col("top_k").isNull(), F.lit("no_allowed_values"))
        .when(F.col("method") == "exact", F.lit("exact_normalized_match"))
        .when((F.col("method") == "fuzzy") & ~F.col("tie"), F.format_string("fuzzy_score_%.3f", "best_score"))
        .when(F.col("method") == "fuzzy", F.format_string("near_tie_delta_%.3f", F.col("best_score") - F.col("second_score")))
        .when(F.col("method") == "repair", F.lit("repair_choice"))
        .when(F.col("method") == "rescue", F.format_string("mandatory_rescue_score_%.3f_floor_%.2f", "best_score", "floor"))
        .otherwise(F.format_string("score_%.3f_below_floor_or_near_tie", "best_score")).alias("reason"),
    )


# ---------------------------------------------------------------- colours


def cluster_table(spark: SparkSession, clusters: dict[str, list[str]] | None = None) -> DataFrame:
    """(cluster, term, term_norm, position) of colour words; add rows of your own by union."""
    rows = []
    for position, (cluster, terms) in enumerate((clusters or V.COLOR_CLUSTERS).items()):
        rows += [(cluster, term, position) for term in terms]
    frame = spark.createDataFrame(rows, "cluster string, term string, position int")
    return frame.withColumn("term_norm", norm_color("term"))


def map_color(
    requests: DataFrame,
    allowed: DataFrame,
    group: list[str],
    synonyms: DataFrame,
    embeddings: DataFrame | None = None,
    k: int = 5,
) -> DataFrame:
    """(group, detected) -> listed colour: exact, same cluster, closest; optional vector rerank.

    ``allowed``: group, value. ``embeddings``: (text, vector) for detected and listed texts.
    Columns: group, detected, mapped_value, score, method, top_k, needs_review, cluster.
    """
    asked = requests.select(*group, "detected").where(strip("detected") != "").distinct()
    # a term listed under several clusters counts for the last of them
    cluster_of = synonyms.groupBy("term_norm").agg(F.max_by("cluster", "position").alias("cluster"))
    clusters_of = synonyms.groupBy("term_norm").agg(F.collect_set("cluster").alias("clusters"))
    queries = (
        asked.select(*group, strip("detected").alias("query")).distinct()
        .withColumn("query_norm", norm_color("query"))
        .join(cluster_of.withColumnRenamed("term_norm", "query_norm"), "query_norm", "left")
    )
    values = (
        allowed.select(*group, "value").distinct().withColumn("value_norm", norm_color("value"))
        .join(clusters_of.withColumnRenamed("term_norm", "value_norm"), "value_norm", "left")
        .withColumn("clusters", F.coalesce("clusters", F.array().cast("array<string>")))
    )
    same = (
        queries.join(values.select(*group, "value", F.col("value_norm").alias("query_norm")), [*group, "query_norm"])
        .groupBy(*group, "query")
        .agg(F.min_by("value", F.struct(F.col("value") != F.col("query"), F.col("value"))).alias("exact_value"))
    )
    ranked = rank_candidates(queries, values, group, k, V.SYNONYM_BONUS, V.SYNONYM_FLOOR)
    top = _top_k(ranked, [*group, "query"], digits=4)
    result = queries.join(top, [*group, "query"], "left").join(same, [*group, "query"], "left")
    result = result.withColumn("method", F.when(F.col("best_synonym"), F.lit("synonym")).otherwise(F.lit("fuzzy")))
    ambiguous = F.coalesce(F.col("cluster").isin(*V.AMBIGUOUS_CLUSTERS), F.lit(False))
    unsure = ambiguous | (F.col("best_score") < V.AUTO_ACCEPT) | near_tie(
        F.element_at("top_k", 1)["score"], F.get("top_k", F.lit(1))["score"], V.COLOR_TIE
    )
    if embeddings is not None:
        result = _rerank(result.withColumn("unsure", unsure), group, embeddings)
    else:
        result = result.withColumn("first_score", F.col("best_score"))
    low = F.col("exact_value").isNull() & (F.col("first_score") < V.SOFT_REVIEW)
    mapped, review = apply_threshold(F.col("best"), F.col("best_score"))
    exact = F.col("exact_value").isNotNull()
    none = F.col("best").isNull() | low
    result = result.select(
        *group, "query",
        F.when(exact, F.col("exact_value")).when(~none, mapped).alias("mapped_value"),
        F.when(exact, F.lit(1.0)).when(F.col("best").isNull(), F.lit(0.0)).when(low, F.col("first_score"))
        .otherwise(F.round("best_score", 4)).alias("score"),
        F.when(exact, F.lit("exact")).when(none, F.lit("none")).otherwise(F.col("method")).alias("method"),
        F.when(exact, F.array(F.struct(F.col("exact_value").alias("value"), F.lit(1.0).alias("score")))).otherwise(F.col("top_k")).alias("top_k"),
        F.when(exact, F.lit(False)).when(none, F.lit(True)).otherwise(review).alias("needs_review"),
        "cluster",
    )
    return asked.withColumn("query", strip("detected")).join(result, [*group, "query"], "left").drop("query")


def _rerank(result: DataFrame, group: list[str], embeddings: DataFrame) -> DataFrame:
    """Top candidates of unsure queries in the order of the blended vector score."""
    vectors = embeddings.select("text", "vector")
    keys = [*group, "query"]
    top = (
        result.where(F.col("unsure") & (F.col("best_score") >= V.SOFT_REVIEW) & F.col("exact_value").isNull())
        .select(*keys, "query_norm", F.posexplode("top_k").alias("pos", "c"))
        .select(*keys, "query_norm", "pos", "c.value", norm_color("c.value").alias("value_norm"))
        .join(vectors.select(F.col("text").alias("query"), F.col("vector").alias("qv")), "query")
        .join(vectors.select(F.col("text").alias("value"), F.col("vector").alias("vv")), "value", "left")
        .withColumn(
            "score",
            hybrid_score(
                F.coalesce(cosine(F.col("qv"), F.col("vv")), F.lit(0.0)),
                token_set_ratio_udf("query_norm", "value_norm"),
                token_overlap(F.col("query_norm"), F.col("value_norm")),
            ),
        )
    )
    order = F.struct((-F.col("score")).alias("neg"), "pos", "value", "score")
    reranked = top.groupBy(*keys).agg(F.sort_array(F.collect_list(order)).alias("_r")).select(
        *keys,
        F.transform("_r", lambda r: F.struct(r["value"].alias("value"), r["score"].alias("score"))).alias("_top"),
    )
    joined = result.withColumn("first_score", F.col("best_score")).join(reranked, keys, "left")
    moved = F.col("_top").isNotNull()
    first = F.element_at("_top", 1)
    return (
        joined.withColumn("method", F.when(moved & (F.col("method") == "fuzzy"), F.lit("semantic")).otherwise(F.col("method")))
        .withColumn("best", F.when(moved, first["value"]).otherwise(F.col("best")))
        .withColumn("best_score", F.when(moved, first["score"]).otherwise(F.col("best_score")))
        .withColumn("top_k", F.when(moved, F.col("_top")).otherwise(F.col("top_k")))
        .drop("_top", "unsure")
    )
