"""Queries over value matching, the gate, and scored resolution."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offermend import fixed_values as V
from offermend.functions import fuzzy
from offermend.functions.text import norm_color
from offermend.operators import matching, resolver
from offermend.operators.indexes import ReferenceIndex
from offermend.plans.check_sql import REFERENCE, RESOLVED, VIEWS, with_views
from offermend.plans.registry import query
from offermend.plans.runs import attribute_rows, located

BASE = dict(
    **REFERENCE, resolved=RESOLVED,
    pairs="SELECT DISTINCT r.cat, a.char_name AS char_input FROM fx_attributes a JOIN resolved r USING (category)",
    asked="SELECT DISTINCT r.cat, a.char_name AS char_input, a.value AS value_input FROM fx_attributes a JOIN resolved r USING (category)",
    named="SELECT a.*, t.char_name AS canonical, coalesce(t.restrictive, true) AS restrictive FROM asked a "
    "LEFT JOIN attrs t ON t.cat = a.cat AND t.char_key = lower(rtrim(a.char_input, ':'))",
    found="""SELECT n.*, count(v.value) > 0 AS has_values, coalesce(bool_or(v.value = n.value_input), false) AS exact_hit,
    min(v.value) FILTER (WHERE lower(v.value) = lower(n.value_input)) AS lower_value,
    coalesce(max(v.value) FILTER (WHERE v.value = n.value_input), max(v.value) FILTER (WHERE v.value = upper(n.value_input)),
             min(v.value) FILTER (WHERE lower(v.value) = lower(n.value_input))) AS listed
  FROM named n LEFT JOIN vals v ON v.cat = n.cat AND v.char_name = coalesce(n.canonical, n.char_input) GROUP BY ALL""",
)
SQL = with_views(*VIEWS, **BASE)


def _asked(spark, sf_dir):
    _, index, offers = located(spark, sf_dir)
    return index, attribute_rows(offers).where("cat IS NOT NULL")


@query(SQL + "SELECT DISTINCT cat, char_input, canonical, restrictive FROM named")
def canonical_char(spark, sf_dir):
    index, rows = _asked(spark, sf_dir)
    return matching.canonical_chars(rows, index).select("cat", "char_input", "canonical", "restrictive")


@query(SQL + "SELECT DISTINCT cat, char_input FROM named WHERE canonical IS NOT NULL")
def has_char(spark, sf_dir):
    index, rows = _asked(spark, sf_dir)
    return matching.has_char(rows, index)


@query(SQL + "SELECT DISTINCT cat, char_input, restrictive FROM named")
def is_restrictive(spark, sf_dir):
    index, rows = _asked(spark, sf_dir)
    return matching.is_restrictive(rows, index)


@query(SQL + "SELECT cat, char_input, value_input, canonical, has_values, exact_hit, lower_value, listed AS found FROM found")
def match_values(spark, sf_dir):
    """Listed values by exact spellings and normalisation."""
    index, rows = _asked(spark, sf_dir)
    return matching.match_values(rows, index, fuzzy=False).drop("restrictive", "tier", "fallback")


@query()
def find_valid(spark, sf_dir):
    """Listed values by every tier, closeness included."""
    index, rows = _asked(spark, sf_dir)
    return matching.find_valid(rows, index)


@query(
    SQL
    + """SELECT a.cat, a.char_input, a.value_input, min(v.value) AS value FROM asked a JOIN cats c ON c.cat = a.cat AND c.category_name = 'SMALL'
JOIN vals v ON v.cat <> a.cat AND v.char_name = 'Kind:' AND lower(v.value) = lower(a.value_input)
WHERE a.char_input = 'Kind' GROUP BY ALL"""
)
def marketplace_fallback(spark, sf_dir):
    """One category's kinds are taken from its list, so its values are found in other categories."""
    fx, _, offers = located(spark, sf_dir)
    small = fx["fx_categories"].where("category_name = 'SMALL'").select("category_id", F.lit("Kind:").alias("characteristic_name"))
    fewer = fx["fx_values"].join(small, ["category_id", "characteristic_name"], "left_anti")
    index = ReferenceIndex.build(fx["fx_categories"], fx["fx_characteristics"], fewer)
    return matching.marketplace_fallback(attribute_rows(offers), index)


GATE_SQL = SQL + """SELECT f.cat, f.char_input, f.value_input, f.canonical AS char_canonical,
  CASE WHEN f.canonical IS NOT NULL THEN coalesce(f.listed, CASE WHEN NOT f.has_values THEN f.value_input END) END AS value_mapped,
  f.canonical IS NOT NULL AND (f.listed IS NOT NULL OR NOT f.has_values) AS accept,
  CASE WHEN f.canonical IS NULL THEN 'char_not_in_characteristics' WHEN f.listed IS NOT NULL OR NOT f.has_values THEN 'ok'
       ELSE 'value_not_in_values_table' END AS reason, count(*) AS n
FROM fx_attributes a JOIN resolved r USING (category)
JOIN found f ON f.cat = r.cat AND f.char_input = a.char_name AND f.value_input = a.value GROUP BY ALL"""


@query(GATE_SQL)
def validate_gate(spark, sf_dir):
    """The gate without closeness over every existing attribute, audit rows counted."""
    index, rows = _asked(spark, sf_dir)
    audit = matching.validate_gate(rows.withColumn("source", F.lit("check")), index, fuzzy=False)
    return audit.groupBy("cat", "char_input", "value_input", "char_canonical", "value_mapped", "accept", "reason").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- scored resolution


@query()
def resolve_values(spark, sf_dir):
    """Colour and kind words not listed as they are, resolved by score."""
    _, index, offers = located(spark, sf_dir)
    word = F.concat(F.substring_index("title", " ", 1), F.lit("s"))
    rows = offers.where("cat IS NOT NULL").select(
        "offer_id", "cat", F.lit("Color:").alias("char_name"), word.alias("value_input"), F.lit(True).alias("is_mandatory"), F.lit(0).alias("position")
    )
    out = resolver.resolve_values(rows, index)
    return out.select("offer_id", "value_input", "value", "method", F.round("score", 6).alias("score"), "needs_review", "reason", F.size("top_k").alias("n_top"))


@query()
def map_color(spark, sf_dir):
    """Colour words of the titles mapped to the listed base colours."""
    _, index, offers = located(spark, sf_dir)
    asked = offers.where("cat IS NOT NULL").select("cat", F.lit("Culoare de baza").alias("char_name"), F.substring_index("title", " ", 1).alias("detected"))
    lists = index.values.select("cat", "char_name", "value")
    out = resolver.map_color(asked, lists, ["cat", "char_name"], resolver.cluster_table(spark))
    return out.select("cat", "detected", "mapped_value", "score", "method", "needs_review", "cluster", F.size("top_k").alias("n_top"))


@query()
def token_scores(spark, sf_dir):
    """Token score of every part name against its brand's first part name."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    first = parts.groupBy("p_brand").agg(F.min_by("p_name", "p_partkey").alias("first_name"))
    pairs = parts.join(first, "p_brand").select("p_name", "first_name").distinct()
    return pairs.withColumn("score", fuzzy.token_score_udf(norm_color("p_name"), norm_color("first_name")))


@query("SELECT DISTINCT p_type, substr(p_name, 1, 2) || substr(p_name, 4) AS query, p_name AS candidate, round(2.0 * (length(p_name) - 1) / (2 * length(p_name) - 1), 6)::DOUBLE AS ratio FROM part")
def closest_names(spark, sf_dir):
    """Part names with a letter dropped, matched back to the names of their type."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    typos = parts.select("p_type", F.concat(F.substring("p_name", 1, 2), F.substring("p_name", 4, 99)).alias("query"))
    names = parts.select("p_type", F.col("p_name").alias("candidate"))
    return fuzzy.closest(typos, names, ["p_type"], "query", "candidate", 0.80).withColumn("ratio", F.round("ratio", 6))


@query(
    with_views("fx_offers", "fx_categories") + "SELECT DISTINCT ' ' || lower(o.category) || ' ' AS suggested, c.category_name FROM fx_offers o "
    "LEFT JOIN (SELECT DISTINCT category_name FROM fx_categories) c ON lower(c.category_name) = lower(o.category) WHERE o.category <> ''"
)
def match_suggested_categories(spark, sf_dir):
    fx, index, _ = located(spark, sf_dir)
    replies = fx["fx_offers"].where("category <> ''").select(F.concat(F.lit(" "), F.lower("category"), F.lit(" ")).alias("suggested"))
    return matching.match_suggested_categories(replies, index)


# ---------------------------------------------------------------- vectors

_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(c.center AS DOUBLE[]))"
_CENTERS = "SELECT label, list(x ORDER BY pos) AS center FROM (SELECT label, pos, avg(v) AS x FROM (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1"


def _centers(emb):
    """Mean vector per label (ten labels)."""
    cells = emb.select("label", F.posexplode("embedding").alias("pos", "v")).groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("x"))
    return cells.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("center"))


def _scored(spark, sf_dir):
    """Every vector against the centres of all labels (one row of them is sent to the vectors)."""
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    centers = _centers(emb.where("label IS NOT NULL")).agg(F.collect_list(F.struct(F.col("label").alias("candidate"), "center")).alias("centers"))
    pairs = emb.crossJoin(F.broadcast(centers)).withColumn("c", F.explode("centers")).drop("centers").select("*", "c.candidate", "c.center").drop("c")
    return pairs.withColumn("score", fuzzy.cosine(F.col("embedding"), F.col("center")))


_PAIRS = (
    f"WITH c AS ({_CENTERS}), s AS (SELECT a.vec_id, c.label AS candidate, {_COS} AS score FROM embeddings a CROSS JOIN c WHERE c.label IS NOT NULL) "
)


@query(_PAIRS + "SELECT vec_id, candidate, round(score, 4) + 0.0 AS score FROM s")
def cosine_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("vec_id", "candidate", (F.round("score", 4) + F.lit(0.0)).alias("score"))


@query(
    _PAIRS + "SELECT vec_id, candidate, CAST(rank AS INT) AS rank FROM "
    "(SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, candidate) AS rank FROM s) WHERE rank <= 3"
)
def top_k_candidates(spark, sf_dir):
    order = W.partitionBy("vec_id").orderBy(F.desc("score"), "candidate")
    return _scored(spark, sf_dir).withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("vec_id", "candidate", "rank")


@query(
    _PAIRS.rstrip() + ", r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS next FROM s "
    "WINDOW w AS (PARTITION BY vec_id ORDER BY score DESC, candidate)) "
    f"SELECT vec_id, candidate, score - next < {V.RESOLVER_TIE} AS near_tie FROM r WHERE rank = 1"
)
def near_tie(spark, sf_dir):
    order = W.partitionBy("vec_id").orderBy(F.desc("score"), "candidate")
    ranked = _scored(spark, sf_dir).withColumn("rank", F.row_number().over(order))
    return resolver.with_ties(ranked, ["vec_id"], V.RESOLVER_TIE).where("rank = 1").select("vec_id", "candidate", "near_tie")


@query(
    _PAIRS + "SELECT vec_id, candidate, round(0.65 * score + 0.25 * ((vec_id % 7) / 7.0) "
    "+ 0.10 * ((vec_id % 5) / 5.0), 6) + 0.0 AS score FROM s"
)
def hybrid_score(spark, sf_dir):
    score = fuzzy.hybrid_score(F.col("score"), (F.col("vec_id") % 7) / 7.0, (F.col("vec_id") % 5) / 5.0)
    return _scored(spark, sf_dir).select("vec_id", "candidate", (score + F.lit(0.0)).alias("score"))


@query(
    "SELECT event_id, CASE WHEN (event_id % 101) / 100.0 >= 0.68 THEN event_type END AS value, "
    "event_type IS NULL OR (event_id % 101) / 100.0 < 0.82 AS needs_review FROM events"
)
def threshold(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("score", (F.col("event_id") % 101) / 100.0)
    value, review = resolver.apply_threshold(F.col("event_type"), F.col("score"))
    return events.select("event_id", value.alias("value"), review.alias("needs_review"))

