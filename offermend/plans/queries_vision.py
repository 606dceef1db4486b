"""Queries over palettes, detections and the fusion of text and image signals.

Palettes come from the embedding vectors: elements 3i, 3i+1, 3i+2 give a colour, i + 1 its count.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from offermend import fixed_values as V
from offermend.operators import resolver, vision
from offermend.plans.check_sql import REFERENCE, RESOLVED, VIEWS, lit, with_views
from offermend.plans.registry import query
from offermend.plans.runs import attribute_rows, located

_RGB = "CAST(floor(abs(embedding[3 * i + {}]) * 255) AS INT) % 256"
PALETTE = (
    f"pal AS (SELECT vec_id AS image_id, {_RGB.format(1)} AS r, {_RGB.format(2)} AS g, {_RGB.format(3)} AS b, i + 1 AS n "
    "FROM embeddings, unnest(range(21)) AS t(i))"
)
HSV = """x AS (SELECT *, greatest(r, g, b) / 255.0 AS v, least(r, g, b) / 255.0 AS lo FROM pal),
y AS (SELECT *, v - lo AS d, CASE WHEN v = 0 THEN 0.0 ELSE (v - lo) / v END AS s FROM x),
h AS (SELECT *, CASE WHEN d = 0 THEN 0.0 WHEN greatest(r, g, b) = r THEN (60.0 * ((g - b) / 255.0 / d) + 360.0) % 360.0
  WHEN greatest(r, g, b) = g THEN (60.0 * ((b - r) / 255.0 / d) + 120.0) % 360.0 ELSE (60.0 * ((r - g) / 255.0 / d) + 240.0) % 360.0 END AS h FROM y),
f AS (SELECT *, s < 0.10 OR v < 0.20 OR v > 0.95 AS neutral, CASE WHEN v < 0.18 THEN 'black' WHEN s < 0.12 AND v > 0.92 THEN 'white' WHEN s < 0.12 AND v > 0.70 THEN 'silver'
  WHEN s < 0.12 THEN 'gray' WHEN h BETWEEN 15 AND 70 AND v > 0.75 AND s < 0.45 THEN 'beige' WHEN h BETWEEN 15 AND 70 AND v < 0.55 THEN 'brown'
  WHEN h BETWEEN 35 AND 65 THEN 'yellow' WHEN h BETWEEN 15 AND 70 THEN 'orange' WHEN (h < 15 OR h >= 345) AND v < 0.55 THEN 'burgundy'
  WHEN (h < 15 OR h >= 345) AND v > 0.75 AND s < 0.75 THEN 'pink' WHEN h < 15 OR h >= 345 THEN 'red' WHEN h >= 330 AND v > 0.65 THEN 'pink'
  WHEN h >= 290 THEN 'purple' WHEN h <= 105 AND s < 0.35 AND v < 0.75 THEN 'khaki' WHEN h <= 170 THEN 'green' WHEN h <= 200 THEN 'turquoise'
  WHEN h <= 250 THEN 'blue' ELSE 'navy' END AS family FROM h)"""


def _palette(spark, sf_dir):
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = emb.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"))
    part = lambda k: (F.floor(F.abs(F.get("embedding", F.col("i") * 3 + k).cast("float")) * F.lit(255).cast("float")).cast("int") % 256)
    return rows.select(F.col("vec_id").alias("image_id"), part(0).alias("r"), part(1).alias("g"), part(2).alias("b"), (F.col("i") + 1).cast("bigint").alias("n"))


@query(f"WITH {PALETTE}, {HSV} SELECT image_id, r, g, b, n, round(h, 3) AS h, round(s, 4) AS s, round(v, 4) AS v, neutral, family FROM f")
def palette_families(spark, sf_dir):
    rows = vision.palette_families(_palette(spark, sf_dir))
    return rows.select("image_id", "r", "g", "b", "n", F.round("h", 3).alias("h"), F.round("s", 4).alias("s"), F.round("v", 4).alias("v"), "neutral", "family")


_NAMES = "CASE {} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in V.FAMILY_NAMES.items()) + " ELSE '' END"


@query(
    f"""WITH {PALETTE.replace('pal AS (', 'raw AS (')}, pal AS (SELECT image_id, r, g, b, sum(n) AS n FROM raw GROUP BY ALL), {HSV},
k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b) AS rn, sum(n) OVER (PARTITION BY image_id) AS total FROM f),
t AS (SELECT image_id, any_value(total) AS total, any_value(n) FILTER (WHERE rn = 1) AS n1, any_value(n) FILTER (WHERE rn = 2) AS n2, any_value(s) FILTER (WHERE rn = 1) AS s1,
  bool_or(neutral) FILTER (WHERE rn = 1) AS neu, min(rn) FILTER (WHERE rn > 1 AND n / total >= 0.12 AND NOT neutral) AS chroma,
  any_value(r) FILTER (WHERE rn = 1) AS r1, any_value(g) FILTER (WHERE rn = 1) AS g1, any_value(b) FILTER (WHERE rn = 1) AS b1,
  any_value(r) FILTER (WHERE rn = 2) AS r2, any_value(g) FILTER (WHERE rn = 2) AS g2, any_value(b) FILTER (WHERE rn = 2) AS b2 FROM k GROUP BY image_id),
d AS (SELECT t.*, CASE WHEN neu AND chroma IS NOT NULL THEN chroma ELSE 1 END AS dom FROM t),
e AS (SELECT d.*, k.family, k.n AS dn, concat('rgb(', k.r, ', ', k.g, ', ', k.b, ')') AS raw_text,
  k.family <> 'white' AND coalesce(s1 >= 0.18 AND n2 / d.total >= 0.30 AND abs(r1 - r2) + abs(g1 - g2) + abs(b1 - b2) >= 120, false) AS multi
  FROM d JOIN k ON k.image_id = d.image_id AND k.rn = d.dom),
o AS (SELECT e.*, (SELECT min(k.rn) FROM k WHERE k.image_id = e.image_id AND k.rn > 1 AND k.rn <> e.dom) AS srn FROM e)
SELECT o.image_id, raw_text AS dominant_raw, CASE WHEN multi THEN 'multicolor' ELSE o.family END AS family,
  {_NAMES.format("CASE WHEN multi THEN 'multicolor' ELSE o.family END")} AS dominant_color,
  CASE WHEN o.family = 'white' OR k.family IS NULL THEN '' ELSE {_NAMES.format('k.family')} END AS secondary_color,
  round(dn / o.total, 3) AS confidence, multi AS is_multicolor FROM o LEFT JOIN k ON k.image_id = o.image_id AND k.rn = o.srn"""
)
def palette_color(spark, sf_dir):
    return vision.palette_color(_palette(spark, sf_dir)).select("image_id", "dominant_raw", "family", "dominant_color", "secondary_color", "confidence", "is_multicolor")


@query(
    f"""WITH {PALETTE}, q AS (SELECT image_id, r // 24 * 24 AS qr, g // 24 * 24 AS qg, b // 24 * 24 AS qb, count(*) AS n FROM pal WHERE n <= 8 GROUP BY ALL),
bg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, qr, qg, qb) AS rn FROM q) WHERE rn = 1),
m AS (SELECT p.*, abs(p.r - qr) + abs(p.g - qg) + abs(p.b - qb) > 40 AND 0.2126 * p.r + 0.7152 * p.g + 0.0722 * p.b >= 35 AS keep FROM pal p JOIN bg USING (image_id)),
a AS (SELECT image_id, bool_or(keep) AS any_kept FROM m GROUP BY 1)
SELECT image_id, r, g, b, n FROM m JOIN a USING (image_id) WHERE keep OR (NOT any_kept AND NOT (r > 245 AND g > 245 AND b > 245))"""
)
def background_filter(spark, sf_dir):
    """Palette cells taken as pixels, the first eight of an image as its border."""
    pixels = _palette(spark, sf_dir).withColumn("border", F.col("n") <= 8)
    pixels = pixels.withColumn("p_r", F.col("r")).withColumn("p_g", F.col("g")).withColumn("p_b", F.col("b"))
    return vision.background_filter(pixels).select("image_id", "r", "g", "b", "n")


@query(
    with_views(*VIEWS, **REFERENCE)
    + "SELECT DISTINCT v.cat, f.family, CASE f.family WHEN 'red' THEN 'Rosu' WHEN 'blue' THEN 'Albastru' END AS value "
    "FROM vals v, (VALUES ('red'), ('blue'), ('green')) AS f(family) WHERE v.char_name = 'Culoare de baza'"
)
def pick_accepted_color(spark, sf_dir):
    _, index, _ = located(spark, sf_dir)
    lists = index.values.where("char_name = 'Culoare de baza'").select("cat", "value")
    asked = lists.select("cat").distinct().select("cat", F.explode(F.array(*[F.lit(x) for x in ("red", "blue", "green")])).alias("family"))
    return vision.pick_accepted_color(asked, lists, ["cat"])


@query(
    "SELECT p_type AS cat, CASE WHEN max(CAST(p_size = 50 AS INT)) = 1 THEN 'Multicolor' ELSE 'Multi' END AS multicolor FROM part GROUP BY p_type"
)
def multicolor_value(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    lists = parts.select(F.col("p_type").alias("cat"), F.when(F.col("p_size") == 50, "Multicolor").when(F.col("p_size") % 2 == 0, "Multi").otherwise("Rosu").alias("value")).distinct()
    return vision.multicolor_value(lists, ["cat"])


@query("SELECT DISTINCT CASE p_type WHEN 'SMALL' THEN 'Watches' ELSE p_type END AS category, CAST(CASE p_type WHEN 'SMALL' THEN 0.4 ELSE 0.6 END AS DOUBLE) AS min_confidence, "
       "CASE p_type WHEN 'SMALL' THEN 'Watches override' ELSE 'default' END AS source FROM part")
def category_overrides(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return vision.color_rules(parts.select(F.when(F.col("p_type") == "SMALL", "Watches").otherwise(F.col("p_type")).alias("category")))


@query()
def apply_color(spark, sf_dir):
    """Colour of each offer's image (its id modulo the vectors) filled into its colour attribute."""
    _, index, offers = located(spark, sf_dir)
    live = offers.where("cat IS NOT NULL")
    colors = vision.palette_color(_palette(spark, sf_dir))
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    pictures = live.select("offer_id", (F.col("ordinal") % n).alias("image_id")).join(colors, "image_id").drop("image_id").withColumnRenamed("offer_id", "image_id")
    return vision.apply_color(live, pictures, attribute_rows(live), index, resolver.cluster_table(spark))


SIGNALS = """s AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 5 = 1 THEN 'unknown' ELSE event_type END AS text_candidate, (event_id % 100) / 100.0 AS tc,
  CASE WHEN event_id % 6 = 0 THEN '' WHEN event_id % 6 < 3 THEN upper(event_type) ELSE 'other' END AS image_candidate, (user_id % 50) / 50.0 AS ic FROM events WHERE event_type IS NOT NULL),
u AS (SELECT *, text_candidate NOT IN ('', 'unknown') AS tok, image_candidate <> '' AND ic >= 0.25 AS iok FROM s),
w AS (SELECT *, tok AND iok AND lower(text_candidate) = lower(image_candidate) AS same FROM u),
c AS (SELECT *, CASE WHEN image_candidate = '' THEN 'text_only' WHEN tok AND tc >= 0.75 THEN 'high_text' WHEN (NOT tok OR tc < 0.30) AND iok AND ic >= 0.75 THEN 'strong_image'
  WHEN same THEN 'agree' WHEN CASE WHEN tok THEN tc ELSE 0 END < 0.2 AND CASE WHEN iok THEN ic ELSE 0 END < 0.2 THEN 'both_weak'
  WHEN tok AND tc >= CASE WHEN iok THEN ic ELSE 0 END THEN 'conflict_text' WHEN iok THEN 'conflict_image' ELSE 'conflict_rest' END AS k FROM w)
"""


@query(
    "WITH " + SIGNALS + """SELECT event_id, k AS case_name, CASE WHEN k = 'both_weak' THEN '' WHEN k IN ('strong_image', 'conflict_image') THEN image_candidate ELSE text_candidate END AS final_category,
  round(CASE k WHEN 'text_only' THEN tc WHEN 'high_text' THEN least(tc + CASE WHEN same THEN 0.05 ELSE 0 END, 1) WHEN 'strong_image' THEN ic
    WHEN 'agree' THEN least((tc + ic) / 2 + CASE WHEN (tc + ic) / 2 >= 0.5 THEN 0.1 ELSE 0 END, 1) WHEN 'both_weak' THEN 0 WHEN 'conflict_image' THEN ic * 0.8 ELSE tc * 0.8 END, 4) AS final_confidence,
  CASE WHEN k = 'text_only' THEN k WHEN k IN ('high_text', 'agree') THEN 'prefer_text' WHEN k = 'strong_image' THEN 'prefer_image' ELSE 'review' END AS rule_applied,
  k IN ('both_weak', 'conflict_text', 'conflict_image', 'conflict_rest') OR (k = 'high_text' AND iok AND NOT same AND ic >= 0.75) AS needs_review FROM c"""
)
def fuse_category(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type IS NOT NULL")
    m5, m6 = F.col("event_id") % 5, F.col("event_id") % 6
    signals = e.select(
        "event_id", F.when(m5 == 0, "").when(m5 == 1, "unknown").otherwise(F.col("event_type")).alias("text_candidate"), ((F.col("event_id") % 100) / 100.0).alias("text_confidence"),
        F.when(m6 == 0, "").when(m6 < 3, F.upper("event_type")).otherwise("other").alias("image_candidate"), ((F.col("user_id") % 50) / 50.0).alias("image_confidence"),
    )
    out = vision.fuse_category(signals)
    return out.select("event_id", "case_name", "final_category", F.round("final_confidence", 4).alias("final_confidence"), "rule_applied", "needs_review")


@query("SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN 0.95 WHEN 1 THEN 0.75 WHEN 2 THEN 0.7 WHEN 3 THEN 0.7 ELSE 0.0 END AS DOUBLE) AS confidence FROM events")
def action_confidence(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("ok", "assigned", "cat_assigned", "ai_assigned", "unknown")])
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", vision.action_confidence(F.element_at(names, (F.col("event_id") % 5 + 1).cast("int"))).alias("confidence"))


_ASKED = "SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN 'Stil:' WHEN 1 THEN 'STIL:' WHEN 2 THEN 'Material:' ELSE 'color' END AS char_input FROM part"


@query(f"WITH a AS ({_ASKED}) SELECT char_input, char_input <> 'Material:' AS eligible, CAST(CASE lower(char_input) WHEN 'stil:' THEN 0.7 WHEN 'color' THEN 0.6 END AS DOUBLE) AS min_confidence, "
       "CASE lower(char_input) WHEN 'stil:' THEN 'review' WHEN 'color' THEN 'prefer_text' END AS conflict_action FROM a")
def fusion_policy(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("part")
    return vision.fusion_policy(spark.sql(_ASKED), vision.policy_table(spark))


def _attr_signals(spark, sf_dir):
    _, index, offers = located(spark, sf_dir)
    n = F.col("ordinal")
    rows = offers.where("cat IS NOT NULL").select(
        "offer_id", "cat", F.lit("Stil:").alias("char_input"), F.when(n % 2 == 0, "Profil jos").alias("text_value"), F.lit(0.95).alias("text_confidence"),
        F.lit("text").alias("text_source"), F.when(n % 3 == 0, "PROFIL JOS").when(n % 3 == 1, "profil inalt").otherwise("qqq").alias("value_input"),
        ((n % 10) / 10.0).alias("image_confidence"), F.lit("vision").alias("image_source"),
    )
    return index, rows


FUSED = with_views(*VIEWS, **REFERENCE, resolved=RESOLVED) + """, s AS (SELECT o.offer_id, o.ordinal % 2 = 0 AS has_text,
  CASE o.ordinal % 3 WHEN 0 THEN 'Profil jos' WHEN 1 THEN 'Profil inalt' END AS seen, (o.ordinal % 10) / 10.0 AS conf FROM fx_offers o JOIN resolved r USING (category)),
a AS (SELECT *, CASE WHEN has_text AND seen = 'Profil inalt' AND conf >= 0.7 THEN 'conflict_review' WHEN has_text THEN 'keep_text'
  WHEN seen IS NOT NULL AND conf >= 0.7 THEN 'use_vision' ELSE 'skip' END AS action FROM s)
"""


@query(
    FUSED + """SELECT offer_id, action, CASE action WHEN 'use_vision' THEN seen WHEN 'skip' THEN NULL ELSE 'Profil jos' END AS final_value,
  round(CASE action WHEN 'use_vision' THEN conf WHEN 'conflict_review' THEN 0.95 * 0.9 WHEN 'keep_text' THEN CASE WHEN seen = 'Profil jos' THEN 1.0 ELSE 0.95 END ELSE 0 END, 4) AS final_confidence FROM a"""
)
def fuse_attribute(spark, sf_dir):
    index, rows = _attr_signals(spark, sf_dir)
    out = vision.fuse_attributes(rows, index, vision.policy_table(spark), fuzzy=False)
    return out.select("offer_id", "action", "final_value", F.round("final_confidence", 4).alias("final_confidence"))


@query(FUSED + "SELECT offer_id, action FROM a WHERE action IN ('use_vision', 'conflict_review')")
def fuse_all(spark, sf_dir):
    index, rows = _attr_signals(spark, sf_dir)
    return vision.fuse_all(rows, index, vision.policy_table(spark), fuzzy=False).select("offer_id", "action")


@query(
    FUSED + """SELECT s.offer_id, s.seen AS value, s.seen IS NOT NULL AND NOT s.has_text AS accept,
  CASE WHEN s.seen IS NULL THEN 'not_in_allowed_list' WHEN s.has_text THEN 'already_filled' ELSE 'ok' END AS reason FROM s"""
)
def image_suggestions_filter(spark, sf_dir):
    index, rows = _attr_signals(spark, sf_dir)
    filled = rows.where("text_value IS NOT NULL").select("offer_id", "char_input", F.col("text_value").alias("value_input"))
    out = vision.image_suggestions_filter(rows.select("offer_id", "cat", "char_input", "value_input"), rows, filled, index, fuzzy=False)
    return out.select("offer_id", "value", "accept", "reason")


@query(
    "WITH d AS (SELECT user_id AS image_id, CASE event_id % 4 WHEN 0 THEN 'surfboard' WHEN 1 THEN 'Person' WHEN 2 THEN 'tie' ELSE 'clock' END AS label, (event_id % 97) / 97.0 AS confidence FROM events) "
    "SELECT image_id, arg_max(label, (confidence, label)) AS label, max(confidence) >= 0.5 AS crop FROM d WHERE label <> 'surfboard' GROUP BY 1"
)
def best_detection(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    label = F.element_at(F.array(*[F.lit(x) for x in ("surfboard", "Person", "tie", "clock")]), (F.col("event_id") % 4 + 1).cast("int"))
    rows = e.select(F.col("user_id").alias("image_id"), label.alias("label"), ((F.col("event_id") % 97) / 97.0).alias("confidence"))
    return vision.best_detection(rows).select("image_id", "label", "crop")


@query(
    "WITH p AS (SELECT p_type AS image_id, p_name AS label, p_retailprice AS score, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_name) AS rn FROM part) "
    "SELECT image_id, bool_or(contains(label, 'ring') OR contains('ring', label)) AS validates FROM p WHERE rn <= 2 GROUP BY 1"
)
def validates_label(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    scores = parts.select(F.col("p_type").alias("image_id"), F.col("p_name").alias("label"), F.col("p_retailprice").alias("score"))
    detected = parts.select(F.col("p_type").alias("image_id"), F.lit("Ring").alias("detected_label")).distinct()
    return vision.validates_label(scores, detected)


@query(f"SELECT DISTINCT p_name AS category, CAST({1 + len(V.CLIP_LABELS)} AS INT) AS n, p_name AS first FROM part")
def clip_labels(spark, sf_dir):
    rows = vision.clip_labels(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("category")))
    return rows.select("category", F.size("labels").alias("n"), F.element_at("labels", 1).alias("first"))


_IMAGES = "SELECT l_orderkey AS offer_id, l_linenumber AS image_no, l_returnflag AS dominant_color, l_discount AS confidence FROM lineitem"


def _images(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lineitem")
    return spark.sql(_IMAGES).groupBy("offer_id", "image_no").agg(F.max("dominant_color").alias("dominant_color"), F.max("confidence").alias("confidence"))


_GROUPED = f"SELECT offer_id, image_no, max(dominant_color) AS dominant_color, max(confidence) AS confidence FROM ({_IMAGES}) GROUP BY 1, 2"


@query(f"WITH i AS ({_GROUPED}) SELECT offer_id, arg_max(dominant_color, (confidence, -image_no)) AS dominant_color, max(confidence) AS confidence FROM i GROUP BY 1")
def image_best_confidence(spark, sf_dir):
    return vision.image_strategy(_images(spark, sf_dir), "best_confidence")


@query(
    f"WITH i AS ({_GROUPED}), v AS (SELECT offer_id, dominant_color, count(*) AS n, max(confidence) AS confidence FROM i GROUP BY 1, 2) "
    "SELECT offer_id, arg_max(dominant_color, (n, confidence, dominant_color)) AS dominant_color, arg_max(confidence, (n, confidence, dominant_color)) AS confidence FROM v GROUP BY 1"
)
def image_vote(spark, sf_dir):
    return vision.image_strategy(_images(spark, sf_dir), "aggregate_vote")
