"""Queries over requests, replies, knowledge and caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from offermend.functions import replies
from offermend.functions.text import norm_title
from offermend.operators import knowledge, suggest
from offermend.plans.check_sql import REFERENCE, RESOLVED, VIEWS, with_views
from offermend.plans.fixtures import load
from offermend.plans.registry import query
from offermend.plans.runs import attribute_rows, located
from offermend.session import staged

ALL = with_views(*VIEWS, **REFERENCE, resolved=RESOLVED)
REPLY = (
    "concat('```json\\n{\"_reasoning\": \"x\", \"Color\": \"', upper({0}), '\", \"Kind\": [\"zzz\", \"', {1}, '\"], \"Note\": \"from ', {0}, '\"}\\n```')"
)


def _words():
    return F.substring_index("title", " ", 1), F.element_at(F.split("title", " "), 2)


def reply_text():
    """A model's reply to each offer: a colour in capitals, a list of kinds, a free note."""
    first, second = _words()
    return F.concat(
        F.lit('```json\n{"_reasoning": "x", "Color": "'), F.upper(first), F.lit('", "Kind": ["zzz", "'), second,
        F.lit('"], "Note": "from '), first, F.lit('"}\n```'),
    )


def suggestion_rows(fx):
    return replies.reply_rows(fx["fx_offers"].select("offer_id", reply_text().alias("reply")))


@query(
    with_views("fx_offers") + "SELECT offer_id, 'Color' AS char_input, upper(split_part(title, ' ', 1)) AS value_input FROM fx_offers "
    "UNION ALL SELECT offer_id, 'Kind', concat('[\"zzz\",\"', split_part(title, ' ', 2), '\"]') FROM fx_offers "
    "UNION ALL SELECT offer_id, 'Note', concat('from ', split_part(title, ' ', 1)) FROM fx_offers"
)
def parse_json_reply(spark, sf_dir):
    return suggestion_rows(load(spark, sf_dir)).select("offer_id", "char_input", "value_input")


def _located_suggestions(spark, sf_dir):
    fx, index, offers = located(spark, sf_dir)
    rows = suggestion_rows(fx).join(offers.where("cat IS NOT NULL").select("offer_id", "cat"), "offer_id")
    return index, rows


@query(
    ALL + """SELECT o.offer_id, CASE WHEN EXISTS (SELECT 1 FROM vals v WHERE v.cat = r.cat AND v.char_name = 'Kind:' AND v.value = split_part(o.title, ' ', 2))
  THEN split_part(o.title, ' ', 2) ELSE 'zzz' END AS value_input FROM fx_offers o JOIN resolved r USING (category)"""
)
def coerce_array(spark, sf_dir):
    index, rows = _located_suggestions(spark, sf_dir)
    return suggest.coerce_arrays(rows.where("char_input = 'Kind'"), index, fuzzy=False).select("offer_id", "value_input")


@query()
def accept_suggestions(spark, sf_dir):
    index, rows = _located_suggestions(spark, sf_dir)
    out = suggest.accept_suggestions(rows, index)
    return out.select("offer_id", "char_input", "value_input", "value", "method", "needs_review", "reason")


LISTS = """, lists AS (SELECT cat, char_name, count(*) AS n, string_agg(value, '|' ORDER BY value) AS listed FROM vals GROUP BY 1, 2),
options AS (SELECT o.offer_id, r.cat, l.char_name, l.n, l.listed FROM fx_offers o JOIN resolved r USING (category) JOIN lists l ON l.cat = r.cat
  WHERE NOT EXISTS (SELECT 1 FROM fx_attributes a WHERE a.offer_id = o.offer_id AND a.char_name = l.char_name))
"""


@query(ALL + LISTS + "SELECT offer_id, char_name, n AS n_values, md5(listed) AS options FROM options")
def fillable_options(spark, sf_dir):
    _, index, offers = located(spark, sf_dir)
    out = suggest.fillable_options(offers.where("cat IS NOT NULL"), attribute_rows(offers), index)
    return out.select("offer_id", "char_name", "n_values", F.md5(F.array_join("options", "|")).alias("options"))


def _fields(spark, sf_dir):
    _, index, offers = located(spark, sf_dir)
    missing = suggest.fillable_options(offers.where("cat IS NOT NULL"), attribute_rows(offers), index)
    return index, offers, suggest.prompt_fields(missing, index)


@query(
    ALL + LISTS + """, flagged AS (SELECT p.*, coalesce((SELECT bool_or(t.mandatory) FROM attrs t WHERE t.cat = p.cat AND t.char_name = p.char_name), false) AS mandatory FROM options p),
ranked AS (SELECT *, row_number() OVER (PARTITION BY offer_id, mandatory ORDER BY char_name) AS rn, sum(CAST(mandatory AS INT)) OVER (PARTITION BY offer_id) AS m FROM flagged)
SELECT offer_id, char_name, mandatory, CAST(CASE WHEN mandatory THEN rn ELSE m + rn END AS BIGINT) AS position FROM ranked"""
)
def prompt_fields(spark, sf_dir):
    return _fields(spark, sf_dir)[2].select("offer_id", "char_name", "mandatory", F.col("position").cast("bigint").alias("position"))


@query(
    ALL + """, c AS (SELECT o.offer_id, t.char_name, t.mandatory, t.ordinal, (SELECT count(*) FROM vals v WHERE v.cat = r.cat AND v.char_name = t.char_name) AS n,
  t.char_name = 'Brand' AS known, coalesce(o.description, '') AS d FROM fx_offers o JOIN resolved r USING (category) JOIN attrs t ON t.cat = r.cat),
s AS (SELECT *, CASE WHEN known THEN 3 ELSE 0 END + CASE WHEN contains(lower(d), lower(char_name)) THEN 2 ELSE 0 END + CASE WHEN n BETWEEN 1 AND 9 THEN 1 ELSE 0 END AS score FROM c)
SELECT offer_id, char_name, score FROM s"""
)
def schema_select(spark, sf_dir):
    return _schema_candidates(spark, sf_dir).select("offer_id", "char_name", "score")


def _schema_candidates(spark, sf_dir):
    _, index, offers = located(spark, sf_dir)
    sizes = index.values.groupBy("cat", "char_name").agg(F.count("*").alias("n_values"))
    attributes = staged(index.attributes.join(sizes, ["cat", "char_name"], "left").na.fill(0, ["n_values"]))
    # dealt by offer before they meet the attributes: what is gathered by offer later is not shuffled
    asked = offers.where("cat IS NOT NULL").select("offer_id", "cat", F.coalesce("description", F.lit("")).alias("description")).repartition("offer_id")
    rows = asked.join(
        attributes.select("cat", "char_name", F.col("mandatory").alias("is_mandatory"), "ordinal", "n_values"), "cat"
    ).withColumn("known", F.col("char_name") == "Brand")
    return suggest.schema_select(rows)


@query()
def json_schema(spark, sf_dir):
    _, index, _ = located(spark, sf_dir)
    chosen = _schema_candidates(spark, sf_dir)
    lists = staged(suggest.attribute_lists(index).select("cat", "char_name", F.col("first_values").alias("values")))
    rows = chosen.join(lists, ["cat", "char_name"], "left").withColumn("position", F.col("ordinal"))
    return suggest.json_schema(rows)


@query()
def build_prompts(spark, sf_dir):
    _, offers, fields = _fields(spark, sf_dir)
    rows = offers.select("offer_id", "title", "description", "category", "ean", "brand", *[F.lit(None).cast("string").alias(c) for c in ("sku", "weight", "warranty")])
    return suggest.build_prompts(rows, suggest.display_names(fields), attribute_rows(offers))


@query()
def image_prompts(spark, sf_dir):
    _, offers, fields = _fields(spark, sf_dir)
    return suggest.image_prompts(offers.withColumn("marketplace", F.lit("shop")), fields)


@query(
    with_views("fx_offers") + """, t AS (SELECT count(*) AS c FROM fx_offers)
SELECT b AS batch, CAST(least(60, c - b * 60) AS BIGINT) AS n, CAST(least(60, c - b * 60) AS BIGINT) AS lines FROM t, unnest(range(0, (c + 59) // 60)) AS u(b)"""
)
def batches(spark, sf_dir):
    """Every batch holds sixty offers on lines of their own, the last one the rest."""
    rows = suggest.batches(load(spark, sf_dir)["fx_offers"])
    return rows.groupBy("batch").agg(F.count("*").alias("n"), F.countDistinct("line").alias("lines"))


@query()
def category_requests(spark, sf_dir):
    rows = suggest.category_requests(load(spark, sf_dir)["fx_offers"])
    return rows.select("batch", "prompt", F.size("offer_ids").alias("n_offers"))


@query()
def apply_suggester(spark, sf_dir):
    """A user function over batched requests; this one answers with the request's length."""
    requests = suggest.category_requests(load(spark, sf_dir)["fx_offers"]).select("batch", "prompt")
    return suggest.apply_suggester(requests, lambda prompt: str(len(prompt))).select("batch", "reply")


@query(
    with_views("fx_offers", "fx_attributes") + "SELECT o.offer_id, coalesce(o.brand, '') AS brand FROM fx_offers o"
)
def brand_of(spark, sf_dir):
    fx, _, offers = located(spark, sf_dir)
    return suggest.brand_of(offers, attribute_rows(offers)).select("offer_id", F.coalesce("brand", F.lit("")).alias("brand"))


@query(
    "SELECT event_id, CAST(1 + user_id % 2 AS INT) AS agree, CAST(1 - user_id % 2 AS INT) AS only_structured, CAST(1 - user_id % 2 AS INT) AS only_plain, "
    "CASE WHEN event_type IS NULL THEN 0 ELSE CAST(event_id % 3 <> 0 AS INT) END AS conflicts FROM events WHERE event_type IS NOT NULL"
)
def shadow_diff(spark, sf_dir):
    """Two maps per event: one shared key with a value that may differ, one key shared by odd users."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type IS NOT NULL")
    odd = F.col("user_id") % 2 == 1
    plain = F.create_map(F.lit("a"), F.upper("event_type"), F.when(odd, "b").otherwise("p"), F.lit("1"))
    other = F.create_map(F.lit("a"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), "event_type")).otherwise(F.lit("x")), F.when(odd, "b").otherwise("s"), F.lit("1"))
    d = e.select("event_id", suggest.shadow_diff(plain, other).alias("d"))
    return d.select(
        "event_id", F.size("d.agree").alias("agree"), F.size("d.only_structured").alias("only_structured"), F.size("d.only_plain").alias("only_plain"),
        F.size(F.map_keys("d.value_conflicts")).alias("conflicts"),
    )


@query(
    ALL + """SELECT o.offer_id, CASE WHEN EXISTS (SELECT 1 FROM vals v WHERE v.cat = r.cat AND v.char_name = 'Color:' AND v.value = split_part(o.title, ' ', 1))
  THEN concat('Color=', split_part(o.title, ' ', 1)) ELSE 'Note=plain' END AS final,
  NOT EXISTS (SELECT 1 FROM vals v WHERE v.cat = r.cat AND v.char_name = 'Color:' AND v.value = split_part(o.title, ' ', 1)) AS fallback_used
FROM fx_offers o JOIN resolved r USING (category)"""
)
def structured_mode(spark, sf_dir):
    _, index, offers = located(spark, sf_dir)
    rows = offers.where("cat IS NOT NULL").select(
        "offer_id", "cat", F.create_map(F.lit("Note"), F.lit("plain")).alias("plain"), F.create_map(F.lit("Color"), F.upper(_words()[0])).alias("structured")
    )
    out = suggest.structured_mode(rows, "on", 1.0, index, fuzzy=False)
    pairs = F.transform(F.map_entries("final"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("offer_id", F.array_join(pairs, ";").alias("final"), "fallback_used")


@query(
    with_views("fx_offers", "fx_attributes") + """SELECT o.offer_id, 3 AS fields_requested, CAST(count(a.char_name) AS INT) AS fields_accepted,
  CAST(4 - count(a.char_name) AS INT) AS fields_rejected FROM fx_offers o LEFT JOIN fx_attributes a USING (offer_id) GROUP BY 1"""
)
def telemetry_rows(spark, sf_dir):
    fx = load(spark, sf_dir)
    many = lambda n: fx["fx_offers"].select("offer_id", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return suggest.telemetry_rows(many(3), fx["fx_attributes"], many(4), "shop", "model").select(
        "offer_id", "fields_requested", "fields_accepted", "fields_rejected"
    )


# ---------------------------------------------------------------- knowledge and caches

KNOWN = """, k AS (SELECT CASE WHEN ean IS NULL THEN NULL ELSE ean END AS ean, brand, lower(replace(replace(title, ' - ', ' '), '-', ' ')) AS title,
  offer_id, category, ts, ordinal FROM fx_offers)
"""


def _knowledge(spark, sf_dir):
    fx = load(spark, sf_dir)
    return fx, fx["fx_offers"].select(
        "ean", "brand", norm_title("title").alias("normalized_title"), F.lit("shop").alias("marketplace_id"), "offer_id", "category",
        F.create_map(F.lit("Color"), F.col("title")).alias("final_attributes"), F.lit(0.5).alias("confidence"), F.lit("r").alias("run_id"),
        F.col("ts").alias("updated_at"),
    )


@query(
    with_views("fx_offers") + KNOWN + """SELECT ean, NULL AS normalized_title, arg_max(offer_id, ts) AS offer_id FROM k WHERE ean IS NOT NULL GROUP BY ean
UNION ALL SELECT NULL, concat(brand, '|', title), arg_max(offer_id, ts) FROM k WHERE ean IS NULL GROUP BY brand, title"""
)
def knowledge_upsert(spark, sf_dir):
    fx, rows = _knowledge(spark, sf_dir)
    out = knowledge.knowledge_upsert(rows.where("updated_at < timestamp '2024-01-10'"), rows.where("updated_at >= timestamp '2024-01-10'"))
    return out.select("ean", F.when(F.col("ean").isNull(), F.concat("brand", F.lit("|"), "normalized_title")).alias("normalized_title"), "offer_id")


@query(
    with_views("fx_offers") + KNOWN + """, e AS (SELECT ean, arg_max(category, ts) AS category FROM k WHERE ean IS NOT NULL GROUP BY ean),
t AS (SELECT brand, title, arg_max(category, ts) AS category FROM k WHERE ean IS NULL GROUP BY 1, 2)
SELECT k.offer_id, e.category FROM k JOIN e ON e.ean = k.ean UNION ALL SELECT k.offer_id, t.category FROM k JOIN t ON k.ean IS NULL AND t.brand = k.brand AND t.title = k.title"""
)
def knowledge_lookup(spark, sf_dir):
    fx, rows = _knowledge(spark, sf_dir)
    asked = rows.select("offer_id", "ean", "brand", "normalized_title", "marketplace_id")
    return knowledge.knowledge_lookup(asked, rows).select("offer_id", "category")


@query("SELECT count(*) AS n FROM events")
def knowledge_size(spark, sf_dir):
    from offermend.operators.report import knowledge_size as size

    return size(_knowledge(spark, sf_dir)[1].select("offer_id", F.lit(1)).withColumnRenamed("offer_id", "ean"))


CACHED = ", c AS (SELECT lower(trim(title)) AS t, min(category) AS category FROM fx_offers WHERE ordinal % 2 = 0 AND category <> '' GROUP BY 1)\n"


def _cache(fx):
    accepted = fx["fx_offers"].where("ordinal % 2 = 0 AND category <> ''").select("title", "category")
    return knowledge.category_cache_rows(accepted, "shop")


@query(with_views("fx_offers") + CACHED + "SELECT o.offer_id, c.category FROM fx_offers o JOIN c ON c.t = lower(trim(o.title))")
def cached_categories(spark, sf_dir):
    fx = load(spark, sf_dir)
    return knowledge.cached_categories(fx["fx_offers"], _cache(fx), "shop")


@query(with_views("fx_offers") + CACHED + "SELECT o.offer_id FROM fx_offers o WHERE lower(trim(o.title)) NOT IN (SELECT t FROM c)")
def uncached_offers(spark, sf_dir):
    fx = load(spark, sf_dir)
    return knowledge.uncached(fx["fx_offers"], _cache(fx), "shop").select("offer_id")


@query(
    ALL + """SELECT o.offer_id, 'Color:' AS char_name, split_part(o.title, ' ', 1) AS value FROM fx_offers o JOIN resolved r USING (category)
WHERE EXISTS (SELECT 1 FROM vals v WHERE v.cat = r.cat AND v.char_name = 'Color:' AND v.value = split_part(o.title, ' ', 1))
UNION ALL SELECT o.offer_id, 'Note', 'n' FROM fx_offers o JOIN resolved r USING (category)"""
)
def cached_attributes(spark, sf_dir):
    from offermend.functions.text import char_request_key

    _, index, offers = located(spark, sf_dir)
    requests = offers.where("cat IS NOT NULL").select("offer_id", "title", "category", "cat", F.array(F.lit("Note"), F.lit("Color:")).alias("missing"))
    key = char_request_key("title", "category", F.lit("shop"), F.col("missing"))
    cache = requests.select(key.alias("key"), _words()[0].alias("w")).distinct().select(
        "key", F.explode(F.create_map(F.lit("Color:"), F.col("w"), F.lit("Note"), F.lit("n"), F.lit("Other"), F.lit("o"))).alias("char_name", "value")
    )
    return knowledge.cached_attributes(requests, cache, index.values, "shop")


@query(
    with_views("fx_offers") + """, o AS MATERIALIZED (SELECT offer_id, title, category, ordinal FROM fx_offers),
g AS (SELECT title, category, bool_or(ordinal % 2 = 0) AND bool_or(ordinal % 3 = 0) AS settled FROM o GROUP BY 1, 2)
SELECT offer_id FROM o JOIN g ON g.title = o.title AND g.category = o.category WHERE NOT settled"""
)
def done_offers_skipped(spark, sf_dir):
    """Offers still to ask about: two mandatory names resolved by every second and third offer."""
    fx = load(spark, sf_dir)
    rows = fx["fx_offers"].select("offer_id", "title", "category", F.array(F.lit("Color:"), F.lit("Size")).alias("mandatory"), "ordinal")
    none = spark.createDataFrame([], "key string, char_name string")
    done = knowledge.update_done(none, rows.where("ordinal % 2 = 0").withColumn("char_name", F.lit("Color:")), "shop")
    done = knowledge.update_done(done, rows.where("ordinal % 3 = 0").withColumn("char_name", F.lit("Size")), "shop")
    return knowledge.not_done(rows, done, "shop").select("offer_id")


@query(
    "WITH w AS (SELECT array_to_string(list_filter(string_split(p_name, ' '), lambda w: length(w) > 3), ', ') AS keywords, p_type, p_partkey FROM part) "
    "SELECT keywords, '' AS exclude, arg_min(p_type, p_partkey) AS category FROM w WHERE keywords <> '' GROUP BY 1"
)
def learned_rules(spark, sf_dir):
    """Rules learned from part names, merged in two generations."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("title"), F.col("p_type").alias("category"), F.col("p_partkey").alias("ordinal"))
    half = parts.agg(F.max("ordinal").alias("top"))
    split = parts.join(half).withColumn("early", F.col("ordinal") * 2 < F.col("top"))
    first = knowledge.learned_rules(split.where("early"))
    return knowledge.merge_learned_rules(first, knowledge.learned_rules(split.where("NOT early")))
