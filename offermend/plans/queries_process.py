"""Queries over the offer repair itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from offermend import fixed_values as V
from offermend.functions.html import strip_html
from offermend.operators import context, detect, knowledge, matching
from offermend.plans.check_sql import (
    DETECTED, FED, REFERENCE, RESOLVED, RULE_VALUES, TEXTS, VIEWS, VISIBLE, concept_rows, lit, rule_rows, with_views,
)
from offermend.plans.process_offers import offer_summary, process_offers, resolve_offers
from offermend.plans.registry import query
from offermend.plans.runs import attribute_rows, fixture_offers, located, run_options, saved_image_run, saved_run

CODES = ("1007", "1009", "1010")
CODE = "nullif(regexp_extract(trim(error), '^([0-9]+)', 1), '')"
MARKET = "eMAG Romania"

# ---------------------------------------------------------------- eligibility and category


@query(with_views("fx_offers") + f"SELECT offer_id, {CODE} AS error_code FROM fx_offers WHERE {CODE} IN {CODES}")
def eligible_offers(spark, sf_dir):
    fx, _, _ = located(spark, sf_dir)
    offers = fx["fx_offers"].withColumn("marketplace", F.lit(MARKET))
    return context.eligible_offers(offers, context.error_code_table(spark)).select("offer_id", "error_code")


@query(with_views("fx_offers") + "SELECT offer_id, title FROM fx_offers WHERE lower(trim(category)) = 'economy'")
def filter_category(spark, sf_dir):
    fx, _, _ = located(spark, sf_dir)
    return context.filter_category(fx["fx_offers"], " Economy ").select("offer_id", "title")


@query(
    with_views(*VIEWS, cats=REFERENCE["cats"], resolved=RESOLVED)
    + "SELECT DISTINCT o.category, r.cat, CASE WHEN r.cat IS NULL THEN NULL WHEN c.cat IS NOT NULL THEN 'exact' ELSE 'normalised' END AS tier "
    "FROM fx_offers o LEFT JOIN resolved r ON r.category = o.category LEFT JOIN cats c ON c.category_name = o.category"
)
def resolve_category(spark, sf_dir):
    fx, index, _ = located(spark, sf_dir)
    return matching.resolve_categories(fx["fx_offers"], index)


@query()
def resolve_category_closest(spark, sf_dir):
    """Every category name with one letter doubled, resolved by closeness."""
    fx, index, _ = located(spark, sf_dir)
    typos = fx["fx_offers"].where("category <> ''").select(
        F.concat(F.substring("category", 1, 3), F.substring("category", 3, 99)).alias("category")
    )
    return matching.resolve_categories(typos, index)


# ---------------------------------------------------------------- rules

RULE_CTES = dict(
    **REFERENCE, resolved=RESOLVED, concept_names=concept_rows(), fed=FED, word_rules=rule_rows(), shown=VISIBLE,
    rule_values=RULE_VALUES, live="SELECT o.*, r.cat FROM shown o JOIN resolved r USING (category)", texts=TEXTS, detected=DETECTED,
)


@query(
    with_views(*VIEWS, **{k: RULE_CTES[k] for k in ("cats", "attrs", "concept_names", "fed")}) + "SELECT cat, concept, attribute FROM fed"
)
def applicable_detectors(spark, sf_dir):
    _, index, _ = located(spark, sf_dir)
    return detect.applicable_concepts(index, detect.concept_names_table(spark))


def _detector(concept: str):
    sql = with_views(*VIEWS, **{**RULE_CTES, "word_rules": rule_rows(concept)}) + (
        f"SELECT offer_id, char_name, value FROM detected WHERE concept = {lit(concept)}"
    )

    @query(sql, name=f"detect_{concept}")
    def run(spark, sf_dir):
        _, index, offers = located(spark, sf_dir)
        rows = offers.where("cat IS NOT NULL").withColumn("visible", strip_html("description"))
        names = detect.concept_names_table(spark, {concept: V.CONCEPT_NAMES[concept]})
        rules = [r for r in detect.builtin_rules() if r.concept == concept]
        if not rules:
            found = detect.size_and_age(rows, detect.applicable_concepts(index, names))
            found = found.join(matching.match_values(found, index), matching.KEY).withColumn("value", detect.size_and_age_value())
            return found.where("value IS NOT NULL").groupBy("offer_id", F.col("char_input").alias("char_name")).agg(
                F.min_by("value", "step").alias("value")
            )
        resolved = detect.resolve_rules(index, detect.applicable_concepts(index, names), rules)
        return detect.detect_by_words(rows, resolved, rules).select("offer_id", F.explode("detected").alias("d")).select(
            "offer_id", F.col("d.attribute").alias("char_name"), "d.value"
        )


for _concept in V.CONCEPT_NAMES:
    _detector(_concept)


@query(
    with_views(*VIEWS, **RULE_CTES)
    + "SELECT d.offer_id, d.concept, d.char_name, d.value FROM detected d "
    "WHERE NOT EXISTS (SELECT 1 FROM fx_attributes a WHERE a.offer_id = d.offer_id AND a.char_name = d.char_name)"
)
def detect_attributes(spark, sf_dir):
    """All rules at once; attributes that already hold a value are left alone."""
    _, index, offers = located(spark, sf_dir)
    rows = offers.where("cat IS NOT NULL").withColumn("visible", strip_html("description"))
    rows = rows.withColumn("filled", F.map_keys("existing_chars"))
    return detect.detect(rows, index, detect.concept_names_table(spark)).select("offer_id", "concept", "char_name", "value")


RULES = [
    (1, "red", "", "ECONOMY"), (2, "red, widget", "", "LARGE"), (3, "blue", "gear, ring", "SMALL"), (4, "old, gizmo", "", "PROMO"),
    (5, "anvil", "new", "MEDIUM"), (6, "small plate", "", "STANDARD"),
]
_padded = "concat(' ', array_to_string(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'), ' '), ' ')"
_RULE_HITS = "SELECT r.*, len(string_split(r.keywords, ',')) AS n FROM (VALUES " + ", ".join(
    f"({i}, {lit(k)}, {lit(e)}, {lit(c)})" for i, k, e, c in RULES
) + ") AS r(rule_id, keywords, exclude, category)"


@query(
    with_views("fx_offers", rules=_RULE_HITS, titles=f"SELECT DISTINCT title, {_padded.format('title')} AS p FROM fx_offers")
    + """SELECT title, arg_min(category, -n * 1000 + rule_id) AS category, arg_min(rule_id, -n * 1000 + rule_id) AS rule_id
FROM titles t JOIN rules r
  ON len(list_filter(string_split(r.keywords, ','), lambda k: NOT contains(t.p, concat(' ', trim(k), ' ')))) = 0
 AND len(list_filter(string_split(r.exclude, ','), lambda k: trim(k) <> '' AND contains(t.p, concat(' ', trim(k), ' ')))) = 0
GROUP BY title"""
)
def keyword_rules(spark, sf_dir):
    fx, _, _ = located(spark, sf_dir)
    rules = spark.createDataFrame(RULES, "ordinal bigint, keywords string, exclude string, category string")
    return detect.keyword_rules(fx["fx_offers"], rules).select("title", "category", "rule_id")


# ---------------------------------------------------------------- the run

RUN_CTES = dict(
    **REFERENCE,
    resolved=RESOLVED,
    concept_names=concept_rows(),
    fed=FED,
    word_rules=rule_rows(),
    rule_values=RULE_VALUES,
    shown=VISIBLE,
    coded=f"SELECT s.*, {CODE} AS error_code, r.cat AS own_cat FROM shown s LEFT JOIN resolved r USING (category)",
    live=f"SELECT *, own_cat AS cat FROM coded WHERE error_code IN {CODES} AND own_cat IS NOT NULL",
    checked="""SELECT a.offer_id, a.char_name, a.value,
  CASE WHEN t.char_name IS NULL THEN 'foreign'
       WHEN EXISTS (SELECT 1 FROM vals v WHERE v.cat = l.cat AND v.char_name = t.char_name)
        AND NOT EXISTS (SELECT 1 FROM vals v WHERE v.cat = l.cat AND v.char_name = t.char_name AND lower(v.value) = lower(a.value))
       THEN 'invalid' ELSE 'keep' END AS verdict
  FROM fx_attributes a JOIN live l ON l.offer_id = a.offer_id
  LEFT JOIN attrs t ON t.cat = l.cat AND t.char_key = lower(a.char_name)""",
    texts=TEXTS,
    detected=DETECTED,
    fresh="""SELECT d.* FROM detected d WHERE NOT EXISTS (
    SELECT 1 FROM checked c WHERE c.offer_id = d.offer_id AND c.char_name = d.char_name AND c.verdict = 'keep')""",
    missing="""SELECT l.offer_id, t.char_name, t.ordinal,
    NOT EXISTS (SELECT 1 FROM vals v WHERE v.cat = l.cat AND v.char_name = t.char_name) AS no_values
  FROM live l JOIN attrs t ON t.cat = l.cat AND t.mandatory
  WHERE NOT EXISTS (SELECT 1 FROM checked c WHERE c.offer_id = l.offer_id AND c.char_name = t.char_name AND c.verdict = 'keep')
    AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.offer_id = l.offer_id AND f.char_name = t.char_name)""",
    n_new="SELECT offer_id, count(*) AS n, string_agg(concat(char_name, '=', value), '; ' ORDER BY char_name) AS t FROM fresh GROUP BY 1",
    n_cleared="SELECT offer_id, count(*) AS n, string_agg(char_name, '; ' ORDER BY char_name) AS t FROM checked WHERE verdict <> 'keep' GROUP BY 1",
    n_missing="SELECT offer_id, count(*) AS n, string_agg(char_name, '; ' ORDER BY ordinal) AS t FROM missing GROUP BY 1",
    results=f"""SELECT c.offer_id, c.title, coalesce(c.category, '') AS original_cat, c.error_code,
    CASE WHEN l.offer_id IS NOT NULL AND (n.n > 0 OR x.n > 0) THEN 'updated' ELSE 'skip' END AS action,
    CASE WHEN c.own_cat IS NOT NULL THEN c.category ELSE '' END AS new_category,
    coalesce(n.n, 0) AS n_new, coalesce(n.t, '') AS new_chars, coalesce(x.n, 0) AS n_cleared, coalesce(x.t, '') AS cleared,
    coalesce(m.n, 0) AS n_missing, coalesce(m.t, '') AS missing,
    coalesce(c.error_code IN {CODES}, false) AND (c.own_cat IS NULL OR m.n > 0) AS needs_manual,
    coalesce(c.error_code IN {CODES}, false) AS eligible,
    CASE WHEN c.error_code IN {CODES} AND c.own_cat IS NULL THEN {lit(V.CATEGORY_OFF_REASON)} END AS category_reason
  FROM coded c LEFT JOIN live l USING (offer_id) LEFT JOIN n_new n USING (offer_id) LEFT JOIN n_cleared x USING (offer_id)
  LEFT JOIN n_missing m USING (offer_id)""",
)
RUN = with_views(*VIEWS, **RUN_CTES)


@query(
    RUN + "SELECT offer_id, title, original_cat, error_code, action, new_category, new_chars, cleared, missing, "
    "coalesce(needs_manual, false) AS needs_manual, category_reason FROM results"
)
def process_offers_results(spark, sf_dir):
    rows = saved_run(spark, sf_dir)
    pairs = F.array_sort(F.transform(F.map_entries("new_chars"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return rows.select(
        "offer_id", "title", "original_cat", "error_code", "action", "new_category", F.array_join(pairs, "; ").alias("new_chars"),
        F.array_join(F.array_sort("cleared"), "; ").alias("cleared"), F.array_join("missing_mandatory", "; ").alias("missing"),
        "needs_manual", "category_reason",
    )


@query(
    RUN
    + """SELECT count(*) FILTER (WHERE n_new > 0 OR n_cleared > 0) AS updated, CAST(sum(n_new) AS BIGINT) AS attributes_added,
  CAST(sum(n_cleared) AS BIGINT) AS values_cleared, count(*) FILTER (WHERE needs_manual) AS needs_manual,
  count(*) FILTER (WHERE action IN ('cat_assigned', 'cat_corrected')) AS categories_fixed,
  count(*) FILTER (WHERE action = 'cat_assigned') AS assigned, count(*) FILTER (WHERE action = 'cat_corrected') AS corrected FROM results"""
)
def run_kpis(spark, sf_dir):
    from offermend.operators.report import run_kpis as kpis

    return kpis(saved_run(spark, sf_dir))


IMAGE_RUN = with_views(
    *VIEWS, **RUN_CTES,
    seen="""SELECT l.offer_id, t.char_name, min(v.value) AS value FROM live l JOIN attrs t ON t.cat = l.cat
  JOIN vals v ON v.cat = l.cat AND v.char_name = t.char_name GROUP BY 1, 2""",
)


@query(
    IMAGE_RUN + """SELECT offer_id, char_name, value FROM fresh UNION ALL
SELECT offer_id, char_name, value FROM seen s WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.offer_id = s.offer_id AND f.char_name = s.char_name)
  AND NOT EXISTS (SELECT 1 FROM checked c WHERE c.offer_id = s.offer_id AND c.char_name = s.char_name AND c.verdict = 'keep')"""
)
def image_filled_attributes(spark, sf_dir):
    """Attributes a run with images adds: those of rules, and image values where neither rule nor offer has one."""
    return saved_image_run(spark, sf_dir).select("offer_id", F.explode("new_chars").alias("char_name", "value"))


@query(
    IMAGE_RUN + """SELECT offer_id, 'image' AS source, char_name, 'zzqq' AS value_input, 'value_not_in_values_table' AS reason FROM seen
UNION ALL SELECT offer_id, 'image', 'Nope', 'red', 'char_not_in_characteristics' FROM live"""
)
def image_rejections(spark, sf_dir):
    """Image values that the gate turned down, with value and reason."""
    return saved_image_run(spark, sf_dir).select("offer_id", F.explode("rejected").alias("r")).select("offer_id", "r.*")


@query(
    IMAGE_RUN + """SELECT r.offer_id, CASE WHEN l.offer_id IS NOT NULL AND o.ordinal % 3 = 0 THEN 'LARGE' ELSE r.new_category END AS new_category,
  CASE WHEN l.offer_id IS NOT NULL AND o.ordinal % 3 = 0 THEN 'prefer_image: strong_image' END AS fusion_reason,
  CASE WHEN l.offer_id IS NOT NULL THEN CASE o.ordinal % 3 WHEN 0 THEN 'LARGE' WHEN 1 THEN 'qqqq' END END AS hint,
  CASE WHEN l.offer_id IS NOT NULL THEN 1 + coalesce(s.n, 0) END AS n_proposed
FROM results r JOIN fx_offers o USING (offer_id) LEFT JOIN live l USING (offer_id)
LEFT JOIN (SELECT offer_id, count(*) AS n FROM seen GROUP BY 1) s USING (offer_id)"""
)
def image_fusion(spark, sf_dir):
    """Category of text and image hint together, with the reason, and what the images proposed."""
    return saved_image_run(spark, sf_dir).select(
        "offer_id", "new_category", "fusion_reason", "image_analysis.hint",
        F.when(F.col("image_analysis").isNotNull(), F.size("image_analysis.proposed")).cast("long").alias("n_proposed"),
    )


@query()
def process_offers_full(spark, sf_dir):
    """Rules for categories, model replies for categories and attributes, image values, all at once."""
    from offermend.plans.queries_suggest import suggestion_rows

    fx, index, _ = located(spark, sf_dir)
    offers = fixture_offers(fx)
    options = run_options(
        category_rules=spark.createDataFrame(RULES, "ordinal bigint, keywords string, exclude string, category string"),
        category_suggestions=fx["fx_offers"].select("offer_id", F.initcap(F.regexp_extract("title", "([a-z]+)", 1)).alias("suggested")),
        suggestions=suggestion_rows(fx),
        image_values=fx["fx_offers"].select("offer_id", F.lit("Culoare de baza").alias("char_input"), F.lit("rosu").alias("value_input")),
        use_model=True,
    )
    rows = process_offers(offers, index, options)
    return rows.select(
        "offer_id", "action", "new_category", F.size("new_chars").alias("n_new"), F.size("cleared").alias("n_cleared"),
        F.size("missing_mandatory").alias("n_missing"), "needs_manual", F.size("review").alias("n_review"), "category_reason",
    )


@query(RUN + "SELECT offer_id, char_name FROM checked WHERE verdict = 'invalid'")
def clear_invalid(spark, sf_dir):
    fx, index, offers = located(spark, sf_dir)
    live = offers.where(F.regexp_extract("error", "^([0-9]+)", 1).isin(*CODES))
    return matching.clear_invalid(attribute_rows(live), index).select("offer_id", F.col("char_input").alias("char_name"))


@query(RUN + "SELECT offer_id, char_name FROM checked WHERE verdict = 'foreign'")
def clear_foreign(spark, sf_dir):
    fx, index, offers = located(spark, sf_dir)
    live = offers.where(F.regexp_extract("error", "^([0-9]+)", 1).isin(*CODES))
    return matching.clear_foreign(attribute_rows(live), index).select("offer_id", F.col("char_input").alias("char_name"))


@query(RUN + f"SELECT offer_id, char_name, CASE WHEN no_values THEN {lit(V.NO_VALUES_REASON)} ELSE {lit(V.RULE_MISS_REASON)} END AS reason FROM missing")
def explain_missing(spark, sf_dir):
    return saved_run(spark, sf_dir).select("offer_id", F.explode("chars_reasons").alias("char_name", "reason"))


@query(
    with_views(*VIEWS, **REFERENCE, resolved=RESOLVED)
    + """SELECT o.offer_id, t.char_name FROM fx_offers o JOIN resolved r USING (category) JOIN attrs t ON t.cat = r.cat AND t.mandatory
LEFT JOIN fx_attributes a ON a.offer_id = o.offer_id AND a.char_name = t.char_name
WHERE a.value IS NULL OR (EXISTS (SELECT 1 FROM vals v WHERE v.cat = r.cat AND v.char_name = t.char_name)
  AND NOT EXISTS (SELECT 1 FROM vals v WHERE v.cat = r.cat AND v.char_name = t.char_name AND v.value = a.value))"""
)
def missing_or_invalid_mandatory(spark, sf_dir):
    _, index, offers = located(spark, sf_dir)
    return matching.missing_or_invalid_mandatory(offers, attribute_rows(offers), index)


@query(
    RUN
    + """SELECT r.offer_id, CAST(r.n_new AS INT) AS n_filled, replace(r.new_chars, '; ', ', ') AS filled, CAST(r.n_missing AS INT) AS n_missing,
  coalesce(m.t, '') AS missing FROM results r LEFT JOIN (
    SELECT offer_id, string_agg(concat(char_name, ': ', CASE WHEN no_values THEN """
    + lit(V.NO_VALUES_REASON) + " ELSE " + lit(V.RULE_MISS_REASON)
    + """ END), ', ' ORDER BY ordinal) AS t FROM missing GROUP BY 1) m USING (offer_id)"""
)
def offer_summaries(spark, sf_dir):
    return offer_summary(saved_run(spark, sf_dir))


@query(
    RUN
    + f"""SELECT offer_id, CASE WHEN e.event_id % 4 = 0 AND r.new_category = '' AND eligible
       THEN CASE e.event_id % 3 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'LARGE' ELSE '' END ELSE r.new_category END AS new_category,
  CASE WHEN eligible AND r.new_category = '' AND e.event_id % 4 = 0 AND e.event_id % 3 < 2 THEN 'cat_assigned' ELSE 'skip' END AS action,
  CASE WHEN eligible AND r.new_category = '' AND NOT (e.event_id % 4 = 0 AND e.event_id % 3 < 2)
       THEN CASE WHEN e.event_id % 4 = 0 THEN {lit(V.CATEGORY_UNKNOWN_REASON[0] + 'qqqq' + V.CATEGORY_UNKNOWN_REASON[1])}
                 ELSE {lit(V.CATEGORY_NULL_REASON)} END END AS category_reason
FROM results r JOIN events e ON CAST(e.event_id AS VARCHAR) = r.offer_id"""
)
def inject_category(spark, sf_dir):
    """Model categories used only where the own one is unknown, with the reason where neither is."""
    fx, index, _ = located(spark, sf_dir)
    replies = fx["fx_offers"].where("ordinal % 4 = 0").select(
        "offer_id", F.expr("CASE ordinal % 3 WHEN 0 THEN 'economy' WHEN 1 THEN 'LARGE' ELSE 'qqqq' END").alias("suggested")
    )
    rows = resolve_offers(fixture_offers(fx), index, run_options(category_suggestions=replies, use_model=True))
    return rows.select("offer_id", "new_category", F.col("category_action").alias("action"), "category_reason")


@query(
    with_views("fx_offers") + "SELECT offer_id, CASE WHEN ordinal % 3 = 0 THEN 'earlier' ELSE 'fresh' END AS origin FROM fx_offers"
)
def resume_run(spark, sf_dir):
    """Earlier results kept, the rest processed anew."""
    fx, _, _ = located(spark, sf_dir)
    done = fx["fx_offers"].where("ordinal % 3 = 0").select("offer_id", F.lit("earlier").alias("origin"))
    fresh = knowledge.pending(fx["fx_offers"], done).select("offer_id", F.lit("fresh").alias("origin"))
    return knowledge.resume(done, fresh)
