"""Queries over run results, logs and telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from offermend import fixed_values as V
from offermend.operators import matching, report
from offermend.operators.export import change_tags as tags
from offermend.operators.export import export_model_rows as model_rows
from offermend.operators.export import export_original_rows as original_rows
from offermend.operators.export import export_overflow as overflow_rows
from offermend.operators.export import long_attributes
from offermend.plans.check_sql import REFERENCE, RESOLVED, VIEWS, lit, with_views
from offermend.plans.fixtures import load
from offermend.plans.queries_process import CODE, CODES, RUN
from offermend.plans.registry import query
from offermend.plans.runs import attribute_rows, fixture_offers, located, saved_run

IN = str(CODES)


@query(with_views("fx_offers") + f"SELECT {CODE} AS code, count(*) AS n, {CODE} IN {IN} AS processable FROM fx_offers WHERE {CODE} IS NOT NULL GROUP BY 1")
def error_code_counts(spark, sf_dir):
    return report.error_code_counts(load(spark, sf_dir)["fx_offers"], list(CODES))


AUDIT = with_views(*VIEWS, cats=REFERENCE["cats"], resolved=RESOLVED)


@query(
    AUDIT + f"""SELECT r.cat IS NOT NULL AS valid, CASE WHEN r.cat IS NOT NULL THEN NULL WHEN o.category = '' THEN {lit(V.NO_CATEGORY_LABEL)}
ELSE o.category END AS label, count(*) AS n FROM fx_offers o LEFT JOIN resolved r USING (category) GROUP BY 1, 2"""
)
def audit_categories(spark, sf_dir):
    fx, index, _ = located(spark, sf_dir)
    return report.audit_categories(fx["fx_offers"], matching.resolve_categories(fx["fx_offers"], index))


@query(
    AUDIT + f"""SELECT count(*) AS offers, count(*) FILTER (WHERE o.category <> '') AS with_category, count(r.cat) AS valid_category,
count(*) FILTER (WHERE {CODE} IN {IN}) AS eligible FROM fx_offers o LEFT JOIN resolved r USING (category)"""
)
def eligible_counts(spark, sf_dir):
    fx, index, _ = located(spark, sf_dir)
    return report.eligible_counts(fx["fx_offers"], matching.resolve_categories(fx["fx_offers"], index), list(CODES))


@query(
    with_views(*VIEWS, **REFERENCE, resolved=RESOLVED)
    + f""", m AS (SELECT o.offer_id, count(*) AS n FROM fx_offers o JOIN resolved r USING (category) JOIN attrs t ON t.cat = r.cat AND t.mandatory
  WHERE NOT EXISTS (SELECT 1 FROM fx_attributes a WHERE a.offer_id = o.offer_id AND a.char_name = t.char_name) GROUP BY 1),
x AS (SELECT (SELECT count(*) FROM fx_offers o WHERE NOT EXISTS (SELECT 1 FROM resolved r WHERE r.category = o.category)) AS c,
  (SELECT count(*) FROM m) AS h, (SELECT sum(least(n * 25, 300)) FROM m) AS ho, (SELECT count(*) FROM fx_categories) AS k),
y AS (SELECT c AS n_cat_ai, CAST(ceil(c / 60.0) AS BIGINT) AS n_batches, h + c // 2 AS n_char_ai,
  CAST(ceil(c / 60.0) AS BIGINT) * (300 + k * 5) + c * 30 AS cat_input, c * 15 AS cat_output, (h + c // 2) * 350 AS char_input,
  CAST(ho + (c // 2) * 50 AS BIGINT) AS char_output FROM x)
SELECT *, cat_input + char_input AS total_input, cat_output + char_output AS total_output,
  round((cat_input + char_input) * {V.PRICE_IN} + (cat_output + char_output) * {V.PRICE_OUT}, 6) AS cost_usd FROM y"""
)
def cost_estimate(spark, sf_dir):
    from offermend.operators.indexes import mandatory_index

    fx, index, offers = located(spark, sf_dir)
    wanted = offers.where("cat IS NOT NULL").select("offer_id", "cat").join(mandatory_index(index.attributes), "cat")
    held = attribute_rows(offers).select("offer_id", F.col("char_input").alias("char_name"))
    missing = wanted.join(held, ["offer_id", "char_name"], "left_anti").groupBy("offer_id").agg(F.count("*").alias("n_missing"))
    return report.cost_estimate(offers, missing, fx["fx_categories"].agg(F.count("*").alias("n")))


@query(
    RUN + """SELECT count(*) AS total, count(*) FILTER (WHERE eligible) AS processed, count(*) FILTER (WHERE NOT eligible) AS skipped,
  count(*) FILTER (WHERE action IN ('cat_assigned', 'cat_corrected')) AS categories_fixed, CAST(sum(n_new) AS BIGINT) AS attributes_added,
  CAST(sum(n_cleared) AS BIGINT) AS values_cleared, count(*) FILTER (WHERE eligible) - count(*) FILTER (WHERE needs_manual) AS completed,
  count(*) FILTER (WHERE needs_manual) AS manual FROM results"""
)
def run_summary(spark, sf_dir):
    return report.run_summary(saved_run(spark, sf_dir), list(CODES))


@query(
    RUN + """SELECT offer_id, CASE WHEN NOT eligible THEN concat('Fara eroare (cod: ', coalesce(error_code, 'N/A'), ') — omis')
  WHEN needs_manual AND new_category = '' THEN concat('Categorie negasita (eroare ', error_code, ')')
  WHEN needs_manual THEN concat('Caracteristici obligatorii lipsa: ', replace(missing, '; ', ', '))
  WHEN n_new > 0 AND n_cleared > 0 THEN concat(n_new, ' caracteristici completate automat | ', n_cleared, ' valori invalide sterse')
  WHEN n_new > 0 THEN concat(n_new, ' caracteristici completate automat') WHEN n_cleared > 0 THEN concat(n_cleared, ' valori invalide sterse')
  ELSE 'Procesat fara modificari' END AS reason FROM results"""
)
def result_reason(spark, sf_dir):
    return saved_run(spark, sf_dir).select("offer_id", report.reason(list(CODES)).alias("reason"))


@query(RUN + "SELECT category_reason, count(*) AS n FROM results WHERE category_reason IS NOT NULL GROUP BY 1")
def category_reason_counts(spark, sf_dir):
    return report.category_reason_counts(saved_run(spark, sf_dir))


_REASON = f"CASE WHEN no_values THEN {lit(V.NO_VALUES_REASON)} ELSE {lit(V.RULE_MISS_REASON)} END"


@query(RUN + f"SELECT char_name, {_REASON} AS reason, count(*) AS n FROM missing GROUP BY 1, 2")
def char_reason_counts(spark, sf_dir):
    return report.char_reason_counts(saved_run(spark, sf_dir))


@query(RUN + f"SELECT char_name, {_REASON} AS reason, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct FROM missing GROUP BY 1, 2")
def reason_share(spark, sf_dir):
    return report.reason_share(report.char_reason_counts(saved_run(spark, sf_dir)))


@query(RUN + "SELECT char_name, count(*) AS offers FROM missing GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_problem_chars(spark, sf_dir):
    return report.top_problem_chars(report.char_reason_counts(saved_run(spark, sf_dir)))


@query(RUN + "SELECT offer_id, title FROM results WHERE n_cleared > 0 AND contains(lower(title), 'red')")
def results_filter(spark, sf_dir):
    return report.results_filter(saved_run(spark, sf_dir), "cleared", "Red").select("offer_id", "title")


@query(RUN + "SELECT offer_id, title FROM results WHERE needs_manual AND n_missing > 0 AND contains(lower(title), 'gear')")
def unmapped_filter(spark, sf_dir):
    return report.unmapped_filter(saved_run(spark, sf_dir), "attributes", "gear").select("offer_id", "title")


@query(RUN + "SELECT offer_id, title FROM results WHERE needs_manual ORDER BY CAST(offer_id AS BIGINT) LIMIT 50")
def first_manual_results(spark, sf_dir):
    rows = saved_run(spark, sf_dir).where("needs_manual").select("offer_id", "title")
    return report.head(rows, 50, F.col("offer_id").cast("bigint"))


@query(
    RUN + """SELECT count(*) AS total_processed, CAST(sum(n_new) AS BIGINT) AS total_chars_added,
  count(*) FILTER (WHERE n_new > 0 AND NOT needs_manual) AS total_completed, count(*) FILTER (WHERE action LIKE 'cat_%') AS total_cats_fixed,
  count(DISTINCT CAST(offer_id AS BIGINT) % 20) AS runs, max(CAST(offer_id AS BIGINT) % 20) AS last_run FROM results"""
)
def cumulative_stats(spark, sf_dir):
    """Offers spread over twenty runs, totalled."""
    run = F.col("offer_id").cast("bigint") % 20
    return report.cumulative_stats(saved_run(spark, sf_dir).withColumn("run_id", run).withColumn("run_ts", run))


@query(
    RUN + "SELECT offer_id, count(*) AS total, count(*) AS rule, 0 AS ai, 0 AS image, count(*) AS passed, 0 AS failed FROM fresh GROUP BY 1"
)
def source_detail_stats(spark, sf_dir):
    audit = saved_run(spark, sf_dir).select("offer_id", F.explode("new_chars").alias("char_name", "value")).select(
        "offer_id", F.lit("rule").alias("source"), F.lit(True).alias("accept")
    )
    return report.source_detail_stats(audit)


@query()
def resolver_summary(spark, sf_dir):
    """Review events by method over the scored resolution of words that no list holds."""
    from offermend.plans.registry import QUERIES

    rows = QUERIES["resolve_values"](spark, sf_dir).where("needs_review").groupBy("offer_id").agg(
        F.collect_list(F.struct("method", "value")).alias("review")
    )
    return report.resolver_summary(rows)


# ---------------------------------------------------------------- telemetry

LOG = with_views("fx_run_log")
_RATE = "avg(CAST(fields_accepted AS DOUBLE) / nullif(fields_requested, 0)) * 100"


@query(
    LOG + f"""SELECT count(*) AS total_runs, round({_RATE}, 1) AS accept_rate_pct, round(avg(cost_usd), 6) AS avg_cost_usd,
  round(sum(CAST(retry_count > 0 AS INT)) * 100.0 / nullif(count(*), 0), 1) AS retry_rate_pct,
  round(sum(CAST(fallback_used AS INT)) * 100.0 / nullif(count(*), 0), 1) AS fallback_rate_pct FROM fx_run_log"""
)
def telemetry_summary(spark, sf_dir):
    return report.telemetry_summary(load(spark, sf_dir)["fx_run_log"])


@query(
    LOG + """, n AS (SELECT structured_model_used AS m, count(*) AS n FROM fx_run_log WHERE structured_mode <> 'off' AND structured_attempted GROUP BY 1)
SELECT sum(CAST(structured_attempted AS BIGINT))::BIGINT AS attempted, sum(CAST(structured_success AS BIGINT))::BIGINT AS success,
  sum(CAST(structured_fallback_used AS BIGINT))::BIGINT AS fallback,
  round(avg(CASE WHEN structured_attempted THEN structured_latency_ms END), 0) AS avg_latency,
  (SELECT m FROM n ORDER BY n DESC, m LIMIT 1) AS top_model FROM fx_run_log WHERE structured_mode <> 'off'"""
)
def structured_summary(spark, sf_dir):
    return report.structured_summary(load(spark, sf_dir)["fx_run_log"])


@query(
    LOG + f"""SELECT marketplace, count(*) AS runs, round({_RATE}, 1) AS accept_rate, round(sum(cost_usd), 4) AS total_cost_usd
FROM fx_run_log GROUP BY 1 ORDER BY runs DESC, marketplace LIMIT 10"""
)
def telemetry_by_marketplace(spark, sf_dir):
    return report.telemetry_by_marketplace(load(spark, sf_dir)["fx_run_log"])


@query(
    """WITH s AS (SELECT * FROM events WHERE event_id % 3 = 1)
SELECT count(*) AS shadow_runs,
  round(sum(1 + user_id % 2) * 100.0 / sum(1 + user_id % 2 + user_id % 3), 1) AS agreement_rate,
  count(*) FILTER (WHERE user_id % 4 = 0) AS runs_with_conflicts FROM s"""
)
def shadow_agreement(spark, sf_dir):
    """Comparisons whose agreeing and single keys follow from the user id."""
    text = F.to_json(
        F.struct(
            F.slice(F.array(F.lit("a"), F.lit("b")), 1, (1 + F.col("user_id") % 2).cast("int")).alias("agree"),
            F.slice(F.array(F.lit("c"), F.lit("d")), 1, (F.col("user_id") % 3).cast("int")).alias("only_structured"),
            F.array().cast("array<string>").alias("only_plain"),
            F.when(F.col("user_id") % 4 == 0, F.create_map(F.lit("a"), F.struct(F.lit("x").alias("structured"), F.lit("y").alias("plain"))))
            .otherwise(F.create_map().cast("map<string,struct<structured:string,plain:string>>")).alias("value_conflicts"),
        )
    )
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = events.select(
        F.col("event_id").cast("string").alias("run_id"), F.col("ts").alias("created_at"),
        F.when(F.col("event_id") % 3 == 1, "shadow").otherwise("on").alias("structured_mode"), text.alias("shadow_diff"),
    )
    return report.shadow_agreement(log)


_COUNTED = ", ".join(f"CAST(coalesce(sum(CASE WHEN event_id % 12 = {i} THEN user_id % 3 END), 0) AS BIGINT) AS {c}" for i, c in enumerate(V.VISION_COUNTERS))


@query(f"SELECT event_type AS run_id, {_COUNTED} FROM events GROUP BY 1")
def vision_counters(spark, sf_dir):
    names = F.array(*[F.lit(c) for c in V.VISION_COUNTERS])
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_type").alias("run_id"), F.element_at(names, (F.col("event_id") % 12 + 1).cast("int")).alias("counter"), (F.col("user_id") % 3).alias("n")
    )
    return report.vision_counters(events)


@query(
    "WITH n AS (SELECT event_type AS marketplace, arg_max(user_id, ts) AS run_id FROM events GROUP BY 1) "
    "SELECT e.event_id, e.event_type AS marketplace FROM events e JOIN n ON n.marketplace = e.event_type AND n.run_id = e.user_id"
)
def latest_run(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    runs = events.select("event_id", F.col("event_type").alias("marketplace"), F.col("user_id").alias("run_id"), F.col("ts").alias("run_ts"))
    return report.latest_run(runs).select("event_id", "marketplace")


# ---------------------------------------------------------------- logs

_LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARNING' WHEN 'click' THEN 'INFO' ELSE 'DEBUG' END"
_STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


def _lines(spark, sf_dir):
    level = F.expr(_LEVEL)
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events, stamp, level, events.select(F.concat(stamp, F.lit(" pid "), "user_id", F.lit(" ["), level, F.lit("] "), "props").alias("value"))


@query(f"SELECT {_STAMP} AS ts, {_LEVEL} AS level, props AS message FROM events")
def log_line_parse(spark, sf_dir):
    return report.app_entries(_lines(spark, sf_dir)[3]).select("ts", "level", "message")


UNIFIED = f"""WITH u AS (SELECT {_STAMP} AS ts, {_LEVEL} AS level, 'app' AS source, props AS message FROM events
UNION ALL SELECT {_STAMP}, 'INFO', 'process', concat('Run: ', event_type, ' | ', props, ' | ', user_id, ' produse') FROM events
UNION ALL SELECT {_STAMP}, 'INFO', 'ai', concat('[char] ', event_type, ' | offer=', event_id) FROM events
UNION ALL SELECT {_STAMP}, {_LEVEL}, 'vision', concat('[fetch:', event_type, '] offer=', event_id, ' status=ok') FROM events)
"""


def _unified(spark, sf_dir):
    events, stamp, level, lines = _lines(spark, sf_dir)
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    runs = events.select(iso.alias("timestamp"), F.col("event_type").alias("marketplace"), F.col("props").alias("file"), F.col("user_id").alias("processed"))
    model = events.select(iso.alias("timestamp"), F.lit("char").alias("type"), F.col("event_type").alias("marketplace"), F.col("event_id").alias("offer_id"))
    vision = events.select(
        iso.alias("ts"), level.alias("level"), F.lit("fetch").alias("stage"), F.col("event_type").alias("event"), F.col("event_id").alias("offer_id"),
        F.lit("ok").alias("status"),
    )
    return report.unified_log(lines, runs, model, vision)


@query(UNIFIED + "SELECT * FROM u")
def unified_log(spark, sf_dir):
    return _unified(spark, sf_dir)


@query(UNIFIED + "SELECT * FROM u WHERE level IN ('WARNING', 'ERROR') AND source = 'vision'")
def log_filter(spark, sf_dir):
    return report.log_filter(_unified(spark, sf_dir), "WARNING", "vision")


@query(
    "SELECT doc_id, md5(CASE WHEN length(text) > 800 THEN concat(substr(text, 1, 800), '…[+', length(text) - 800, ']') ELSE text END) AS cut FROM documents"
)
def truncate_strings(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(report.truncate_strings(F.col("text"))).alias("cut"))



# ---------------------------------------------------------------- exports

MERGED = """, merged AS (
  SELECT a.offer_id, a.char_name, a.value, false AS is_new, false AS is_missing FROM fx_attributes a
  LEFT JOIN checked c ON c.offer_id = a.offer_id AND c.char_name = a.char_name
  WHERE coalesce(c.verdict, 'keep') = 'keep' AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.offer_id = a.offer_id AND f.char_name = a.char_name)
  UNION ALL SELECT offer_id, char_name, value, true, false FROM fresh
  UNION ALL SELECT offer_id, char_name, '', false, true FROM missing)
"""


@query(RUN + MERGED + "SELECT offer_id, char_name, value, is_new, is_missing FROM merged")
def export_attributes(spark, sf_dir):
    """Existing minus cleared, plus new, plus missing as blank, in long form."""
    fx, _, _ = located(spark, sf_dir)
    rows = long_attributes(fixture_offers(fx), saved_run(spark, sf_dir))
    return rows.select("offer_id", "char_name", "value", "is_new", "is_missing")


@query()
def export_model_rows(spark, sf_dir):
    fx, _, _ = located(spark, sf_dir)
    return model_rows(fixture_offers(fx), saved_run(spark, sf_dir))


@query()
def export_original_rows(spark, sf_dir):
    return original_rows(_slotted(spark, sf_dir, 6), saved_run(spark, sf_dir), 6)


def _slotted(spark, sf_dir, n):
    """Offers with at least n slots; no existing attribute is cut."""
    fx, _, _ = located(spark, sf_dir)
    slots = F.transform(F.map_entries("existing_chars"), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    none = F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("value"))
    return fixture_offers(fx).withColumn("slots", F.concat(slots, F.array_repeat(none, F.greatest(F.lit(0), n - F.size(slots)))))


@query()
def export_overflow(spark, sf_dir):
    """Additions that do not fit when every offer has one slot more than attributes."""
    offers = _slotted(spark, sf_dir, 0)
    none = offers.schema["slots"].dataType.elementType
    return overflow_rows(offers.withColumn("slots", F.concat("slots", F.array(F.lit(None).cast(none)))), saved_run(spark, sf_dir))


@query(
    RUN + MERGED + """SELECT tag, count(*) AS n FROM (
  SELECT CASE WHEN is_new THEN 'new' WHEN is_missing THEN 'missing' END AS tag FROM merged
  UNION ALL SELECT 'cleared' FROM checked WHERE verdict <> 'keep'
  UNION ALL SELECT 'manual' FROM results WHERE needs_manual) t WHERE tag IS NOT NULL GROUP BY 1"""
)
def change_tags(spark, sf_dir):
    fx, _, _ = located(spark, sf_dir)
    return tags(fixture_offers(fx), saved_run(spark, sf_dir)).groupBy("tag").agg(F.count("*").alias("n"))
