"""Counts and summaries of runs, logs and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offermend import fixed_values as V
from offermend.functions.text import error_code, log_line_parse, strip

FIXED = ("cat_assigned", "cat_corrected")


def _count(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("bigint")), F.lit(0).cast("bigint"))


# ---------------------------------------------------------------- before a run


def error_code_counts(offers: DataFrame, codes: list[str]) -> DataFrame:
    """code -> offers, and whether the code is processed. Offers without a code are not counted."""
    return (
        offers.select(error_code("error").alias("code")).where("code IS NOT NULL").groupBy("code").agg(F.count("*").alias("n"))
        .withColumn("processable", F.col("code").isin(*codes))
    )


def audit_categories(offers: DataFrame, resolved: DataFrame) -> DataFrame:
    """label -> offers: known categories together under ``valid``, unknown ones by their text."""
    text = strip(F.coalesce("category", F.lit("")))
    rows = offers.withColumn("category", text).join(resolved.select("category", "cat"), "category", "left")
    label = F.when(F.col("cat").isNotNull(), F.lit(None)).when(F.col("category") == "", F.lit(V.NO_CATEGORY_LABEL)).otherwise(F.col("category"))
    return rows.groupBy(F.col("cat").isNotNull().alias("valid"), label.alias("label")).agg(F.count("*").alias("n"))


def eligible_counts(offers: DataFrame, resolved: DataFrame, codes: list[str]) -> DataFrame:
    """Offers in all, with a category, with a known category, with an eligible code."""
    text = strip(F.coalesce("category", F.lit("")))
    rows = offers.withColumn("category", text).join(resolved.select("category", "cat"), "category", "left")
    return rows.agg(
        F.count("*").alias("offers"), _count(F.col("category") != "").alias("with_category"), _count(F.col("cat").isNotNull()).alias("valid_category"),
        _count(F.coalesce(error_code("error"), F.lit("empty")).isin(*codes)).alias("eligible"),
    )


def cost_estimate(offers: DataFrame, missing: DataFrame, n_categories: DataFrame) -> DataFrame:
    """Requests, tokens and price of a run before it starts.

    ``offers``: offer_id, cat (null when unresolved); ``missing``: offer_id, n_missing of resolved
    offers; ``n_categories``: one row n.
    """
    counts = offers.agg(_count(F.col("cat").isNull()).alias("n_cat"))
    wanted = missing.where("n_missing > 0").agg(
        F.count("*").alias("n_char"), _sum(F.least(F.col("n_missing") * 25, F.lit(300))).alias("char_out")
    )
    rows = counts.join(wanted).join(n_categories.select(F.col("n").alias("n_categories")))
    guessed = F.floor(F.col("n_cat") * 0.5)
    rows = rows.select(
        F.col("n_cat").alias("n_cat_ai"), F.ceil(F.col("n_cat") / V.BATCH_SIZE).alias("n_batches"),
        (F.col("n_char") + guessed).alias("n_char_ai"),
        (F.ceil(F.col("n_cat") / V.BATCH_SIZE) * (300 + F.col("n_categories") * 5) + F.col("n_cat") * 30).alias("cat_input"),
        (F.col("n_cat") * 15).alias("cat_output"),
        ((F.col("n_char") + guessed) * 350).alias("char_input"), (F.col("char_out") + guessed * 50).alias("char_output"),
    )
    total_in, total_out = F.col("cat_input") + F.col("char_input"), F.col("cat_output") + F.col("char_output")
    return rows.withColumn("total_input", total_in).withColumn("total_output", total_out).withColumn(
        "cost_usd", F.round(total_in * V.PRICE_IN + total_out * V.PRICE_OUT, 6)
    )


# ---------------------------------------------------------------- results of a run


def run_kpis(results: DataFrame) -> DataFrame:
    return results.agg(
        _count((F.size("new_chars") > 0) | (F.size("cleared") > 0)).alias("updated"), _sum(F.size("new_chars")).alias("attributes_added"),
        _sum(F.size("cleared")).alias("values_cleared"), _count(F.col("needs_manual")).alias("needs_manual"),
        _count(F.col("action").isin(*FIXED)).alias("categories_fixed"), _count(F.col("action") == "cat_assigned").alias("assigned"),
        _count(F.col("action") == "cat_corrected").alias("corrected"),
    )


def skipped(codes: list[str]) -> Column:
    """Offers a run left alone because their code is not processed."""
    return (F.col("action") == "skip") & ~F.coalesce(F.col("error_code"), F.lit("empty")).isin(*codes)


def run_summary(results: DataFrame, codes: list[str]) -> DataFrame:
    out = skipped(codes)
    return results.agg(
        F.count("*").alias("total"), _count(~out).alias("processed"), _count(out).alias("skipped"),
        _count(F.col("action").isin(*FIXED)).alias("categories_fixed"), _sum(F.size("new_chars")).alias("attributes_added"),
        _sum(F.size("cleared")).alias("values_cleared"), (_count(~out) - _count(F.col("needs_manual"))).alias("completed"),
        _count(F.col("needs_manual")).alias("manual"),
    )


def reason(codes: list[str]) -> Column:
    """Status text of a result row, from how its category was actually resolved."""
    code = F.coalesce("error_code", F.lit("N/A"))
    n_new, n_cleared = F.size("new_chars"), F.size("cleared")
    parts = F.concat_ws(
        " | ",
        F.when(F.col("action") == "cat_assigned", F.concat(F.lit("Categorie atribuita: "), "new_category"))
        .when(F.col("action") == "cat_corrected", F.concat(F.lit("Categorie corectata: "), "new_category")),
        F.when(n_new > 0, F.concat(n_new, F.lit(" caracteristici completate automat"))),
        F.when(n_cleared > 0, F.concat(n_cleared, F.lit(" valori invalide sterse"))),
    )
    return (
        F.when(skipped(codes), F.concat(F.lit("Fara eroare (cod: "), code, F.lit(") — omis")))
        .when(F.col("needs_manual") & (F.col("new_category") == ""), F.concat(F.lit("Categorie negasita (eroare "), code, F.lit(")")))
        .when(F.col("needs_manual") & (F.size("missing_mandatory") > 0),
              F.concat(F.lit("Caracteristici obligatorii lipsa: "), F.array_join("missing_mandatory", ", ")))
        .when(F.col("needs_manual"), F.lit("Necesita verificare manuala"))
        .when(parts != "", parts).otherwise(F.lit("Procesat fara modificari"))
    )


def run_log_rows(results: DataFrame, codes: list[str]) -> DataFrame:
    """Per processed offer what a run log keeps of it."""
    return results.where(~skipped(codes)).select(
        "offer_id", F.substring("title", 1, 120).alias("title"), "error_code", "action",
        F.when(F.col("action") != "skip", F.col("new_category")).otherwise(F.lit("")).alias("new_category"), "new_chars", "cleared",
        reason(codes).alias("reason"), "category_reason", "chars_reasons", "missing_mandatory", F.col("needs_manual").alias("unmapped"),
    )


def results_filter(results: DataFrame, kind: str = "all", search: str = "") -> DataFrame:
    """``new``, ``manual``, ``category`` or ``cleared`` results whose title holds the text."""
    conditions = {
        "all": F.lit(True), "new": F.size("new_chars") > 0, "manual": F.col("needs_manual"), "category": F.col("action").isin(*FIXED),
        "cleared": F.size("cleared") > 0,
    }
    rows = results.where(conditions[kind])
    return rows.where(F.contains(F.lower("title"), F.lit(search.lower()))) if search else rows


def unmapped_filter(results: DataFrame, kind: str = "all", search: str = "") -> DataFrame:
    """Offers left for manual work, by missing ``category`` or missing ``attributes``."""
    rows = results.where("needs_manual")
    if kind == "category":
        rows = rows.where("category_reason IS NOT NULL")
    if kind == "attributes":
        rows = rows.where(F.size("chars_reasons") > 0)
    return rows.where(F.contains(F.lower("title"), F.lit(search.lower()))) if search else rows


def head(rows: DataFrame, n: int, *order) -> DataFrame:
    """First n rows in an order, for previews."""
    return rows.orderBy(*order).limit(n)


def category_reason_counts(results: DataFrame) -> DataFrame:
    return results.where("category_reason IS NOT NULL").groupBy("category_reason").agg(F.count("*").alias("n"))


def char_reason_counts(results: DataFrame) -> DataFrame:
    rows = results.select(F.explode("chars_reasons").alias("char_name", "reason"))
    return rows.groupBy("char_name", "reason").agg(F.count("*").alias("n"))


def reason_share(counts: DataFrame) -> DataFrame:
    """Counts with their percentage of the whole, one decimal."""
    whole = F.sum("n").over(W.partitionBy())  # counts are a row per reason
    return counts.withColumn("pct", F.bround(F.col("n") / whole * 100, 1))


def top_problem_chars(counts: DataFrame, n: int = 10) -> DataFrame:
    """Attributes with most affected offers."""
    return counts.groupBy("char_name").agg(F.sum("n").alias("offers")).orderBy(F.desc("offers"), "char_name").limit(n)


def resolver_summary(results: DataFrame) -> DataFrame:
    """method -> review events, resolved and unresolved."""
    rows = results.select("offer_id", F.explode("review").alias("r"))
    return rows.groupBy("r.method").agg(
        F.count("*").alias("events"), _count(F.col("r.value").isNotNull()).alias("resolved"), _count(F.col("r.value").isNull()).alias("unresolved")
    )


def source_detail_stats(audit: DataFrame) -> DataFrame:
    """offer_id -> attribute entries by source and by outcome. ``audit``: offer_id, source, accept."""
    return audit.groupBy("offer_id").agg(
        F.count("*").alias("total"), *[_count(F.col("source") == s).alias(s) for s in ("rule", "ai", "image")],
        _count(F.col("accept")).alias("passed"), _count(~F.col("accept")).alias("failed"),
    )


def cumulative_stats(runs: DataFrame) -> DataFrame:
    """Running totals over run rows (run_id, run_ts, action, new_chars, needs_manual)."""
    return runs.agg(
        F.count("*").alias("total_processed"), _sum(F.size("new_chars")).alias("total_chars_added"),
        _count((F.size("new_chars") > 0) & ~F.col("needs_manual")).alias("total_completed"),
        _count(F.col("action").isin(*FIXED)).alias("total_cats_fixed"), F.countDistinct("run_id").alias("runs"), F.max("run_ts").alias("last_run"),
    )


# ---------------------------------------------------------------- telemetry


def _accept_rate() -> Column:
    return F.avg(F.col("fields_accepted") / F.nullif(F.col("fields_requested"), F.lit(0))) * 100


def telemetry_summary(log: DataFrame) -> DataFrame:
    n = F.nullif(F.count("*"), F.lit(0))
    return log.agg(
        F.count("*").alias("total_runs"), F.round(_accept_rate(), 1).alias("accept_rate_pct"), F.round(F.avg("cost_usd"), 6).alias("avg_cost_usd"),
        F.round(_count(F.col("retry_count") > 0) * 100.0 / n, 1).alias("retry_rate_pct"),
        F.round(_count(F.col("fallback_used")) * 100.0 / n, 1).alias("fallback_rate_pct"),
    )


def structured_summary(log: DataFrame) -> DataFrame:
    """Structured requests: attempted, succeeded, fell back, mean latency, commonest model (the
    smallest name among equals)."""
    rows = log.where("structured_mode <> 'off'")
    named = rows.where("structured_attempted AND structured_model_used <> ''")
    top = named.groupBy("structured_model_used").agg(F.count("*").alias("n")).agg(
        F.min_by("structured_model_used", F.struct(-F.col("n"), F.col("structured_model_used"))).alias("top_model")
    )
    return rows.agg(
        _count(F.col("structured_attempted")).alias("attempted"), _count(F.col("structured_success")).alias("success"),
        _count(F.col("structured_fallback_used")).alias("fallback"),
        F.round(F.avg(F.when(F.col("structured_attempted"), F.col("structured_latency_ms"))), 0).alias("avg_latency"),
    ).join(F.broadcast(top))


def telemetry_by_marketplace(log: DataFrame, n: int = 10) -> DataFrame:
    return (
        log.groupBy("marketplace")
        .agg(F.count("*").alias("runs"), F.round(_accept_rate(), 1).alias("accept_rate"), F.round(F.sum("cost_usd"), 4).alias("total_cost_usd"))
        .orderBy(F.desc("runs"), "marketplace").limit(n)
    )


SHADOW = (
    "agree array<string>, only_structured array<string>, only_plain array<string>, "
    "value_conflicts map<string,struct<structured:string,plain:string>>"
)


def shadow_agreement(log: DataFrame, last: int | None = None) -> DataFrame:
    """Over all shadow comparisons, or the newest ``last``: runs, agreement percentage, runs with conflicts."""
    newest = log.where("structured_mode = 'shadow' AND shadow_diff IS NOT NULL")
    if last is not None:
        newest = newest.orderBy(F.desc("created_at"), "run_id").limit(last)
    d = newest.select(F.from_json("shadow_diff", SHADOW).alias("d")).select("d.*").na.drop("all")
    empty = F.array().cast("array<string>")
    agree, left, right = [F.coalesce(c, empty) for c in ("agree", "only_structured", "only_plain")]
    keys = F.size(F.array_union(F.array_union(agree, left), right))
    return d.agg(
        F.count("*").alias("shadow_runs"), F.bround(_sum(F.size(agree)) / F.greatest(_sum(keys), F.lit(1)) * 100, 1).alias("agreement_rate"),
        _count(F.size(F.map_keys("value_conflicts")) > 0).alias("runs_with_conflicts"),
    )


def vision_counters(events: DataFrame) -> DataFrame:
    """run_id -> the named counters. ``events``: run_id, counter, n."""
    return events.groupBy("run_id").agg(
        *[_sum(F.when(F.col("counter") == c, F.col("n")).otherwise(0)).alias(c) for c in V.VISION_COUNTERS]
    )


def knowledge_size(knowledge: DataFrame) -> DataFrame:
    return knowledge.agg(F.count("*").alias("n"))


def latest_run(runs: DataFrame) -> DataFrame:
    """Rows of the newest run per marketplace (marketplace, run_ts, run_id, …)."""
    newest = runs.groupBy("marketplace").agg(F.max_by("run_id", F.struct("run_ts", "run_id")).alias("run_id"))
    return runs.join(newest, ["marketplace", "run_id"], "left_semi")


# ---------------------------------------------------------------- logs

LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR")


def level_rank(level: Column) -> Column:
    out = F.lit(0)
    for rank, name in enumerate(LEVELS):
        out = F.when(level == name, F.lit(rank)).otherwise(out)
    return out


def log_filter(entries: DataFrame, min_level: str = "ALL", source: str = "ALL", last: int | None = None) -> DataFrame:
    """Entries (ts, level, source, message) at or above a level, of one source, the newest ``last``."""
    rows = entries
    if min_level != "ALL":
        rows = rows.where(level_rank(F.col("level")) >= LEVELS.index(min_level))
    if source != "ALL":
        rows = rows.where(F.col("source") == source)
    return rows.orderBy(F.desc("ts"), "source", "message").limit(last) if last else rows


def app_entries(lines: DataFrame) -> DataFrame:
    """Application log lines (value) as entries; other lines are left out."""
    return lines.select(log_line_parse("value").alias("l")).where("l IS NOT NULL").select("l.ts", "l.level", F.lit("app").alias("source"), "l.message")


def unified_log(app: DataFrame, runs: DataFrame, model: DataFrame, vision: DataFrame) -> DataFrame:
    """Four logs as (ts, level, source, message).

    ``app``: value; ``runs``: timestamp, marketplace, file, processed; ``model``: timestamp, type,
    marketplace, offer_id; ``vision``: ts, level, stage, event, offer_id, status.
    """
    stamp = lambda c: F.substring(F.replace(F.col(c).cast("string"), F.lit("T"), F.lit(" ")), 1, 19)
    info = F.lit("INFO")
    run_rows = runs.select(
        stamp("timestamp").alias("ts"), info.alias("level"), F.lit("process").alias("source"),
        F.concat(F.lit("Run: "), "marketplace", F.lit(" | "), "file", F.lit(" | "), F.col("processed"), F.lit(" produse")).alias("message"),
    )
    model_rows = model.select(
        stamp("timestamp").alias("ts"), info.alias("level"), F.lit("ai").alias("source"),
        F.concat(F.lit("["), "type", F.lit("] "), "marketplace", F.lit(" | offer="), "offer_id").alias("message"),
    )
    vision_rows = vision.select(
        stamp("ts").alias("ts"), F.coalesce("level", info).alias("level"), F.lit("vision").alias("source"),
        F.concat(F.lit("["), "stage", F.lit(":"), "event", F.lit("] offer="), "offer_id", F.lit(" status="), "status").alias("message"),
    )
    return app_entries(app).unionByName(run_rows).unionByName(model_rows).unionByName(vision_rows)


def truncate_strings(c: Column, max_len: int = 800) -> Column:
    """Long text cut, with the number of characters left out."""
    return F.when(F.length(c) > max_len, F.concat(F.substring(c, 1, max_len), F.lit("…[+"), F.length(c) - max_len, F.lit("]"))).otherwise(c)
