"""The whole repair of an offer table.

Offers are read once: every row is written to the shared folder under a number of its own (ids may be blank or
repeated), with the visible text instead of the markup and with what the options say of it; every step reads the
columns it needs. Existing attributes, rules, product knowledge, suggestions and image values are one
long table of evidence; it passes the matching and the gate together and is folded once per offer, in the
order of ``PRECEDENCE``. Reference sides are unique per key, so joins never multiply rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offermend import fixed_values as V
from offermend.functions.html import strip_html
from offermend.functions.text import error_code, norm_text, strip
from offermend.operators.detect import (
    Rule,
    applicable_concepts,
    builtin_rules,
    concept_names_table,
    detect_by_words,
    keyword_rules,
    resolve_rules,
    size_and_age,
    size_and_age_value,
)
from offermend.operators.indexes import ReferenceIndex, mandatory_index
from offermend.operators.knowledge import knowledge_lookup
from offermend.operators.matching import KEY, gate_columns, match_suggested_categories, match_values, resolve_categories
from offermend.operators.suggest import accept_suggestions
from offermend.operators.vision import action_confidence, fuse_category
from offermend.session import staged

#: Of two new values of an attribute the one of the source named first counts.
PRECEDENCE = {"existing": 0, "rule": 1, "knowledge": 2, "suggestion": 3, "image": 4}


@dataclass
class Options:
    """What a run may use. Tables are optional; ``use_model`` only words the reasons."""

    codes: list[str] = field(default_factory=lambda: list(V.DEFAULT_ERROR_CODES["eMAG Romania"]))
    rules: list[Rule] = field(default_factory=builtin_rules)
    concept_names: dict[str, list[str]] | None = None
    category_rules: DataFrame | None = None  # keywords, exclude, category, ordinal
    category_suggestions: DataFrame | None = None  # offer_id, suggested; the first in text order counts
    suggestions: DataFrame | None = None  # offer_id, position, char_input, value_input
    repair_choices: DataFrame | None = None  # cat, char_name, value_input, choice; likewise
    image_values: DataFrame | None = None  # offer_id, char_input, value_input
    image_hints: DataFrame | None = None  # offer_id, image_candidate, image_confidence; the most confident counts
    image_suggestion_only: bool = False  # image values are shown, neither checked nor filled in
    fusion: str = "review"  # policy of ``fuse_category``
    knowledge: DataFrame | None = None  # ``schemas.PRODUCT_KNOWLEDGE``, looked up by ean or brand and title
    marketplace: str = ""
    filter_category: str | None = None
    target_char: str | None = None
    use_model: bool = False
    fuzzy: bool = True


REJECTED = "array<struct<source:string,char_name:string,value_input:string,reason:string>>"
REVIEW = "array<struct<char_name:string,value_input:string,value:string,method:string,score:double,reason:string>>"
STRINGS = "map<string,string>"
ITEMS = "array<struct<prio:int,position:int,char_name:string,value:string>>"
#: What becomes of an offer's evidence; each is gathered by itself.
VERDICTS = ("cleared", "new", "rejected", "kept")


def mandatory_profile(index: ReferenceIndex) -> DataFrame:
    """cat -> mandatory attributes in file order, each with whether it has listed values."""
    listed = index.values.select("cat", "char_name").distinct().withColumn("has_values", F.lit(True))
    rows = mandatory_index(index.attributes).join(listed, ["cat", "char_name"], "left")
    entry = F.struct("ordinal", "char_name", F.coalesce("has_values", F.lit(False)).alias("has_values"))
    return rows.groupBy("cat").agg(F.sort_array(F.collect_list(entry)).alias("mandatory"))


def _eligible(options: Options) -> Column:
    eligible = F.coalesce(error_code("error"), F.lit("empty")).isin(*options.codes) if options.codes else F.lit(False)
    if options.filter_category:
        wanted = options.filter_category.strip().lower()
        eligible = eligible & (F.lower(strip(F.coalesce("category", F.lit("")))) == wanted)
    return eligible


def resolve_offers(offers: DataFrame, index: ReferenceIndex, options: Options) -> DataFrame:
    """Offers with error_code, eligible, cat, new_category, category_action and category_reason."""
    coded = offers.withColumn("error_code", error_code("error")).withColumn("eligible", _eligible(options))
    own = resolve_categories(coded.where("category <> ''"), index, options.fuzzy)
    rows = coded.join(own.select("category", F.col("cat").alias("own_cat")), "category", "left")

    by_rule = suggested = F.lit(None).cast("string")
    rule_cat = model_cat = F.lit(None).cast("string")
    cats = index.categories.select("category_name", "cat")
    if options.category_rules is not None:
        open_titles = rows.where("eligible AND own_cat IS NULL").select("title")
        ruled = keyword_rules(open_titles, options.category_rules).select("title", F.col("category").alias("rule_category"))
        ruled = ruled.join(cats.select(F.col("category_name").alias("rule_category"), F.col("cat").alias("rule_cat")), "rule_category")
        rows = rows.join(staged(ruled), "title", "left")
        by_rule, rule_cat = F.col("rule_category"), F.col("rule_cat")
    if options.category_suggestions is not None:
        if "suggested" not in offers.columns:
            rows = rows.join(options.category_suggestions.select("offer_id", "suggested"), "offer_id", "left")
        known = match_suggested_categories(rows, index, options.fuzzy)
        known = staged(known.join(cats.select("category_name", F.col("cat").alias("model_cat")), "category_name"))
        rows = rows.join(known.withColumnRenamed("category_name", "model_category"), "suggested", "left")
        suggested, model_cat = F.col("suggested"), F.col("model_cat")
    else:
        rows = rows.withColumn("model_category", F.lit(None).cast("string"))

    has_own = F.col("own_cat").isNotNull()
    text = F.coalesce("category", F.lit(""))
    rule_action = F.when(text == "", F.lit("cat_assigned")).otherwise(F.lit("cat_corrected"))
    reason = (
        F.when(suggested == V.TIMEOUT_MARK, F.lit(V.CATEGORY_TIMEOUT_REASON))
        .when(suggested.isNotNull() & (suggested != ""),
              F.concat(F.lit(V.CATEGORY_UNKNOWN_REASON[0]), suggested, F.lit(V.CATEGORY_UNKNOWN_REASON[1])))
        .otherwise(F.lit(V.CATEGORY_NULL_REASON if options.use_model else V.CATEGORY_OFF_REASON))
    )
    cat = F.coalesce("own_cat", rule_cat, model_cat)
    return rows.select(
        *offers.columns, "error_code", "eligible",
        F.when(F.col("eligible"), cat).alias("cat"),
        F.when(has_own, text)
        .when(F.col("eligible"), F.coalesce(by_rule, F.when(model_cat.isNotNull(), F.col("model_category")), F.lit("")))
        .otherwise(F.lit("")).alias("new_category"),
        F.when(~F.col("eligible") | has_own, F.lit("skip"))
        .when(rule_cat.isNotNull(), rule_action)
        .when(model_cat.isNotNull(), F.lit("cat_assigned")).otherwise(F.lit("skip")).alias("category_action"),
        F.when(F.col("eligible") & cat.isNull(), reason).alias("category_reason"),
    )


def _long(rows: DataFrame, source: str, position: Column, mode: str | None = None) -> DataFrame:
    return rows.select(
        "offer_id", "cat", "char_input", "value_input", F.lit(source).alias("source"), position.cast("int").alias("position"),
        (F.col("mode") if mode is None else F.lit(mode)).alias("mode"),
    )


def _prio(source: str) -> Column:
    return F.lit(PRECEDENCE[source])


def _by_offer(options: Options) -> list[DataFrame]:
    """What the options say of single offers, a table each with one row per offer id (as ``_shown``)."""
    shown = F.col("offer_id").alias("_shown")
    tables = []
    if options.category_suggestions is not None:
        tables.append(options.category_suggestions.groupBy(shown).agg(F.min("suggested").alias("suggested")))
    if options.suggestions is not None:
        asked = F.collect_list(F.struct("position", "char_input", "value_input"))
        tables.append(options.suggestions.groupBy(shown).agg(asked.alias("suggestions")))
    if options.image_values is not None:
        tables.append(options.image_values.groupBy(shown).agg(F.collect_list(F.struct("char_input", "value_input")).alias("images")))
    if options.image_hints is not None:
        surest = F.max_by("image_candidate", F.struct("image_confidence", "image_candidate")).alias("image_candidate")
        tables.append(options.image_hints.groupBy(shown).agg(surest, F.max("image_confidence").alias("image_confidence")))
    return tables


def _read_once(offers: DataFrame, options: Options) -> DataFrame:
    """What a run needs of the offers and of what the options say of them, written once under a number a row. Rows are
    dealt evenly first, as a file may come in few pieces; markup is read only where the offer is eligible."""
    texts = [F.col(c).cast("string").alias(c) if c in offers.columns else F.lit(None).cast("string").alias(c) for c in ("title", "error", "category", "ean", "brand")]
    markup = F.when(_eligible(options), F.col("description"))
    rows = offers.select(F.col("offer_id").alias("shown_id"), *texts, "existing_chars", markup.alias("visible")).hint("rebalance")
    rows = rows.withColumn("visible", strip_html("visible"))
    for said in _by_offer(options):
        rows = rows.join(said, F.col("shown_id") == F.col("_shown"), "left").drop("_shown")
    return staged(rows.select(F.monotonically_increasing_id().alias("offer_id"), "*"))


def _known_values(live: DataFrame, options: Options) -> DataFrame:
    """Attributes stored for the same product (offer_id, cat, char_input, value_input)."""
    asked = live.select("offer_id", "ean", "brand", norm_text("title").alias("normalized_title"), F.lit(options.marketplace).alias("marketplace_id"))
    found = knowledge_lookup(asked, options.knowledge).select("offer_id", F.explode("final_attributes").alias("char_input", "value_input"))
    return found.join(live.select("offer_id", "cat"), "offer_id")


def process_offers(offers: DataFrame, index: ReferenceIndex, options: Options | None = None) -> DataFrame:
    """Results of a run: one row per offer in the ``RESULTS`` schema (see ``schemas``), plus ``cat``, ``kept``
    (existing attributes that stay), ``audit_rejected`` (names of values turned down), ``rejected`` (what
    knowledge and images proposed and the gate turned down, with value and reason), ``image_analysis`` (hint,
    its confidence and the proposed values; null without any), ``fusion_reason`` (why the category of
    text and hint is what it is; null unless it was settled by both) and ``sources`` (where each of ``new_chars``
    is from, by the names of ``PRECEDENCE``)."""
    options = options or Options()
    spark = offers.sparkSession
    index = index.stored()
    offers = _read_once(offers, options)
    names = concept_names_table(spark, options.concept_names)
    concepts = staged(applicable_concepts(index, names))
    base = resolve_offers(offers, index, options)
    live = base.where("cat IS NOT NULL")

    # values that need a look-up, one long table
    filled = F.coalesce(strip("value_input"), F.lit("")) != ""
    existing = live.select("offer_id", "cat", F.posexplode("existing_chars").alias("position", "char_input", "value_input"))
    long = _long(existing.where(filled), "existing", F.col("position"), "existing")
    long = long.unionByName(_long(size_and_age(live, concepts), "rule", F.col("step")))
    if options.knowledge is not None:
        long = long.unionByName(_long(_known_values(live, options).where(filled), "knowledge", F.lit(0), "gate"))
    long = staged(long)  # read for its distinct keys and again for the rows
    if options.image_values is not None and not options.image_suggestion_only:
        # many rows an offer, which are sooner opened twice than written
        image = live.select("offer_id", "cat", F.inline("images"))
        long = long.unionByName(_long(image.where(filled), "image", F.lit(0), "gate"))
    matched = long.join(match_values(long, index, options.fuzzy), KEY, "left")
    mapped, reason = gate_columns()
    value = F.when(F.col("mode") == "existing", F.col("value_input")).when(F.col("mode") == "gate", mapped).otherwise(size_and_age_value())
    verdict = (
        F.when(F.col("mode") != "existing", F.when(value.isNotNull(), F.lit("new")).otherwise(F.lit("rejected")))
        .when(F.col("has_values") & F.col("lower_value").isNull(), F.lit("cleared"))
        .when(F.col("canonical").isNull(), F.lit("cleared"))
        .otherwise(F.lit("kept"))
    )
    turned_down = F.when(
        (F.col("mode") == "gate") & value.isNull(),
        F.array(F.struct("source", F.col("char_input").alias("char_name"), strip("value_input").alias("value_input"), reason.alias("reason"))),
    )
    prio = F.coalesce(*[F.when(F.col("source") == s, F.lit(n)) for s, n in PRECEDENCE.items()])
    entry = matched.select(
        "offer_id", prio.alias("prio"), "position", verdict.alias("verdict"),
        F.when(F.col("mode") == "existing", F.col("char_input")).otherwise(F.coalesce("canonical", "char_input")).alias("char_name"),
        value.alias("value"), F.lit(None).cast(REVIEW).alias("review"), turned_down.cast(REJECTED).alias("rejected"),
    )
    if options.suggestions is not None:
        asked = live.select("offer_id", "cat", F.inline("suggestions"))
        if options.target_char is not None:
            asked = asked.where(F.col("char_input") == options.target_char)
        entry = entry.unionByName(_suggested(accept_suggestions(asked, index, options.repair_choices, fuzzy=options.fuzzy), index, options), allowMissingColumns=True)
    resolved = staged(resolve_rules(index, concepts, options.rules, options.fuzzy, gated=True))
    # an offer has a bounded number of attributes, so its arrays are small
    item = F.struct("prio", "position", "char_name", "value")
    per_offer = entry.groupBy("offer_id").agg(
        *[F.collect_list(F.when(F.col("verdict") == kind, item)).alias(f"all_{kind}") for kind in VERDICTS],
        F.collect_list("review").alias("all_review"), F.collect_list("rejected").alias("all_turned_down"),
    )
    live_only = lambda c: F.when(F.col("cat").isNotNull(), F.col(c))
    read = base.withColumns({"shown_title": F.col("title"), "title": live_only("title"), "visible": live_only("visible")})
    words = F.transform("detected", lambda d: F.struct(
        _prio("rule").alias("prio"), F.lit(0).alias("position"), d["attribute"].alias("char_name"), d["value"].alias("value")
    ))
    base = detect_by_words(read, resolved, options.rules).withColumns({"title": F.col("shown_title"), "words": words})
    base = base.drop("shown_title", "detected", "visible", "existing_chars", "suggestions", "error", "ean", "brand")
    return _assemble(_fused(base, index, options), per_offer, index, options)


def _fused(base: DataFrame, index: ReferenceIndex, options: Options) -> DataFrame:
    """The offers with ``image_analysis`` and ``fusion_reason``; where text and image hint settle on a category
    that the marketplace knows, it is shown as the new one. Attributes keep to the category they were checked for."""
    rows, seen = base, F.lit(False)
    if options.image_hints is not None:
        seen = F.col("image_candidate").isNotNull()
    else:
        rows = rows.withColumns({"image_candidate": F.lit(None).cast("string"), "image_confidence": F.lit(None).cast("double")})
    if options.image_values is not None:
        # the least value of each attribute; null only where it has no other
        ranked = F.transform("images", lambda i: F.struct(i["char_input"].alias("char_input"), i["value_input"].isNull().alias("unset"), i["value_input"].alias("value_input")))
        rows = rows.withColumn("images", F.sort_array(ranked))
        least = F.filter("images", lambda i, n: (n == 0) | ~i["char_input"].eqNullSafe(F.get("images", n - 1)["char_input"]))
        rows = rows.withColumn("proposed", F.map_from_entries(F.transform(least, lambda i: F.struct(i["char_input"], i["value_input"])))).drop("images")
    else:
        rows = rows.withColumn("proposed", F.lit(None).cast(STRINGS))
    live = F.col("cat").isNotNull()
    analysis = F.struct(F.col("image_candidate").alias("hint"), F.col("image_confidence").alias("hint_confidence"), "proposed")
    rows = rows.withColumn("image_analysis", F.when(live & (seen | F.col("proposed").isNotNull()), analysis))
    if options.image_hints is None:
        return rows.withColumn("fusion_reason", F.lit(None).cast("string"))
    signals = rows.withColumns({"text_candidate": F.col("new_category"), "text_confidence": action_confidence(F.col("category_action"))})
    settled = fuse_category(signals, options.fusion)
    named = base.select(F.col("image_candidate").alias("category")).where("category <> ''").distinct()
    known = resolve_categories(named, index, options.fuzzy).where("cat IS NOT NULL").select(F.col("category").alias("image_candidate"), F.lit(True).alias("_known"))
    settled = settled.join(known, "image_candidate", "left")
    asked = live & (F.coalesce("image_candidate", F.lit("")) != "") & (F.col("image_confidence") > 0) & (F.col("final_category") != "")
    takes = asked & ((F.col("final_category") == F.col("new_category")) | F.coalesce("_known", F.lit(False)))
    return settled.withColumns({
        "new_category": F.when(takes, F.col("final_category")).otherwise(F.col("new_category")),
        "fusion_reason": F.when(takes, F.concat_ws(": ", "rule_applied", "case_name")),
    })


def _suggested(accepted: DataFrame, index: ReferenceIndex, options: Options) -> DataFrame:
    """Accepted suggestions through the gate, as entries; reviewed ones also as review items."""
    through = accepted.where("value IS NOT NULL").select(
        "offer_id", "cat", "position", "char_input", F.col("value").alias("value_input")
    )
    gated = through.join(match_values(through, index, options.fuzzy), KEY, "left")
    value = F.when(
        F.col("canonical").isNotNull(), F.coalesce("found", F.when(~F.col("has_values"), F.coalesce("fallback", strip("value_input"))))
    )
    entry = gated.select(
        "offer_id", _prio("suggestion").alias("prio"), "position", F.when(value.isNotNull(), F.lit("new")).otherwise(F.lit("rejected")).alias("verdict"),
        F.coalesce("canonical", "char_input").alias("char_name"), value.alias("value"), F.lit(None).cast(REVIEW).alias("review"),
    )
    note = F.array(F.struct(F.col("char_input").alias("char_name"), "value_input", "value", "method", "score", "reason"))
    reviewed = accepted.where("needs_review").select(
        "offer_id", _prio("suggestion").alias("prio"), "position", F.lit("review").alias("verdict"), F.col("char_input").alias("char_name"),
        "value", note.cast(REVIEW).alias("review"),
    )
    return entry.unionByName(reviewed)


def _assemble(base: DataFrame, per_offer: DataFrame, index: ReferenceIndex, options: Options) -> DataFrame:
    """Everything known about an offer put into its result row; array work inside the row only."""
    rows = base.join(per_offer, "offer_id", "left").join(staged(mandatory_profile(index)), "cat", "left")
    of = lambda kind: F.sort_array(F.coalesce(f"all_{kind}", F.array().cast(ITEMS)))
    to_map = lambda items: F.map_from_entries(F.transform(items, lambda i: F.struct(i["char_name"], i["value"])))
    rows = rows.withColumns({
        "cleared_items": of("cleared"), "new_items": F.sort_array(F.concat(of("new"), "words")),
        "audit_rejected": of("rejected")["char_name"], "kept": to_map(of("kept")),
        "review": F.flatten("all_review"), "rejected": F.sort_array(F.flatten("all_turned_down")),
    })
    # rules skip attributes that hold a value, knowledge and image values do too; suggestions answer a request
    free = F.filter(
        "new_items",
        lambda i: (i["prio"] == PRECEDENCE["suggestion"]) | ~F.map_contains_key(F.col("kept"), i["char_name"]),
    )
    rows = rows.withColumn("_items", free)
    # the names are taken out of the items once, not for every item
    once = F.array(F.struct(F.col("_items").alias("items"), F.col("_items")["char_name"].alias("names")))
    first = F.transform(once, lambda o: F.filter(o["items"], lambda i, n: F.array_position(o["names"], i["char_name"]) == n + 1))
    rows = rows.withColumn("_first", F.get(first, F.lit(0)))
    named = F.create_map(*[F.lit(x) for source, n in PRECEDENCE.items() for x in (n, source)])
    rows = rows.withColumns({
        "new_chars": to_map(F.col("_first")),
        "sources": F.map_from_entries(F.transform("_first", lambda i: F.struct(i["char_name"], named[i["prio"]]))),
    })
    missing = F.filter(
        F.coalesce("mandatory", F.array().cast("array<struct<ordinal:bigint,char_name:string,has_values:boolean>>")),
        lambda m: ~F.map_contains_key(F.col("kept"), m["char_name"]) & ~F.map_contains_key(F.col("new_chars"), m["char_name"]),
    )
    rows = rows.withColumn("_missing", missing)
    why = F.map_from_entries(
        F.transform(
            "_missing",
            lambda m: F.struct(
                m["char_name"],
                F.when(~m["has_values"], F.lit(V.NO_VALUES_REASON)).otherwise(
                    F.lit(V.MODEL_MISS_REASON if options.use_model else V.RULE_MISS_REASON)
                ),
            ),
        )
    )
    live = F.col("cat").isNotNull()
    no_names = F.array().cast("array<string>")
    return rows.select(
        F.col("shown_id").alias("offer_id"), "title", F.coalesce("category", F.lit("")).alias("original_cat"), "error_code",
        F.when((F.col("category_action") == "skip") & live & ((F.size("new_chars") > 0) | (F.size("cleared_items") > 0)), F.lit("updated"))
        .otherwise(F.col("category_action")).alias("action"),
        "new_category",
        F.col("cleared_items")["char_name"].alias("cleared"),
        "new_chars",
        F.col("_missing")["char_name"].alias("missing_mandatory"),
        (F.col("eligible") & (~live | (F.size("_missing") > 0))).alias("needs_manual"),
        "category_reason",
        why.alias("chars_reasons"),
        F.coalesce("review", F.array().cast(REVIEW)).alias("review"),
        "cat", "kept", F.coalesce("audit_rejected", no_names).alias("audit_rejected"),
        F.coalesce("rejected", F.array().cast(REJECTED)).alias("rejected"), "image_analysis", "fusion_reason", "sources",
    )


def offer_summary(results: DataFrame) -> DataFrame:
    """offer_id -> one line on what was filled and what is still missing, with reasons."""
    filled = F.array_join(
        F.array_sort(F.transform(F.map_entries("new_chars"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ", "
    )
    missing = F.array_join(
        F.transform("missing_mandatory", lambda m: F.concat(m, F.lit(": "), F.element_at("chars_reasons", m))), ", "
    )
    return results.select(
        "offer_id", F.size("new_chars").alias("n_filled"), filled.alias("filled"), F.size("missing_mandatory").alias("n_missing"),
        missing.alias("missing"),
    )


