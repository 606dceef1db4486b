"""A run that asks only for what no earlier run learned, and writes back what it learned itself.

    learned = Learned(spark, "/shared/offers/learned")
    options = recall(offers, learned, options)            # knowledge, known titles, learned rules
    first = process_offers(offers, index, options)
    asked = requests(offers, first, index, learned, options)
    ... ask the model about asked.titles and asked.attributes, put the replies into ledgers ...
    results = process_offers(offers, index, answered(options, asked, titles, fields))
    learn(learned, offers, results, asked, index, titles, options)

Requests are keyed by content (title, category and the attributes that are missing), so equal offers are asked about
once, whatever their ids. Answers reach offers by id: offers without one are not asked about, as they could not take
the answer, but take what is known of their title and product. Equal ids share their answers.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offermend.functions.text import char_request_key, done_key, norm_text, strip, title_key
from offermend.operators.indexes import ReferenceIndex, mandatory_index
from offermend.operators.knowledge import cached_attributes, category_cache_rows, learned_rules, not_done
from offermend.operators.ledger import category_answers, field_answers
from offermend.operators.matching import match_suggested_categories
from offermend.operators.suggest import display_names, fillable_options, prompt_fields
from offermend.plans.process_offers import Options
from offermend.session import staged
from offermend.sources.learned import Learned, Version


@dataclass
class Requests:
    """What is left to ask: ``titles`` (offer_id = key of the title, title, description), ``attributes`` (offer_id =
    request key, title, category, description, brand, ean), their ``fields`` (with shown names); ``offers`` leads from
    offer ids to request keys, ``cached`` holds values of replies of earlier runs (offer_id, position, char_input,
    value_input)."""

    titles: DataFrame
    attributes: DataFrame
    fields: DataFrame
    offers: DataFrame
    cached: DataFrame


def _column(frame: DataFrame, name: str):
    return F.col(name).cast("string") if name in frame.columns else F.lit(None).cast("string")


def product_key(marketplace: str):
    """Key of a product on a marketplace: its ean, or without one its brand and title; null without either."""
    by = lambda kind, *parts: F.md5(F.to_json(F.array(F.lit(kind), F.lit(marketplace), *parts)))
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return F.when(has("ean"), by("ean", F.col("ean"))).when(has("brand") & has("normalized_title"), by("title", F.col("brand"), F.col("normalized_title")))


def _products(offers: DataFrame, marketplace: str) -> DataFrame:
    rows = offers.select("offer_id", "title", _column(offers, "ean").alias("ean"), _column(offers, "brand").alias("brand"), norm_text("title").alias("normalized_title"))
    return rows.withColumn("key", product_key(marketplace))


def recall(offers: DataFrame, learned: Learned, options: Options, version: Version | None = None) -> Options:
    """The options with what earlier runs learned about these offers; what the caller gives goes before it."""
    now = version or learned.version()
    market = options.marketplace
    knowledge = options.knowledge
    if knowledge is None:
        knowledge = learned.lookup("knowledge", _products(offers, market), now).drop("key", "learned_at", "change")
    titles = offers.select("offer_id", title_key("title", F.lit(market)).alias("key"))
    known = titles.join(learned.lookup("categories", titles, now), "key").select("offer_id", F.col("category").alias("suggested"))
    if options.category_suggestions is not None:
        given = options.category_suggestions.select("offer_id", "suggested")
        known = given.unionByName(known.join(given.select("offer_id"), "offer_id", "left_anti"))
    rules = learned.read("rules", now).select(F.col("key").alias("keywords"), "exclude", "category", "ordinal")
    if options.category_rules is not None:
        # learned rules stand behind all given ones; their own numbers are below 2^31
        given = options.category_rules.select("keywords", "exclude", "category", F.col("ordinal").cast("bigint").alias("ordinal"))
        rules = given.unionByName(rules.withColumn("ordinal", F.col("ordinal") + F.lit(2**62)))
    return replace(options, knowledge=staged(knowledge), category_suggestions=staged(known), category_rules=staged(rules))


def requests(
    offers: DataFrame, results: DataFrame, index: ReferenceIndex, learned: Learned, options: Options, version: Version | None = None, mandatory_only: bool = False
) -> Requests:
    """What a model must still be asked, after a run that used ``recall``. ``mandatory_only`` as in ``prompt_fields``."""
    now = version or learned.version()
    market = F.lit(options.marketplace)
    results = staged(results.select("offer_id", "title", "needs_manual", "cat", "new_category", "kept", "new_chars", "sources"))
    text = offers.groupBy("title").agg(F.min(_column(offers, "description")).alias("description"), F.min(_column(offers, "brand")).alias("brand"), F.min(_column(offers, "ean")).alias("ean"))
    open_ = results.where("needs_manual AND cat IS NULL AND title IS NOT NULL AND offer_id IS NOT NULL")
    titles = open_.groupBy(title_key("title", market).alias("offer_id")).agg(F.min("title").alias("title"))
    titles = titles.join(text.select("title", "description"), "title", "left").select("offer_id", "title", "description")

    # a request's key must not change by what was learned meanwhile, so learned values count as missing in it
    learnt = lambda k: F.element_at("sources", k).isin("knowledge", "suggestion")
    names = F.map_keys("new_chars")
    filled = F.array_sort(F.array_union(F.map_keys("kept"), F.filter(names, lambda k: ~learnt(k))))
    live = results.where("cat IS NOT NULL AND title IS NOT NULL AND offer_id IS NOT NULL").select(
        "offer_id", "title", F.col("new_category").alias("category"), "cat", filled.alias("filled"), F.array_sort(F.filter(names, learnt)).alias("known")
    )
    live = live.withColumn("content", F.md5(F.to_json(F.array(F.lower(strip("title")), F.col("category"), F.to_json("filled"), F.to_json("known")))))
    live = staged(live)
    one = live.groupBy("content").agg(F.min(F.struct("title", "category", "cat", "filled", "known")).alias("o")).select("content", "o.*")
    have = one.select(F.col("content").alias("offer_id"), F.explode("filled").alias("char_input")).withColumn("value_input", F.lit("x"))
    lacking = fillable_options(one.select(F.col("content").alias("offer_id"), "cat"), have, index)
    fields = prompt_fields(lacking, index, mandatory_only)
    wanted = fields.groupBy("offer_id").agg(
        F.sort_array(F.collect_list("char_name")).alias("missing"),
        F.sort_array(F.collect_list(F.when(F.col("mandatory"), F.col("char_name")))).alias("mandatory"),
    ).withColumnRenamed("offer_id", "content")
    asked = one.join(wanted, "content").withColumn("key", char_request_key("title", "category", market, F.col("missing")))
    asked = staged(asked.withColumn("offer_id", F.col("content")))

    done = learned.lookup("done", _done_keys(asked, options.marketplace), now).select(F.col("request").alias("key"), "char_name")
    open_requests = not_done(asked.drop("key"), done, options.marketplace).select("content")
    cache = learned.lookup("attributes", asked.select("key"), now).select("key", F.explode("attributes").alias("char_name", "value"))
    hits = staged(cached_attributes(asked, cache, index.values, options.marketplace))
    # a cached reply of which nothing holds any more is asked for again
    settled = hits.select(F.col("offer_id").alias("content")).distinct()
    left = asked.join(open_requests, "content", "left_semi").join(settled, "content", "left_anti")
    lead = live.select("offer_id", "title", "content").join(asked.select("content", "key", "missing", "mandatory", "category"), "content")
    cached = hits.withColumnRenamed("offer_id", "content").join(lead.select("offer_id", "content"), "content").select(
        "offer_id", F.lit(0).alias("position"), F.col("char_name").alias("char_input"), F.col("value").alias("value_input")
    )
    keys = left.select("content", "key")
    # what is known of the product is not asked for; requests with the same key are one
    known = one.select(F.col("content").alias("offer_id"), F.explode("known").alias("char_name"))
    sent = fields.join(known, ["offer_id", "char_name"], "left_anti")
    left = left.join(sent.select(F.col("offer_id").alias("content")).distinct(), "content", "left_semi")
    attributes = left.groupBy(F.col("key").alias("offer_id")).agg(F.min(F.struct("title", "category")).alias("o")).select("offer_id", "o.*").join(text, "title", "left")
    shown = sent.withColumnRenamed("offer_id", "content").join(keys, "content").groupBy(F.col("key").alias("offer_id"), "char_name").agg(
        F.min("cat").alias("cat"), F.max("mandatory").alias("mandatory"), F.min("position").alias("position"), F.min("options").alias("options")
    )
    return Requests(staged(titles), staged(attributes), staged(display_names(shown)), staged(lead), staged(cached))


def _done_keys(asked: DataFrame, marketplace: str) -> DataFrame:
    """Keys of the done table: a request and one of the mandatory names it wants."""
    rows = asked.select(done_key("title", "category", F.lit(marketplace)).alias("request"), F.explode("mandatory").alias("char_name"))
    return rows.select(_done_key("request", "char_name").alias("key"))


def _done_key(request: str, name: str):
    return F.md5(F.concat_ws("|", request, name))


def answered(options: Options, offers: DataFrame, asked: Requests, titles: DataFrame | None, fields: DataFrame | None) -> Options:
    """The options with the usable answers of both ledgers and the cached values, by offer id."""
    suggestions = asked.cached
    if fields is not None:
        to_offers = asked.offers.select("offer_id", "key").distinct()
        said = field_answers(fields).withColumnRenamed("offer_id", "key").join(to_offers, "key").select(*suggestions.columns)
        suggestions = suggestions.unionByName(said)
    if options.suggestions is not None:
        suggestions = suggestions.unionByName(options.suggestions.select(*suggestions.columns))
    categories = options.category_suggestions
    if titles is not None:
        keys = offers.select("offer_id", title_key("title", F.lit(options.marketplace)).alias("key"))
        said = category_answers(titles).withColumnRenamed("offer_id", "key").join(keys, "key").select("offer_id", "suggested")
        categories = said if categories is None else categories.unionByName(said.join(categories.select("offer_id"), "offer_id", "left_anti"))
    return replace(options, suggestions=staged(suggestions), category_suggestions=categories)


def learn(
    learned: Learned, offers: DataFrame, results: DataFrame, asked: Requests, index: ReferenceIndex, titles: DataFrame | None, options: Options, run_id: str
) -> str:
    """Write what a finished run learned, all tables at once; returns the name of the change.

    Learned are categories a model named and the marketplace knows, keywords of their titles, suggested values that
    passed the gate (by request, and for products with ean or brand as knowledge) and the mandatory names they
    resolve. Offers whose id and title stand for several products teach nothing about products.
    """
    market = options.marketplace
    none = learned.spark.createDataFrame([], "title string, category string, ordinal bigint")
    accepted = none
    if titles is not None:
        said = titles.where("state = 'answered'").select("offer_id", "suggested")
        known = match_suggested_categories(said, index, options.fuzzy).where("category_name IS NOT NULL")
        named = said.join(known, "suggested").join(asked.titles.select("offer_id", "title"), "offer_id")
        # hash order stands for the order of replies, which has no meaning
        accepted = named.select("title", F.col("category_name").alias("category"), F.pmod(F.xxhash64("title"), F.lit(2**31)).alias("ordinal"))
    rules = learned_rules(accepted).withColumnRenamed("keywords", "key")

    said = F.map_filter("new_chars", lambda k, v: F.element_at("sources", k) == "suggestion")
    took = results.select("offer_id", "title", said.alias("said")).where(F.size("said") > 0)
    sent = asked.attributes.select(F.col("offer_id").alias("key"))
    took = took.join(asked.offers.join(sent, "key", "left_semi"), ["offer_id", "title"])
    named = staged(took.select("offer_id", "title", "category", "key", "missing", "mandatory", F.explode("said").alias("char_name", "value")))
    asked_for = named.where(F.array_contains("missing", F.col("char_name")))
    values = asked_for.groupBy("key", "char_name").agg(F.min("value").alias("value"))
    attributes = values.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("char_name", "value")))).alias("attributes"))
    resolved = named.where(F.array_contains("mandatory", F.col("char_name")))
    done = resolved.select(done_key("title", "category", F.lit(market)).alias("request"), "char_name").distinct()

    products = _products(offers, market).where("key IS NOT NULL").select("offer_id", "title", "ean", "brand", "normalized_title", F.col("key").alias("product")).distinct()
    only = products.groupBy("offer_id", "title").agg(F.count("*").alias("n"), F.first(F.struct("product", "ean", "brand", "normalized_title")).alias("p")).where("n = 1")
    whole = asked_for.groupBy("offer_id", "title", "category", "key").agg(
        F.count_distinct("char_name").alias("n_values"), F.max(F.size("missing")).alias("n_asked"),
        F.array_sort(F.collect_set(F.struct("char_name", "value"))).alias("pairs"),
    )
    stored = whole.join(only, ["offer_id", "title"]).select(
        F.col("p.product").alias("product"), F.nullif("p.ean", F.lit("")).alias("ean"), F.coalesce("p.brand", F.lit("")).alias("brand"), F.col("p.normalized_title").alias("normalized_title"),
        F.lit(market).alias("marketplace_id"), "offer_id", "category", "pairs", F.round(F.col("n_values") / F.greatest("n_asked", F.lit(1)), 2).alias("confidence"),
    )
    # of a product's offers the one that told most counts, then the smallest
    best = F.max_by(F.struct(*[c for c in stored.columns if c != "product"]), F.struct("confidence", F.col("pairs"), "category"))
    knowledge = stored.groupBy(F.col("product").alias("key")).agg(best.alias("_r")).select("key", "_r.*")
    first_of = lambda x: F.struct(x[0]["char_name"], x[0]["value"])
    by_name = F.transform(F.array_distinct(F.transform("pairs", lambda p: p["char_name"])), lambda n: first_of(F.filter("pairs", lambda p: p["char_name"] == n)))
    knowledge = knowledge.withColumn("final_attributes", F.map_from_entries(by_name)).withColumns({"run_id": F.lit(run_id), "updated_at": F.current_timestamp()})
    return learned.publish({
        "categories": category_cache_rows(accepted, market), "rules": rules, "attributes": attributes,
        "done": done.withColumn("key", _done_key("request", "char_name")), "knowledge": knowledge,
    })
