"""Queries over replies joined back to what was asked, and over what runs learned."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from offermend.functions.text import title_key
from offermend.operators import ledger, suggest
from offermend.plans.check_sql import with_views
from offermend.plans.fixtures import load
from offermend.plans.queries_suggest import ALL, LISTS, _fields
from offermend.plans.registry import query
from offermend.session import shared_folder
from offermend.sources.learned import Learned


def _reply(line, text):
    """A batch's reply: an object of line numbers and texts."""
    pairs = F.map_from_entries(F.collect_list(F.struct(line.cast("string"), text)))
    return F.to_json(pairs)


def _at():
    return F.lit("2026-01-01").cast("timestamp")



@query(
    with_views("fx_offers") + """SELECT offer_id, CASE WHEN ordinal % 5 = 0 OR trim(category) = '' THEN 'missing' ELSE 'answered' END AS state,
  CASE WHEN ordinal % 5 = 0 OR trim(category) = '' THEN NULL ELSE trim(category) END AS suggested FROM fx_offers"""
)
def category_ledger(spark, sf_dir):
    """Each batch's reply names the category of its offers but of every fifth, which it leaves out."""
    sent = suggest.batches(load(spark, sf_dir)["fx_offers"].select("offer_id", "ordinal", "category"))
    told = sent.where("ordinal % 5 <> 0").groupBy("batch").agg(_reply(F.col("line"), F.col("category")).alias("reply"))
    replies = told.withColumn("replied_at", _at())
    return ledger.category_ledger(sent.select("batch", "line", "offer_id"), replies).select("offer_id", "state", "suggested")


@query(
    with_views("fx_offers") + """, t AS (SELECT count(*) AS c FROM fx_offers)
SELECT b AS batch, CASE b % 4 WHEN 0 THEN 'answered' WHEN 1 THEN 'timed_out' WHEN 2 THEN 'late' ELSE 'sent' END AS state, CAST(least(60, c - b * 60) AS BIGINT) AS n
FROM t, unnest(range(0, (c + 59) // 60)) AS u(b)"""
)
def category_ledger_states(spark, sf_dir):
    """Of four batches one is answered, one given up, one answered after it was given up, one open."""
    sent = suggest.batches(load(spark, sf_dir)["fx_offers"].select("offer_id")).select("batch", "line", "offer_id")
    told = sent.where("batch % 4 IN (0, 2)").groupBy("batch").agg(_reply(F.col("line"), F.lit("x")).alias("reply")).select(
        "batch", "reply", F.when(F.col("batch") % 4 == 2, _at() + F.expr("INTERVAL 1 HOUR")).otherwise(_at()).alias("replied_at"), F.lit(False).alias("timed_out")
    )
    given_up = sent.where("batch % 4 IN (1, 2)").select("batch").distinct().select("batch", F.lit(None).cast("string").alias("reply"), _at().alias("replied_at"), F.lit(True).alias("timed_out"))
    return ledger.ledger_summary(ledger.category_ledger(sent, told.unionByName(given_up)), "batch")


@query(
    ALL + LISTS + """SELECT offer_id, char_name AS char_input, CASE WHEN char_name = 'Sezon:' THEN NULL ELSE concat('v', n) END AS value_input,
  CASE WHEN char_name = 'Sezon:' THEN 'missing' ELSE 'answered' END AS state FROM options
UNION ALL SELECT DISTINCT offer_id, 'Extra', 'x', 'unasked' FROM options"""
)
def field_ledger(spark, sf_dir):
    """Replies name the attributes as shown, without colons; they leave one out and add one."""
    index, _, fields = _fields(spark, sf_dir)
    sizes = index.values.groupBy("cat", "char_name").agg(F.count("*").alias("n_values"))
    shown = suggest.display_names(fields)
    pairs = shown.where("char_name <> 'Sezon:'").join(sizes, ["cat", "char_name"]).select("offer_id", "display", F.concat(F.lit("v"), "n_values").alias("v"))
    pairs = pairs.unionByName(shown.select("offer_id", F.lit("Extra").alias("display"), F.lit("x").alias("v")).distinct())
    replies = pairs.groupBy("offer_id").agg(_reply(F.col("display"), F.col("v")).alias("reply")).withColumn("replied_at", _at())
    return ledger.field_ledger(shown, replies).select("offer_id", "char_input", "value_input", "state")


def _learned(spark, sf_dir):
    """Categories learned in three runs, of which the first two are folded into a snapshot."""
    offers = load(spark, sf_dir)["fx_offers"].where("category <> ''")
    store = Learned(spark, f"{shared_folder(spark)}/learned-{uuid.uuid4().hex}", buckets=8)
    for run in range(3):
        rows = offers.where(F.col("ordinal") % 3 == run).groupBy(title_key("title", F.lit("shop")).alias("key")).agg(F.min("category").alias("category"))
        store.publish({"categories": rows})
        if run == 1:
            store.compact()
    return offers, store


RUNS = """, r AS (SELECT md5(concat('shop|', lower(trim(title)))) AS key, ordinal % 3 AS run, min(category) AS category FROM fx_offers WHERE category <> '' GROUP BY 1, 2),
l AS (SELECT key, arg_max(category, run) AS category, max(run) AS run FROM r GROUP BY 1)
"""


@query(with_views("fx_offers") + RUNS + "SELECT key, category FROM l")
def learned_categories(spark, sf_dir):
    return _learned(spark, sf_dir)[1].read("categories").select("key", "category")


@query(with_views("fx_offers") + RUNS + "SELECT o.offer_id, l.category AS learned FROM fx_offers o JOIN l ON l.key = md5(concat('shop|', lower(trim(o.title)))) WHERE o.category <> ''")
def learned_lookup(spark, sf_dir):
    """What is known of every offer's title, found by key."""
    offers, store = _learned(spark, sf_dir)
    keys = offers.select("offer_id", title_key("title", F.lit("shop")).alias("key"))
    return keys.join(store.lookup("categories", keys), "key").select("offer_id", F.col("category").alias("learned"))
