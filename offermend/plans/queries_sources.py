"""Sources, stores and streams over the given tables: written to the shared folder, read back, compared whole.

Each query writes to a fresh folder under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from offermend import schemas
from offermend.operators import report
from offermend.plans.check_sql import with_views
from offermend.plans.fixtures import load, reference
from offermend.plans.import_marketplace import import_marketplace as run_import
from offermend.plans.registry import query
from offermend.plans.runs import fixture_offers, run_options, saved_run
from offermend.session import shared_folder
from offermend.sources import store as stores
from offermend.sources import tabular
from offermend.streaming import jobs


def _fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _through_file(spark, rows, kind: str = "csv"):
    """The rows written with a header and read as an unknown file."""
    path = f"{_fresh(spark, 'file')}.{kind}"
    rows.write.option("header", True).option("escape", '"').option("sep", "\t" if kind == "tsv" else ",").csv(path)
    return tabular.read_tabular(spark, path)


@query("SELECT doc_id::VARCHAR AS doc_id, md5(text) AS text FROM documents WHERE text IS NOT NULL")
def read_tabular(spark, sf_dir):
    """Whole documents as cells, with their quotes and line breaks, through a CSV file."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").select("doc_id", "text")
    return _through_file(spark, rows).select("doc_id", F.md5("text").alias("text"))


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name FROM part UNION ALL SELECT c_custkey::VARCHAR, c_name FROM customer")
def concat_same_schema(spark, sf_dir):
    """Two sheets with one header put together; one with another header and a query text are skipped."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    same = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("p_partkey"), F.col("c_name").alias("p_name"))
    other = part.select(F.col("p_name").alias("name"))
    sheets = [("a", part), ("sql", part.withColumnRenamed("p_partkey", "SELECT 1")), ("b", same), ("c", other)]
    return tabular.concat_same_schema([(n, _through_file(spark, f, "tsv")) for n, f in sheets]).rows


@query("SELECT c_custkey::VARCHAR AS category_id, 'x' || c_custkey AS external_id, c_name AS category_name, c_nationkey::VARCHAR AS parent_category_id FROM customer WHERE c_custkey % 5 <> 0")
def load_categories(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias(" CAT_ID"), F.concat(F.lit("x"), "c_custkey").alias("emag_id"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("Nume"), F.col("c_nationkey").alias("parent"),
    )
    return tabular.load_categories(_through_file(spark, rows)).drop("ordinal")


@query("""SELECT p_partkey::VARCHAR AS characteristic_id, p_partkey::VARCHAR AS external_characteristic_id, p_type AS category_id, p_name AS characteristic_name,
  p_size % 2 = 0 AS mandatory, true AS restrictive FROM part""")
def load_characteristics(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("char_id"), F.col("p_type").alias("cat_id"), F.col("p_name").alias("denumire"), F.when(F.col("p_size") % 2 == 0, "1").otherwise("0").alias("obligatoriu")
    )
    return tabular.load_characteristics(_through_file(spark, rows)).drop("ordinal")


@query("SELECT p_type AS category_id, p_partkey::VARCHAR AS characteristic_id, NULL::VARCHAR AS characteristic_name, p_brand AS value FROM part WHERE p_size > 3")
def load_values(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_type").alias("cat_id"), F.col("p_partkey").alias("characteristic_id"), F.when(F.col("p_size") > 3, F.col("p_brand")).alias("valoare")
    )
    return tabular.load_values(_through_file(spark, rows)).drop("ordinal")


@query(
    with_views("fx_offers") + """SELECT offer_id, title, error, nullif(category, '') AS category, ean, brand,
  CASE WHEN color IS NULL THEN '-' ELSE color END AS color, coalesce(size_value, '-') AS size FROM fx_offers"""
)
def read_offers(spark, sf_dir):
    """Offers through a file with numbered attribute columns, folded into a map."""
    rows = load(spark, sf_dir)["fx_offers"].select(
        F.col("offer_id").alias("id intern oferta"), F.col("title").alias("nume"), F.col("error").alias("eroare oferta"), F.col("category").alias("categorie"), "ean", "brand",
        F.lit("Color").alias("Offer ch. 1 name"), F.col("color").alias("Offer ch. 1 val."), F.lit(" Size ").alias("Offer ch. 2 name"), F.col("size_value").alias("Offer ch. 2 val."),
    )
    got = tabular.read_offers(_through_file(spark, rows))
    return got.select(
        "offer_id", "title", "error", "category", "ean", "brand", F.coalesce(F.col("existing_chars")["Color"], F.lit("-")).alias("color"),
        F.coalesce(F.col("existing_chars")["Size"], F.lit("-")).alias("size"),
    )


def _store(spark):
    return stores.Store(spark, _fresh(spark, "store"))


def _imported(spark, sf_dir, marketplace: str = "shop"):
    fx, _ = reference(spark, sf_dir)
    store = _store(spark)
    cats = fx["fx_categories"].withColumn("parent_category_id", F.lit(None).cast("string"))
    run_import(store, marketplace, cats, fx["fx_characteristics"], fx["fx_values"])
    return fx, store, cats


@query(
    with_views("fx_categories", "fx_characteristics", "fx_values")
    + "SELECT 'categories' AS what, external_id AS category_id, category_name AS name, '' AS value FROM fx_categories "
    "UNION ALL SELECT 'characteristics', category_id, characteristic_name, '' FROM fx_characteristics "
    "UNION ALL SELECT 'values', category_id, characteristic_name, value FROM fx_values"
)
def import_marketplace(spark, sf_dir):
    """An import published, repeated, and read back beside another marketplace's."""
    fx, store, cats = _imported(spark, sf_dir)
    run_import(store, "other", cats, fx["fx_characteristics"], fx["fx_values"].where("false"))
    run_import(store, "shop", cats, fx["fx_characteristics"], fx["fx_values"])
    got = store.load_marketplace("shop")
    return (
        got["categories"].select(F.lit("categories").alias("what"), F.col("external_id").alias("category_id"), F.col("category_name").alias("name"), F.lit("").alias("value"))
        .union(got["characteristics"].select(F.lit("characteristics"), "category_id", "characteristic_name", F.lit("")))
        .union(got["characteristic_values"].select(F.lit("values"), "category_id", "characteristic_name", "value"))
    )


@query(with_views("fx_categories") + "SELECT 'other' AS marketplace_id, count(*) AS categories FROM fx_categories")
def clear_marketplace(spark, sf_dir):
    """One of two marketplaces cleared: only the other can be read."""
    fx, store, cats = _imported(spark, sf_dir)
    run_import(store, "other", cats, fx["fx_characteristics"], fx["fx_values"])
    store.clear_marketplace("shop")
    left = [store.load_marketplace(m)["categories"].select("marketplace_id") for m in ("shop", "other")]
    return left[0].union(left[1]).groupBy("marketplace_id").agg(F.count("*").alias("categories"))


@query("SELECT n_name AS marketplace_name, true AS is_active FROM nation")
def upsert_marketplace(spark, sf_dir):
    """Registry rows under the nations' keys, each written twice: the newest name counts."""
    store = _store(spark)
    for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").collect():  # 25 registry entries
        for name in ("old", r["n_name"]):
            store.upsert_marketplace(str(r["n_nationkey"]), name)
    return store.marketplaces().select("marketplace_name", "is_active")


@query(
    "SELECT 'A' AS marketplace_name, true AS registered, count(*) AS categories FROM customer UNION ALL SELECT 'B', false, count(*) FROM customer"
)
def discover_marketplaces(spark, sf_dir):
    """Reference sets in folders: complete ones are found and read, one that lacks a table is not."""
    folder = _fresh(spark, "sets")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    for name in ("A", "B"):
        stores.write_reference_set({t: rows for t in ("categories", "characteristics", "values")}, f"{folder}/{name}")
    stores.write_reference_set({"categories": rows}, f"{folder}/C")
    registry = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.lit("A").alias("marketplace_name"))
    found = stores.discover_marketplaces(spark, folder, registry)
    sizes = None
    for name in ("A", "B"):
        one = stores.read_reference_set(spark, f"{folder}/{name}")["categories"].agg(F.count("*").alias("categories")).withColumn("marketplace_name", F.lit(name))
        sizes = one if sizes is None else sizes.unionByName(one)
    return found.join(sizes, "marketplace_name")


@query(with_views("fx_offers") + "SELECT offer_id, title FROM fx_offers")
def last_run(spark, sf_dir):
    """Two saved runs of one marketplace and one of another: the newest of the first."""
    store, results = _store(spark), saved_run(spark, sf_dir)
    store.save_run(results.where("needs_manual"), "shop", "r1")
    for _ in range(2):  # saved again, a run is replaced
        store.save_run(results, "shop", "r2")
    store.save_run(results.where("false"), "other", "r3")
    return store.last_run("shop").select("offer_id", "title")


@query(
    with_views("fx_offers") + "SELECT 'r1' AS run_id, offer_id FROM fx_offers WHERE split_part(error, ' ', 1) IN ('1007', '1009', '1010') "
)
def run_log(spark, sf_dir):
    """The log of a run under its day, listed and read back; days that are too old go."""
    store = _store(spark)
    store.write_run_log(report.run_log_rows(saved_run(spark, sf_dir), run_options().codes), "r1")
    store.write_run_log(report.run_log_rows(saved_run(spark, sf_dir).where("needs_manual"), run_options().codes), "r2")
    store.expire("run_logs", 7)
    return store.list_logs().where("run_id = 'r1'").select("run_id").join(store.read_log("r1", schemas.RUN_LOG).select("run_id", "offer_id"), "run_id")


@query(
    "SELECT what, n AS source, n - d AS target, ok FROM (SELECT 'categories' AS what, count(*) AS n, 0 AS d, true AS ok FROM customer "
    "UNION ALL SELECT 'values', count(*), count(*) FILTER (WHERE o_orderkey % 50 = 0), true FROM orders "
    "UNION ALL SELECT 'characteristics', count(*), count(*) FILTER (WHERE p_partkey % 2 = 0), true FROM part)"
)
def reconcile_counts(spark, sf_dir):
    def counts(lose: bool):
        parts = None
        for what, table, gone in (("categories", "customer", "false"), ("values", "orders", "o_orderkey % 50 = 0"), ("characteristics", "part", "p_partkey % 2 = 0")):
            rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            one = (rows.where(f"NOT ({gone})") if lose else rows).agg(F.count("*").alias("n")).withColumn("what", F.lit(what))
            parts = one if parts is None else parts.unionByName(one)
        return parts

    return stores.reconcile_counts(counts(False), counts(True))


@query("SELECT event_type, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1")
def log_stream(spark, sf_dir):
    """Events appended by a stream under their day; a second start finds nothing new."""
    folder = _fresh(spark, "events")
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(f"{folder}/in")
    schema = "event_id long, ts timestamp, event_type string"
    for _ in range(2):
        jobs.log_stream(jobs.offer_stream(spark, f"{folder}/in", schema), f"{folder}/out", f"{folder}/mark").awaitTermination()
    rows = spark.read.schema(schema + ", day date").json(f"{folder}/out")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("day").alias("days"))


@query(with_views("fx_offers") + "SELECT offer_id, title FROM fx_offers")
def process_offers_stream(spark, sf_dir):
    """Offers repaired as they arrive: every offer once, also when the stream is started again."""
    fx, index = reference(spark, sf_dir)
    folder = _fresh(spark, "offers")
    fixture_offers(fx).write.parquet(f"{folder}/in")
    schema = fixture_offers(fx).schema
    for _ in range(2):
        jobs.process_offers_stream(jobs.offer_stream(spark, f"{folder}/in", schema), index, f"{folder}/out", f"{folder}/mark", run_options()).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("offer_id", "title")
