"""Queries over the text functions, on whole documents, pages and part names."""

from __future__ import annotations

from pyspark.sql import functions as F

from offermend.functions import text as T
from offermend.functions.html import strip_html as visible
from offermend.operators import context
from offermend.plans.check_sql import lit
from offermend.plans.registry import query

DOC = "SELECT doc_id, md5({}) AS key FROM documents"
_BARE = "strip_accents(text)"
_WS = "'[\\s\\x1c-\\x1f]+'"


def _docs(spark, sf_dir, key):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(key).alias("key"))


@query(DOC.format(f"trim(lower({_BARE}), E' \\n\\t\\r')"))
def norm_text(spark, sf_dir):
    return _docs(spark, sf_dir, T.norm_text("text"))


@query(DOC.format(f"trim(lower(rtrim(trim(regexp_replace(strip_accents(replace(text, 'ß', 'ss')), '\\s+', ' ', 'g')), ':')))"))
def norm_char_name(spark, sf_dir):
    return _docs(spark, sf_dir, T.norm_char_name("text"))


@query(
    DOC.format(
        f"trim(regexp_replace(regexp_replace(regexp_replace(lower({_BARE}), '[-/_.,;:]+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"
    )
)
def norm_color(spark, sf_dir):
    return _docs(spark, sf_dir, T.norm_color("text"))


@query(DOC.format(f"trim(regexp_replace(regexp_replace(lower({_BARE}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"))
def norm_title(spark, sf_dir):
    return _docs(spark, sf_dir, T.norm_title("text"))


@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 0 THEN NULL WHEN l_linenumber % 4 = 1 THEN l_returnflag || l_orderkey "
    "ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) END AS id FROM lineitem"
)
def norm_id(spark, sf_dir):
    """Prices as numeric identifiers, flags as text ones, blanks as missing."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = F.col("l_linenumber") % 4
    raw = F.when(n == 0, F.lit(" nan ")).when(n == 1, F.concat(F.lit(" "), "l_returnflag", "l_orderkey")).otherwise(F.format_string("%.2f", "l_extendedprice"))
    return rows.select("l_orderkey", "l_linenumber", T.norm_id(raw).alias("id"))


@query("SELECT page_id, CASE WHEN trim(s, '_') = '' THEN 'marketplace' ELSE trim(s, '_') END AS slug FROM (SELECT page_id, regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g') AS s FROM pages)")
def slug(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.slug("url").alias("slug"))


@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS key FROM pages")
def strip_tags(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.md5(T.strip_tags("html")).alias("key"))


@query()
def strip_html(spark, sf_dir):
    """Visible text of every page."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", visible("html").alias("text"))


@query("SELECT o_orderkey, nullif(regexp_extract(o_orderpriority, '^([0-9]+)', 1), '') AS code FROM orders")
def error_code(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", T.error_code("o_orderpriority").alias("code"))


@query(
    "SELECT p_partkey, CAST(p_size AS VARCHAR) AS size, concat(regexp_replace(regexp_replace(printf('%.2f', p_retailprice / 10), '0+$', ''), '\\.$', ''), ' EU') AS formatted "
    "FROM part WHERE p_retailprice / 10 BETWEEN 1 AND 200"
)
def size_forms(spark, sf_dir):
    """The size a title ends with, and prices over ten written as sizes with a decimal comma."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    title = F.concat("p_name", F.lit(" - x - "), F.col("p_size").cast("string"))
    number = F.replace(F.format_string("%.2f", F.col("p_retailprice") / 10), F.lit("."), F.lit(","))
    return parts.where((F.col("p_retailprice") / 10).between(1, 200)).select(
        "p_partkey", T.size_from_title(title).alias("size"), T.size_format(number).alias("formatted")
    )


@query("SELECT doc_id, contains(concat(' ', array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), ' '), ' '), ' the ') AS hit FROM documents")
def word_match(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.word_match("text", "the").alias("hit"))


@query(
    "SELECT p_partkey, md5('shop|' || lower(trim(p_name))) AS title_key, md5('done|shop|' || lower(trim(p_name)) || '|' || p_type) AS done_key, "
    "md5('shop|' || lower(trim(p_name)) || '|' || p_type || '|Color,Size') AS request_key, md5(p_brand) AS url_key, "
    "substr(md5('shop|' || lower(p_brand)), 1, 12) AS checkpoint_key FROM part"
)
def keys(spark, sf_dir):
    shop = F.lit("shop")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        "p_partkey", T.title_key("p_name", shop).alias("title_key"), T.done_key("p_name", "p_type", shop).alias("done_key"),
        T.char_request_key("p_name", "p_type", shop, F.array(F.lit("Size"), F.lit("Color"))).alias("request_key"),
        T.url_key("p_brand").alias("url_key"), T.checkpoint_key(F.lit(" Shop "), "p_brand").alias("checkpoint_key"),
    )


@query("SELECT doc_id, md5(replace(replace(replace(text, chr(10), ' '), chr(13), ' '), '\"', '\\\"')) AS key FROM documents")
def sanitize(spark, sf_dir):
    return _docs(spark, sf_dir, T.sanitize("text"))


@query(
    "SELECT page_id, CASE WHEN regexp_extract(url, '^([a-z]+):', 1) NOT IN ('http', 'https') THEN 'scheme' "
    "WHEN regexp_extract(url, '^[a-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1) = '' THEN 'host' "
    "WHEN regexp_matches(url, '^[a-z]+://(10|127)\\.\\d+\\.\\d+\\.\\d+|^[a-z]+://192\\.168\\.\\d+\\.\\d+|^[a-z]+://localhost') THEN 'private' END AS reason FROM pages"
)
def url_guard(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.url_guard("url").alias("reason"))


@query(
    "SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(p_name, ' '), lambda w: length(w) > 3)[1:5], lambda w: lower(w)), ', ') AS keywords FROM part"
)
def learn_keywords(spark, sf_dir):
    from offermend.operators.detect import learn_keywords as learn

    title = F.concat("p_name", F.lit(" "), "p_brand", F.lit(" EU42 - "), F.col("p_size").cast("string"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", learn(F.replace(title, F.lit("Brand#"), F.lit(""))).alias("keywords"))


_MARKETS = ["eMAG HU", "eMAG Romania", "Allegro", "FashionDays BG", "Trendyol GR"]
_CASE = " ".join(f"WHEN {i} THEN {lit(m)}" for i, m in enumerate(_MARKETS))
_MARKET = f"concat(CASE user_id % 5 {_CASE} END, ' shop ', user_id)"


def _markets(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr(_MARKET).alias("marketplace"))


@query(
    f"SELECT DISTINCT {_MARKET} AS marketplace, CASE user_id % 5 WHEN 0 THEN 'hu' WHEN 1 THEN 'ro' WHEN 2 THEN 'pl' WHEN 3 THEN 'bg' ELSE 'tr' END AS language FROM events"
)
def locale(spark, sf_dir):
    return context.locale(_markets(spark, sf_dir), context.locale_table(spark))


@query(
    f"SELECT DISTINCT {_MARKET} AS marketplace, CASE user_id % 5 WHEN 0 THEN 'eMAG Magyarország (Ungaria). Valorile caracteristicilor trebuie sa fie in limba maghiara.' "
    "WHEN 1 THEN 'eMAG Romania. Valorile caracteristicilor trebuie sa fie in limba romana.' WHEN 2 THEN 'Allegro (Polonia). Categoriile si valorile sunt in poloneza.' "
    "WHEN 3 THEN 'eMAG България (Bulgaria). Valorile caracteristicilor trebuie sa fie in limba bulgara.' ELSE 'Trendyol.' END AS context FROM events"
)
def marketplace_context(spark, sf_dir):
    return context.marketplace_context(_markets(spark, sf_dir))
