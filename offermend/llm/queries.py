"""The registered query of each operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offermend.llm import chat, collocations, conversation, embedding_join, exact_dedup, language, line_dedup, mixing, packing, secrets, simhash, substring_dedup, url_filter
from offermend.llm.oracle import COLLOCATIONS, EXACT_DEDUP, LINE_DEDUP, MIXING, URL_FILTER


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_read(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"  # the contract's conversation of control strings
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.segments(turns.union(extra)))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.classes(_read(spark, sf_dir, "embeddings"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(_read(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_on", F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("page_id") % 366).cast("int")))
    return url_filter.evaluate(captures, url_filter.changes_of(pages)).drop("url")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(~language.held_out()))
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "languages")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_layers", "n_large")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.staged(mixing.with_size(_read(spark, sf_dir, "documents")).select("doc_id", "source", "size"))
    return mixing.mix(sized, sized=sized).select("doc_id", "size", "source_size", "target", "taken")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(_read(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.report(conversation.damage(_read(spark, sf_dir, "conversations"))).withColumnRenamed("c", "conv_id")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


_ALL = (
    op1_best_fit_packing, op2_substring_dedup, op3_chat_format, op4_embedding_near_dedup, op5_simhash, op6_url_filter, op7_language_id,
    op8_secret_scan, op9_mixing, op10_exact_dedup, op11_line_dedup, op12_conversation_repair, op13_collocations,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE = {"op6_url_filter": URL_FILTER, "op9_mixing": MIXING, "op10_exact_dedup": EXACT_DEDUP, "op11_line_dedup": LINE_DEDUP, "op13_collocations": COLLOCATIONS}
