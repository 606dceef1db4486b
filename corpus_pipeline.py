"""From raw documents to packed training sequences, a stage at a time.

Each stage takes (spark, docs, sf_dir) and is written as Parquet before the next one reads it. All but the
last return the columns of their input. The last returns the pieces with their places and ids:
``packing.sequences`` of it puts every full sequence together, of any stored copy of the result.

Defined results: a null or empty text, and one without a letter, goes in the first stage; null ids and
null sources pass (a null source is a source of its own, a null id loses against any other where one of
several documents stays); rows that repeat are exact copies; of equal fingerprints' groups the smallest id
stays; texts of any length are read whole, the last stage cuts them into pieces; an empty table gives an
empty result; columns called like an operator's results are set aside and come back under their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offermend.llm import exact_dedup, language, mixing, packing, simhash
from offermend.session import shared_folder


def _aside(docs: DataFrame, added: tuple[str, ...]) -> dict[str, str]:
    """Names for the documents' own columns that an operator's results would replace."""
    return {c: f"__own_{c}" for c in added if c in docs.columns}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or null go; so do those of which no language makes up half."""
    own = _aside(docs, ("lang_pred", "score", "languages"))
    named = language.predict(docs.withColumnsRenamed(own), language.train(docs))
    kept = named.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= 0.5)).drop("lang_pred", "score", "languages")
    return kept.withColumnsRenamed({v: k for k, v in own.items()})


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each whole copy the mix takes, and one for a part of a document at the edge of a run."""
    own = _aside(docs, ("size", "shards", "shard", "quota", "ordinal", *mixing.ADDED))
    renamed = docs.withColumnsRenamed(own)
    return mixing.realise(mixing.mix(renamed), renamed.columns).withColumnsRenamed({v: k for k, v in own.items()})


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids as unsigned 16-bit integers, which hold the tokenizer's."""
    return packing.pack(docs, with_ids=True, width=2)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express the language model, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
