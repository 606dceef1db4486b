"""Exact dedup with a heavy-hitter split, in DataFrame operations only.

Texts are equal when nothing but ASCII white space differs. A first pass writes each row's digest,
length and id. The Misra-Gries counters of ``freqItems`` then name every digest that may hold more
than ``support`` of all rows (at most ``1 / support`` of them); an exact count verifies them and
picks their winners. That table, bounded by the number of counters, is broadcast: rows that lose
against a winner are settled in the map task and never shuffled. All others meet in an ordinary
shuffle by digest, where no group can hold more than ``support`` of the rows.

Defined results: null text counts as empty; empty texts are equal to each other; a null id loses
against any other; of rows that share id and length one stays; a row that repeats counts as a copy;
an empty table gives no rows; texts of any length are digested whole.
Columns named ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` in the input are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offermend.llm.common import SPACE, text_or_empty
from offermend.session import staged

#: Share of the rows from which a digest is sure to be found by the counters; 1 / SUPPORT counters.
SUPPORT = 0.001

RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def with_digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``__digest`` (of the text without white space) and ``__points`` (code points of the text)."""
    return docs.withColumns({"__digest": F.unhex(F.sha2(F.regexp_replace(text_or_empty(text), SPACE, ""), 256)), "__points": F.char_length(text_or_empty(text))})


def winners(keys: DataFrame, id_col: str = "doc_id", support: float = SUPPORT) -> DataFrame:
    """(__digest, __keep, __longest, __copies) of digests that the counters name and that do repeat."""
    named = keys.select(F.hex("__digest").alias("d")).freqItems(["d"], support).select(F.explode("d_freqItems").alias("d")).select(F.unhex("d").alias("__digest"))
    best = F.min(F.struct((-F.col("__points")).alias("p"), F.col(id_col).isNull().alias("n"), F.col(id_col).alias("id"))).alias("b")
    exact = keys.join(F.broadcast(named), "__digest").groupBy("__digest").agg(best, F.count("*").alias("__copies")).where("__copies > 1")
    return staged(exact.select("__digest", F.col("b.id").alias("__keep"), (-F.col("b.p")).alias("__longest"), "__copies"))


def _split(digested: DataFrame, hot: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows that go on to the shuffle, and rows that a broadcast winner beats."""
    marked = digested.join(F.broadcast(hot), "__digest", "left")
    beaten = F.col("__copies").isNotNull() & ~(F.col(id_col).eqNullSafe(F.col("__keep")) & (F.col("__points") == F.col("__longest")))
    return marked.where(~beaten), marked.where(beaten)


def _ranked(rows: DataFrame, id_col: str) -> DataFrame:
    group = Window.partitionBy("__digest")
    order = group.orderBy(F.col("__points").desc(), F.col(id_col).asc_nulls_last())
    return rows.withColumns({"__place": F.row_number().over(order), "keep_id": F.first(id_col).over(order), "group_size": F.coalesce("__copies", F.count("*").over(group))})


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256. The texts are read once."""
    keys = staged(with_digest(docs, text).select(id_col, "__digest", "__points"))
    rest, beaten = _split(keys, winners(keys, id_col, support), id_col)
    digest = F.lower(F.hex("__digest")).alias("text_sha256")
    ranked = _ranked(rest, id_col).select(id_col, "keep_id", F.col("group_size").cast("long"), (F.col("__place") == 1).alias("kept"), digest)
    lost = beaten.select(id_col, F.col("__keep").alias("keep_id"), F.col("__copies").alias("group_size"), F.lit(False).alias("kept"), digest)
    return ranked.union(lost)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows that stay, with their columns as they were."""
    digested = with_digest(docs, text)
    hot = winners(staged(digested.select(id_col, "__digest", "__points")), id_col, support)
    rest, _ = _split(digested, hot, id_col)
    order = Window.partitionBy("__digest").orderBy(F.col("__points").desc(), F.col(id_col).asc_nulls_last())
    return rest.withColumn("__place", F.row_number().over(order)).where("__place = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
