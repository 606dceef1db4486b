"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

Every source has a target in words: its weight's share of the whole mix, at most ``ceiling`` times
what it holds, the excess going to the others by weight. Targets become integer quotas of equal
blocks of ``block`` words: seats go to the highest quotients target / (2k + 1). A source's documents
are dealt by a seeded hash to shards of about ``per_shard`` documents, and the source's seats are
apportioned to its shards by their words in the same way. In a shard the documents stand in seeded
order, end to end, cut into blocks; the quota takes every block ``quota // blocks`` times and the
rest of it as a run of blocks from a seeded first one, wrapping round. So most documents are taken
whole, and a document's share follows from its place by arithmetic: no block is ever listed.

Defined results: null text has size 0; a null source is a source of its own, last in order; null ids
are dealt like an id; rows that repeat are separate documents; an empty table has an empty result.
Input columns named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offermend.llm.common import WORD, small, text_or_empty
from offermend.session import staged

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CEILING = 2
BLOCK = 16
PER_SHARD = 256
SEED = "mix-1"


def with_size(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("size", F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long"))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """(source, source_size, docs, target, ordinal) from (source, source_size, docs), one row per source.

    The level at which sum(min(ceiling * size, level * weight)) meets the budget is the largest of
    the levels that follow from capping the first k sources in order of size / weight.
    """
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("ordinal") % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("ordinal", F.row_number().over(order) - 1).withColumn("w", weight).withColumn("cap", (ceiling * F.col("source_size")).cast("double"))
    full_first = Window.orderBy(F.col("cap") / F.col("w"), "ordinal")
    before = F.coalesce(F.sum("cap").over(full_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    behind = F.sum("w").over(full_first.rowsBetween(0, Window.unboundedFollowing))
    levels = ranked.withColumn("level", (share * F.sum("source_size").over(everything).cast("double") - before) / behind)
    level = F.max("level").over(everything)
    return levels.withColumn("target", F.least("cap", level * F.col("w"))).select("source", "source_size", "docs", "target", "ordinal")


def apportion(parties: DataFrame, group: list[str], order: str, votes: str, seats: str, out: str) -> DataFrame:
    """The parties with ``out``, their integer seats: the group's seats go to the highest votes / (2k + 1).

    For any divisor d, ceil(votes / d - 1/2) counts a party's quotients above d / 2. The divisors
    total / (seats -+ parties / 2) bracket the seats to give, so at most two quotients per party are
    left to be ranked; ties go to the first in ``order``.
    """
    whole = Window.partitionBy(*group)
    n, total, m = F.count("*").over(whole), F.sum(votes).over(whole), F.col(seats)
    sure = F.when((m > n / 2) & (total > 0), F.greatest(F.lit(0), F.ceil(F.col(votes) * (m - n / 2) / total - 0.5))).otherwise(F.lit(0)).cast("long")
    most = F.when(total > 0, F.greatest(F.lit(0), F.ceil(F.col(votes) * (m + n / 2) / total - 0.5))).otherwise(F.lit(0)).cast("long")
    bracket = parties.withColumns({"__sure": sure, "__most": most}).withColumn("__open", m - F.sum("__sure").over(whole))
    tried = bracket.withColumn("__k", F.explode(F.sequence(F.col("__sure"), F.greatest("__sure", "__most"))))
    best = whole.orderBy((F.col(votes) / (2 * F.col("__k") + 1)).desc(), order, "__k")
    won = tried.withColumn("__won", ((F.row_number().over(best) <= F.col("__open")) & (F.col(votes) > 0)).cast("long"))
    keep = [c for c in parties.columns]
    return won.groupBy(*keep).agg((F.max("__sure") + F.sum("__won")).cast("long").alias(out))


def _hash(id_col: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))


def _number(digest: Column) -> Column:
    """An integer below 2**32 from a hex digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, block: int = BLOCK, per_shard: int = PER_SHARD,
        weights=WEIGHTS, share: float = SHARE, ceiling: int = CEILING, sized: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` with size, source_size, target, taken, and first and last word of the extra run.

    ``sized``: the same rows as a written table of id, source and size, if there is one, so that the
    texts are not read for the totals.
    """
    own = lambda frame: frame.withColumns({"__source": F.col(source), "__mix": _hash(id_col, seed)})
    rows = own(docs if "size" in docs.columns and sized is not None else with_size(docs, text))
    light = own(sized) if sized is not None else own(staged(with_size(docs, text).select(id_col, source, "size")))
    sources = light.groupBy("__source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")).withColumnRenamed("__source", "source")
    plan = targets(sources, weights, share, ceiling).withColumn("__seats", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long"))
    plan = staged(apportion(plan, [], "ordinal", "target", "__seats", "quota").withColumn("shards", F.ceil(F.col("docs") / per_shard).cast("long")))
    per_source = small(plan.select(F.col("source").alias("__s"), "source_size", "target", "quota", "shards", "ordinal"))
    shard = F.pmod(_number(F.col("__mix")), F.col("shards"))
    dealt = lambda frame: frame.join(per_source, F.col("__source").eqNullSafe(F.col("__s"))).withColumn("shard", shard).drop("__s")
    sums = dealt(light).groupBy("ordinal", "shard", "quota").agg(F.sum("size").cast("double").alias("words"))
    blocks = F.ceil(F.col("words") / block).cast("long")
    quotas = apportion(sums, ["ordinal"], "shard", "words", "quota", "seats").withColumn("blocks", blocks).withColumn("seats", F.least("seats", ceiling * F.col("blocks")))
    start = F.pmod(_number(F.md5(F.concat(F.lit(f"{seed}:"), F.col("ordinal"), F.lit(":"), F.col("shard")))), F.greatest("blocks", F.lit(1)))
    quotas = staged(quotas.select(F.col("ordinal").alias("__o"), F.col("shard").alias("__h"), "blocks", "seats", start.alias("first_block")))
    placed = dealt(rows.drop("source_size", "target", "taken", "quota", "shards", "ordinal", "shard", "copies", "run_from", "run_to", "wrap_to"))
    ties = [c for c in (text,) if c in placed.columns]
    order = Window.partitionBy("ordinal", "shard").orderBy("__mix", F.col(id_col).asc_nulls_last(), "size", *[F.xxhash64(c) for c in ties])
    placed = placed.withColumn("__end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__at", F.col("__end") - F.col("size"))
    placed = placed.join(quotas, (F.col("ordinal") == F.col("__o")) & (F.col("shard") == F.col("__h")))
    return _taken(placed, block).select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("size", *ADDED)], "size", *ADDED)


ADDED = ("source_size", "target", "taken", "copies", "run_from", "run_to", "wrap_to")


def _taken(placed: DataFrame, block: int) -> DataFrame:
    """copies: whole times; run_from..run_to and 0..wrap_to: words of the document that the shard's extra run takes once more."""
    copies = F.when(F.col("blocks") > 0, F.floor(F.col("seats") / F.col("blocks"))).otherwise(F.lit(0)).cast("long")
    extra = F.col("seats") - F.col("copies") * F.col("blocks")
    low, high = F.col("first_block") * block, (F.col("first_block") + F.col("__extra")) * block
    wrapped = high - F.col("blocks") * block
    inside = lambda x: F.greatest(F.lit(0), F.least(x - F.col("__at"), F.col("size"))).cast("long")
    run = placed.withColumn("copies", copies).withColumn("__extra", extra)
    run = run.withColumns({"run_from": inside(low), "run_to": inside(high), "wrap_to": inside(wrapped)})
    return run.withColumn("taken", F.col("copies") * F.col("size") + F.col("run_to") - F.col("run_from") + F.col("wrap_to"))


def realise(mixed: DataFrame, columns: list[str], text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The mix as documents: a row per whole copy, and one for a part if the extra run cuts the document.

    A part holds the words of the run joined by one space; a run that takes all words is a whole copy.
    """
    part = F.col("run_to") - F.col("run_from") + F.col("wrap_to")
    whole = F.col("copies") + (part == F.col("size")).cast("long")
    texts = F.array_repeat(F.col(text), whole.cast("int"))
    words = F.regexp_extract_all(text_or_empty(text), F.lit(f"({WORD})"), F.lit(1))
    cut = F.concat(F.slice(words, F.lit(1), F.col("wrap_to").cast("int")), F.slice(words, F.col("run_from").cast("int") + 1, (F.col("run_to") - F.col("run_from")).cast("int")))
    texts = F.when((part > 0) & (part < F.col("size")), F.concat(texts, F.array(F.array_join(cut, " ")))).otherwise(texts)
    out = mixed.where((F.col("size") > 0) & (F.col("taken") > 0)).withColumn("__text", F.explode(texts))
    value = {text: F.col("__text")} | ({n_chars: F.char_length("__text").cast(mixed.schema[n_chars].dataType)} if n_chars in columns else {})
    return out.select(*[value[c].alias(c) if c in value else F.col(f"`{c}`") for c in columns])
