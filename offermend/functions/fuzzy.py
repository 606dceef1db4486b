"""String similarity and the two ways to search with it.

``closest`` finds the best partner above a cut-off through an index of segments: the cut-off bounds
the edits between two strings of given lengths, so of one more segments than edits one is left whole.
``rank_candidates`` returns the k best of a whole list by max-score pruning: an inverted index of rare
tokens gives every query a score that its k best reach at least, then chunks of queries meet chunks of
values, an upper bound of every score is worked out from token incidence, lengths and characters in a
few array operations, and only pairs whose bound can still enter the k best are scored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from offermend.functions import ship_by_value
from offermend.session import staged

ship_by_value(__name__)

# ---------------------------------------------------------------- pair scores


def sequence_ratio(candidate: str, query: str) -> float:
    return SequenceMatcher(None, candidate, query).ratio()


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit per character of ``a``."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hits = row & where.get(ch, 0)
        row = (row + hits | row - hits) & full
    return len(a) - row.bit_count()


def token_set_ratio(a: str, b: str) -> float:
    """Published token-set ratio (0..1) on the insert/delete distance."""
    ta, tb = set(a.split()), set(b.split())
    if not ta or not tb:
        return 0.0
    both = ta & tb
    if both and (ta == both or tb == both):
        return 1.0
    only_a, only_b = " ".join(sorted(ta - tb)), " ".join(sorted(tb - ta))
    shared = len(" ".join(sorted(both)))
    gap = 1 if shared else 0
    len_a, len_b = shared + gap + len(only_a), shared + gap + len(only_b)
    distance = len(only_a) + len(only_b) - 2 * common_subsequence(only_a, only_b)
    best = 1 - distance / (len_a + len_b)
    if shared:
        best = max(best, 1 - (len_a - shared) / (shared + len_a), 1 - (len_b - shared) / (shared + len_b))
    return best


def jaccard(a: str, b: str) -> float:
    ta, tb = set(a.split()), set(b.split())
    return len(ta & tb) / len(ta | tb) if ta and tb else 0.0


def token_score(query: str, candidate: str) -> float:
    """0.75 token-set ratio + 0.25 token overlap, six decimals."""
    return round(0.75 * token_set_ratio(query, candidate) + 0.25 * jaccard(query, candidate), 6)


@F.pandas_udf(T.DoubleType())
def sequence_ratio_udf(candidate: pd.Series, query: pd.Series) -> pd.Series:
    return pd.Series([sequence_ratio(c, q) for c, q in zip(candidate, query)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def token_score_udf(query: pd.Series, candidate: pd.Series) -> pd.Series:
    return pd.Series([token_score(q, c) for q, c in zip(query, candidate)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def token_set_ratio_udf(query: pd.Series, candidate: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(q, c) for q, c in zip(query, candidate)], dtype="float64")


def token_overlap(a: Column, b: Column) -> Column:
    """Token overlap of two normalised texts, in the JVM."""

    def tokens(c: Column) -> Column:
        return F.array_distinct(F.filter(F.split(c, " "), lambda t: t != ""))

    ta, tb = tokens(a), tokens(b)
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb))
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays; 0 when one is a zero vector."""

    def dot(x: Column, y: Column) -> Column:
        parts = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p)

    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def hybrid_score(semantic: Column, fuzzy: Column, overlap: Column) -> Column:
    return F.round(0.65 * semantic + 0.25 * fuzzy + 0.10 * overlap, 6)


# ---------------------------------------------------------------- best partner above a cut-off

#: Rows of one segment key that meet in one place; a heavier key is split by salt.
HEAVY = 2000


def most_edits(n: int, m: int, cutoff: float) -> int:
    """Most characters that strings of these lengths may leave unmatched at the cut-off; -1 if none reach it.

    The ratio is twice the matched characters over both lengths, and matched characters are a common
    subsequence, so the unmatched ones are the insertions and deletions of an alignment.
    """
    free = math.floor((1 - cutoff) * (n + m) + 1e-9)
    if free < abs(n - m):
        return -1
    return free - (free - abs(n - m)) % 2  # each unmatched character on one side changes the difference by one


def _cuts(m: int, parts: int) -> list[tuple[int, int]]:
    """A length in so many segments of nearly equal length."""
    edges = [m * i // parts for i in range(parts + 1)]
    return list(zip(edges[:-1], edges[1:]))


def _partner_lengths(n: int, cutoff: float) -> range:
    low = math.ceil(n * cutoff / (2 - cutoff) - 1e-9)
    return range(max(low, 0), math.floor(n * (2 - cutoff) / cutoff + 1e-9) + 1)


def segment_keys(candidate: str, cutoff: float) -> list[str]:
    """Keys of a listed string: for every length a partner may have, its segments in their places."""
    m, out = len(candidate), []
    for n in _partner_lengths(m, cutoff):
        edits = most_edits(n, m, cutoff)
        if edits >= 0:
            out += [f"{n}.{m}.{i}.{candidate[a:b]}" for i, (a, b) in enumerate(_cuts(m, edits + 1))]
    return out


def probe_keys(query: str, cutoff: float) -> list[str]:
    """Keys one of which any listed string within the cut-off has: pieces that stand where the edits allow."""
    n, out = len(query), []
    for m in _partner_lengths(n, cutoff):
        edits = most_edits(n, m, cutoff)
        if edits < 0:
            continue
        # a segment moves by what is edited before it, and the rest must make up the difference of lengths
        spare = (edits - abs(n - m)) // 2
        moves = range(min(0, n - m) - spare, max(0, n - m) + spare + 1)
        for i, (a, b) in enumerate(_cuts(m, edits + 1)):
            found = {query[a + d:b + d] for d in moves if a + d >= 0 and b + d <= n}
            out += [f"{n}.{m}.{i}.{piece}" for piece in sorted(found)]
    return out


def _keys_udf(keys, cutoff: float):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def made(text: pd.Series) -> pd.Series:
        return text.map(lambda t: keys(t, cutoff))

    return made


def closest(
    queries: DataFrame,
    candidates: DataFrame,
    group: list[str],
    query: str,
    candidate: str,
    cutoff: float,
) -> DataFrame:
    """For each (group, query) the candidate of the same group with the highest sequence ratio
    at or above the cut-off; ties go to the greater string. Columns: group, query, candidate, ratio.

    Nulls have no partner. Candidates of a key beyond ``HEAVY`` rows are dealt to salted parts of it,
    and queries that ask for the key go to each part.
    """
    left = (
        queries.select(*group, query).where(F.col(query).isNotNull()).distinct()
        .withColumn("_key", F.explode(_keys_udf(probe_keys, cutoff)(query)))
    )
    right = (
        candidates.select(*group, candidate).where(F.col(candidate).isNotNull()).distinct()
        .withColumn("_key", F.explode(_keys_udf(segment_keys, cutoff)(candidate)))
    )
    heavy = right.groupBy(*group, "_key").agg(F.ceil(F.count("*") / HEAVY).alias("_parts")).where("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1))
    left = left.join(heavy, [*group, "_key"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    right = right.join(heavy, [*group, "_key"], "left").withColumn("_part", F.pmod(F.xxhash64(candidate), parts)).drop("_parts")
    pairs = left.join(right, [*group, "_key", "_part"]).select(*group, query, candidate).distinct()
    return (
        pairs.withColumn("ratio", sequence_ratio_udf(candidate, query))
        .where(F.col("ratio") >= cutoff)
        .groupBy(*group, query)
        .agg(F.max(F.struct("ratio", candidate)).alias("_best"))
        .select(*group, query, f"_best.{candidate}", "_best.ratio")
    )


# ---------------------------------------------------------------- k best of a list

#: Queries and values of one block.
QUERY_CHUNK, VALUE_CHUNK = 256, 1024
#: A token of at most so many values of a list is rare enough to start from, and so many of a query's are used.
RARE, STARTS = 300, 3
#: Characters are counted in so many classes.
CLASSES = 32
#: Above any rounding of a score.
SLACK = 2e-6


class _Texts:
    """Normalised texts of one side of a block: token sets, lengths, and characters by class."""

    def __init__(self, texts: list[str], numbers: dict[str, int]):
        self.tokens = [sorted(set(t.split())) for t in texts]
        self.of = [[numbers.setdefault(t, len(numbers)) for t in tokens] for tokens in self.tokens]
        self.n = np.array([len(t) for t in self.tokens], np.float32)
        self.chars = np.array([sum(map(len, t)) for t in self.tokens], np.float32)
        self.bag = np.zeros((CLASSES, len(texts)), np.float32)
        for i, tokens in enumerate(self.tokens):
            for ch, k in Counter(" ".join(tokens)).items():
                self.bag[ord(ch) % CLASSES, i] += k

    def incidence(self, width: int) -> np.ndarray:
        out = np.zeros((len(self.of), width), np.float32)
        for i, row in enumerate(self.of):
            out[i, row] = 1
        return out


def score_bounds(queries: list[str], values: list[str]) -> np.ndarray:
    """An upper bound of ``token_score`` for every pair; only the common subsequence in it is estimated."""
    numbers: dict[str, int] = {}
    q = _Texts(queries, numbers)
    own = len(numbers)  # a token that no query has is shared by none
    v = _Texts(values, numbers)
    v.of = [[t for t in row if t < own] for row in v.of]
    lengths = np.array([len(t) for t in numbers][:own], np.float32)
    a, b = q.incidence(own), v.incidence(own)
    both, chars = a @ b.T, a @ (b * lengths).T
    n, m = q.n[:, None], v.n[None, :]
    overlap = both / np.maximum(n + m - both, 1)
    shared = np.where(both > 0, chars + both - 1, 0)
    gap = both > 0
    rest_q = np.maximum(q.chars[:, None] - chars + (n - both) - 1, 0)
    rest_v = np.maximum(v.chars[None, :] - chars + (m - both) - 1, 0)
    common = np.minimum(rest_q, rest_v)
    bags = np.zeros_like(common)
    for i in range(CLASSES):
        if q.bag[i].any() and v.bag[i].any():
            bags += np.minimum(q.bag[i][:, None], v.bag[i][None, :])
    # what is not shared has in common, class by class, what the whole texts have less the shared tokens
    common = np.minimum(common, np.maximum(bags - chars - both, 0))
    len_q, len_v = shared + gap + rest_q, shared + gap + rest_v
    best = 1 - (rest_q + rest_v - 2 * common) / np.maximum(len_q + len_v, 1)
    for length in (len_q, len_v):
        best = np.where(gap, np.maximum(best, 1 - (length - shared) / np.maximum(shared + length, 1)), best)
    best = np.where(gap & ((both == n) | (both == m)), 1.0, best)
    bound = 0.75 * np.clip(best, 0, 1) + 0.25 * overlap + SLACK
    return np.where((n == 0) | (m == 0), 0.0, bound)


def best_of_block(queries: list[dict], values: list[dict], k: int, bonus: float, floor: float) -> tuple[list[tuple], int]:
    """((query, value, score, synonym) of each query's k best of the block, pairs scored).

    ``queries`` carry ``least``, a score that the query's k best of the whole list reach.
    """
    bounds = score_bounds([q["query_norm"] for q in queries], [v["value_norm"] for v in values])
    clusters = [frozenset(v["clusters"] or ()) for v in values]
    out, scored = [], 0
    for q, row in zip(queries, bounds):
        same = np.array([q["cluster"] in c for c in clusters]) if q["cluster"] is not None else np.zeros(len(values), bool)
        row = np.where(same, np.maximum(np.minimum(row + bonus, 1), floor) + SLACK, row)
        # what a chunk's own k best bounds reach cannot be ruled out before it is scored
        worth = np.flatnonzero(row >= q["least"])
        worth = worth[np.argsort(-row[worth], kind="stable")]
        best: list[tuple] = []
        for i in worth.tolist():
            if len(best) == k and row[i] < -best[-1][0]:
                break  # no later one can score higher
            score = token_score(q["query_norm"], values[i]["value_norm"])
            scored += 1
            if same[i]:
                score = max(min(score + bonus, 1.0), floor)
            best.append((-score, len(values[i]["value"]), values[i]["value"], bool(same[i])))
            best.sort()
            del best[k:]
        out += [(q["query"], value, -s, synonym) for s, _, value, synonym in best]
    return out, scored


def _chunks(rows: DataFrame, group: list[str], item: list[str], size: int, name: str) -> DataFrame:
    """(group, chunk, array of items, chunks of the group): hashed chunks of about ``size`` items."""
    rows = rows.select(*group, *item).distinct()
    sizes = rows.groupBy(*group).agg(F.ceil(F.count("*") / size).alias(f"{name}_n"))
    return (
        rows.join(sizes, group)
        .withColumn(f"{name}_c", F.pmod(F.xxhash64(*item), F.col(f"{name}_n")))
        .groupBy(*group, f"{name}_c", f"{name}_n")
        .agg(F.collect_list(F.struct(*item)).alias(name))
    )


def _least_scores(queries: DataFrame, candidates: DataFrame, group: list[str], k: int) -> DataFrame:
    """(group, query, least): the k-th best score among values that share a rare token with the query."""
    token = lambda c: F.explode(F.array_distinct(F.filter(F.split(c, r"\s+"), lambda t: t != "")))
    listed = candidates.select(*group, "value", "value_norm").distinct().withColumn("_t", token("value_norm"))
    rare = listed.groupBy(*group, "_t").agg(F.count("*").alias("_df")).where(F.col("_df") <= RARE)
    asked = queries.select(*group, "query", "query_norm").distinct().withColumn("_t", token("query_norm")).join(rare, [*group, "_t"])
    order = W.partitionBy(*group, "query").orderBy("_df", "_t")
    asked = asked.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= STARTS).drop("_r", "_df")
    some = asked.join(listed, [*group, "_t"]).select(*group, "query", "query_norm", "value", "value_norm").distinct()
    some = some.withColumn("s", token_score_udf("query_norm", "value_norm"))
    kept = some.groupBy(*group, "query").agg(F.slice(F.sort_array(F.collect_list("s"), asc=False), k, 1).alias("s"))  # STARTS * RARE at most
    return kept.where(F.size("s") > 0).select(*group, "query", F.element_at("s", 1).alias("least"))


def rank_candidates(
    queries: DataFrame, candidates: DataFrame, group: list[str], k: int, bonus: float = 0.0, floor: float = 0.0
) -> DataFrame:
    """The k best candidates per query by token score, then length, then text.

    ``queries``: group, query, query_norm and optionally ``cluster``; ``candidates``: group, value,
    value_norm and optionally ``clusters``. A candidate of the query's cluster scores
    ``max(min(score + bonus, 1), floor)``. Result: group, query, value, score, synonym, rank.

    Blocks are keyed by group and both chunk numbers and dealt by that key, so one long list is
    spread over all tasks. Texts without tokens score 0.
    """
    if "cluster" not in queries.columns:
        queries = queries.withColumn("cluster", F.lit(None).cast("string"))
    if "clusters" not in candidates.columns:
        candidates = candidates.withColumn("clusters", F.array().cast("array<string>"))
    # both sides are read several times: once each from what made them
    candidates = staged(candidates.select(*group, "value", "value_norm", "clusters").distinct())
    asked = staged(queries.select(*group, "query", "query_norm", "cluster").distinct())
    asked = asked.join(_least_scores(asked, candidates, group, k), [*group, "query"], "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    asked = staged(asked)
    qs = _chunks(asked, group, ["query", "query_norm", "cluster", "least"], QUERY_CHUNK, "_q")
    vs = _chunks(candidates, group, ["value", "value_norm", "clusters"], VALUE_CHUNK, "_v")
    counted = lambda rows, size, name: rows.groupBy(*group).agg(F.ceil(F.count("*") / size).alias(name))
    counts = counted(asked, QUERY_CHUNK, "_q_n").join(counted(candidates, VALUE_CHUNK, "_v_n"), group)
    key = [*group, "_q_c", "_v_c"]
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    spark = queries.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    left = qs.join(counts.select(*group, "_v_n"), group).withColumn("_v_c", upto("_v_n")).select(*key, "_q").repartition(tasks, *key)
    right = vs.join(counts.select(*group, "_q_n"), group).withColumn("_q_c", upto("_q_n")).select(*key, "_v").repartition(tasks, *key)
    blocks = left.join(right, key).select(*group, "_q", "_v")
    fields = {f.name: f.dataType for f in blocks.schema if f.name in group}
    schema = T.StructType([
        *[T.StructField(g, fields[g]) for g in group], T.StructField("query", T.StringType()), T.StructField("value", T.StringType()),
        T.StructField("score", T.DoubleType()), T.StructField("synonym", T.BooleanType()),
    ])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                rows, _ = best_of_block(one.column("_q").to_pylist()[0], one.column("_v").to_pylist()[0], k, bonus, floor)
                columns = list(zip(*rows)) or [()] * 4
                own = [one.column(g).take(pa.array([0] * len(rows), pa.int32())) for g in group]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, kinds.field(n).type) for c, n in zip(columns, ("query", "value", "score", "synonym")))], schema=kinds)

    found = blocks.mapInArrow(run, schema)
    order = W.partitionBy(*group, "query").orderBy(F.desc("score"), F.length("value"), "value")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
