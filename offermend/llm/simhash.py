"""SimHash near-dedup by covering locality-sensitive hashing.

A text's fingerprint has bit b set if over half of its word shingles have it set in their XXH64.
Distinct fingerprints are compared, each with the smallest id that has it, so copies cost nothing.
Bit i of a fingerprint gets a code c(i) of ``radius + 1`` bits. For each of the 2**(radius+1) - 1
non-zero vectors v there is a table, keyed by the bits i with <c(i), v> = 1. At most ``radius``
differing bits have codes that span less than the whole space, so some v is orthogonal to them all:
that table's mask leaves them out, and the pair is sure to collide there.

A table's bucket of two gives its pair at once; one of up to ``bucket`` fingerprints is compared
within a row. For larger buckets there is another exact way that never pairs up a group: two
fingerprints at 4 or fewer bits have a midpoint at 2 or fewer bits from both, so every member of such
a bucket is sent to all its points within half the radius, and each point links its visitors to the
smallest of them. Visitors of one point are within the radius of each other, so no false link arises.

Defined results: null or blank texts have fingerprint zero and link like any other; texts of fewer
words than a shingle hash the whole sequence; a null id is never the smallest while another is there;
rows that repeat get the same result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offermend.llm.common import components, released, schema_of
from offermend.session import staged

WORDS = 4
RADIUS = 4
HASH_SEED = 42
#: Fingerprints of one bucket that are compared with each other in a row; larger ones go by midpoints.
BUCKET = 48
#: Shingle hashes whose bits are counted at a time.
CHUNK = 65_536


def fingerprint(text: str | None, words: int = WORDS, seed: int = HASH_SEED) -> int:
    buffer = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not buffer:
        return 0
    raw = np.frombuffer(buffer, np.uint8)
    starts = np.concatenate(([0], np.flatnonzero(raw == 32) + 1))
    n = max(1, len(starts) - words + 1)
    ends = np.concatenate((starts[words:] - 1, [len(buffer)])) if len(starts) >= words else np.array([len(buffer)])
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        some = np.array([digest(buffer[a:b], seed) for a, b in zip(starts[at:min(n, at + CHUNK)].tolist(), ends[at:at + CHUNK].tolist(), strict=False)], dtype=">u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, carry: bool = False) -> DataFrame:
    """The id (or with ``carry`` all columns) and ``fp``, the fingerprint as a signed long."""
    columns = docs.columns if carry else [id_col, text]
    kept = [c for c in columns if carry or c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(columns.index(text)).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(columns.index(c)) for c in kept] + [pa.array(fps)], names=[*kept, "fp"])

    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(released(run), schema_of(docs, kept) + ", fp long")


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The covering family, as signed longs: codes go round the non-zero vectors so that they are used evenly."""
    vectors = range(1, 2 ** (radius + 1))
    codes = [1 + (i * 7) % (2 ** (radius + 1) - 1) for i in range(bits)]
    family = [sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() & 1) for v in vectors]
    return [m - (1 << bits) if m >> (bits - 1) else m for m in family]


def near(half: int, bits: int = 64) -> list[int]:
    """All differences of at most ``half`` bits, as signed longs."""
    flips = [sum(1 << i for i in some) for n in range(half + 1) for some in itertools.combinations(range(bits), n)]
    return [f - (1 << bits) if f >> (bits - 1) else f for f in flips]


def links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b) pairs of distinct fingerprints within the radius that connect all that are so linked.

    ``prints``: a written table of distinct fp.
    """
    if radius % 2:
        raise ValueError("midpoints need an even radius")
    tables = F.array(*[F.lit(m) for m in masks(radius)])
    keyed = prints.select("fp", F.posexplode(tables).alias("t", "m")).select("fp", "t", F.col("fp").bitwiseAND(F.col("m")).alias("key"))
    sizes = staged(keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    twos = sizes.where("n = 2").select("a", "b").where(apart <= radius)
    more = staged(keyed.join(sizes.where("n > 2").select("t", "key", "n"), ["t", "key"]).select("t", "key", "n", "fp"))
    lists = more.where(F.col("n") <= bucket).groupBy("t", "key").agg(F.sort_array(F.collect_list("fp")).alias("l"))  # at most ``bucket`` each
    firsts = lists.select("l", F.posexplode("l").alias("i", "a"))
    pairs = firsts.select("a", F.explode(F.slice("l", F.col("i") + 2, F.lit(bucket))).alias("b")).where(apart <= radius)
    hot = more.where(F.col("n") > bucket).select("fp").distinct()
    flips = F.array(*[F.lit(x) for x in near((radius + 1) // 2)])
    visits = hot.select("fp", F.explode(flips).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("point"))
    return twos.union(pairs).union(_by_point(visits, radius)).distinct()


def _by_point(visits: DataFrame, radius: int) -> DataFrame:
    """(a, b) pairs of the visitors (fp, point) of each point: its smallest and every other.

    Sizes are estimated before visits are laid out, two thousand for a fingerprint, so the hint keeps them from being
    broadcast through the driver as if they were few.
    """
    least = visits.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("point", "a")
    both = visits.hint("merge").join(least, "point").where("fp <> a").select("a", F.col("fp").alias("b"))
    return both.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def groups(prints: DataFrame, id_col: str = "doc_id", radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(fp, c, component_id, n) for each distinct fingerprint of a written (id, fp) table; c is its
    component's smallest fingerprint, n counts the component's rows."""
    distinct = staged(prints.groupBy("fp").agg(F.min(id_col).alias("first_id"), F.count("*").alias("rows")))
    linked = components(links(distinct.select("fp"), radius, bucket), "a", "b")
    labelled = staged(distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", "rows", F.coalesce("component", "fp").alias("c")))
    heads = labelled.groupBy("c").agg(F.min("first_id").alias("component_id"), F.sum("rows").alias("n"))
    return labelled.join(heads, "c").select("fp", "c", "component_id", "n")


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id."""
    prints = staged(fingerprints(docs, id_col, text, words))
    joined = prints.join(groups(prints, id_col, radius), "fp")
    return joined.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.col("n").alias("component_rows"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of each component, columns as they were: the smallest id, and one of the rows that share it."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn("__key", F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.xxhash64(*columns)))
    prints = staged(fingerprints(keyed.select(id_col, text, "__key"), id_col, text, words, carry=True).drop(text))
    best = F.min(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("id"), F.col("__key").alias("key"))).alias("best")
    winners = prints.join(groups(prints, id_col, radius), "fp").groupBy("c").agg(best).select(F.col("best.key").alias("__key"))
    kept = keyed.join(staged(winners), "__key", "left_semi")
    return kept.withColumn("__place", F.row_number().over(Window.partitionBy("__key").orderBy("__key"))).where("__place = 1").select(*columns)
