import random
import re

from llm.helpers import docs, rows_of

from offermend.llm import line_dedup


def key(line):
    k = line.strip(" \t\n\x0b\x0c\r")
    return re.sub("[A-Z]", lambda m: m[0].lower(), k)


def brute(rows):
    """Rows without an id are one document behind all others."""
    owner = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                rank = (i is None, i)
                owner[key(line)] = min(owner.get(key(line), rank), rank)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == (i is None, i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def made(rng, n):
    pool = ["", " ", "short", "a line that repeats", "A LINE that Repeats\t", "ééééééééé", "éééééééééé", "ÀÀÀÀÀÀÀÀÀÀ", "àààààààààà", "hot line, in every text", "x" * 3000]
    return [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own line number {rng.randrange(n)}" for _ in range(rng.randrange(12)))) for i in range(n)]


def test_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    rows = made(rng, 200) + [(500 + i, "hot line, in every text\n\nhot line, in every text") for i in range(300)]
    rows += [(None, "a line that repeats\nnobody's line\nnobody's line"), (None, "nobody's line"), (None, None), (900, None), (901, ""), (3, "own line number 1\nof two rows with an id"), (902, "b\r\n" * 20_000 + "hot line, in every text"), (902, "b\r\n" * 20_000 + "hot line, in every text")]
    rng.shuffle(rows)
    for partitions in (1, 13):  # the hot line spans several partitions
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", partitions == 1)
        got = line_dedup.dedup(docs(spark, rows).repartition(5))
        assert rows_of(got.select("doc_id", "n_lines", "n_dropped", "text")) == brute(rows)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)


def test_string_ids_extra_and_clashing_columns(spark):
    frame = spark.createDataFrame([("b", "the same long line", 7, "k"), ("a", "the same long line", 8, "l"), (None, "the same long line", 9, "m")], "doc_id string, text string, n_lines int, keep string")
    got = line_dedup.dedup(frame)
    assert got.columns == ["doc_id", "text", "keep", "n_lines", "n_dropped"]
    assert rows_of(got) == sorted([("a", "the same long line", "l", 1, 0), ("b", "", "k", 1, 1), (None, "", "m", 1, 1)], key=repr)


def test_bitmaps_round_trip():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.choice([1, 5, 40, 700])
        drops = sorted(rng.sample(range(n), rng.randrange(n + 1)))
        lines = list(range(n))
        assert line_dedup.kept_lines(lines, line_dedup.runs_of(drops)) == [x for x in lines if x not in set(drops)]
    assert len(line_dedup.runs_of(list(range(100, 90_000)))) == 4


def test_empty_table(spark):
    assert line_dedup.dedup(docs(spark, [])).count() == 0
