import hashlib
import random
import re

from llm.helpers import docs, rows_of

from offermend.llm import exact_dedup


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i))
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = min(g)[1]
        out.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_classes_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \t", "a b", "ab", "a  b", "é b", "éb", "x" * 50_000, "hot text"]
    rows = [(i, rng.choice(texts)) for i in range(300)] + [(1000 + i, "hot " + " " * (i % 3) + "text") for i in range(200)]
    for support in (0.5, 0.01):  # few counters, and one for every digest
        assert rows_of(exact_dedup.classes(docs(spark, rows), support=support)) == brute(rows)


def test_keep_one_keeps_columns_and_one_row(spark):
    rows = [(1, "a", "en", "s"), (1, "a", "en", "s"), (None, "a a"), (None, "b"), (2, "a  a"), (3, "a   a", "de")]
    frame = docs(spark, rows).selectExpr("*", "true AS kept", "'x' AS keep_id", "1 AS __digest_like")
    got = exact_dedup.keep_one(frame)
    assert got.columns == frame.columns
    assert rows_of(got.select("doc_id", "text")) == sorted([(1, "a"), (3, "a   a"), (None, "b")], key=repr)


def test_empty_table(spark):
    assert exact_dedup.classes(docs(spark, [])).count() == 0
    assert exact_dedup.keep_one(docs(spark, [])).count() == 0
