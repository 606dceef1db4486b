import random

import xxhash
from llm.helpers import docs, rows_of

from offermend.llm import simhash


def brute_print(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(rows):
    fps = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least.setdefault(top(i), []).append(key)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return sorted([(rows[i][0], f"{fps[i]:016x}", least[top(i)]) for i in range(len(rows))], key=repr)


def test_masks_cover_the_radius():
    family = [m & (1 << 64) - 1 for m in simhash.masks()]
    assert len(family) == 31
    rng = random.Random(1)
    for _ in range(20_000):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(m & flips == 0 for m in family)


def test_fingerprints():
    for t in ["", " \n", "One", "a b C", "a b c d", "é É ſ x y z w", "w " * 100_000]:
        assert simhash.fingerprint(t) == brute_print(t)


def near_rows(spark):
    rng = random.Random(4)
    base = [w for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(5).collect() for w in r["text"].split()][:400]
    rows = [(i, " ".join(w if rng.random() > 0.004 else f"new{i}" for w in base)) for i in range(120)]
    return rows + [(200 + i, f"{i} other words {i * i} stand here {i % 7}") for i in range(80)] + [(500, None), (501, ""), (502, " "), (None, "a b"), (503, "a b"), (503, "a b")]


def test_components_equal_brute_force_by_pairs_and_by_midpoints(spark):
    rows = near_rows(spark)
    frame = docs(spark, rows)
    assert rows_of(simhash.classes(frame).select("doc_id", "fingerprint", "component_id")) == brute_classes(rows)
    prints = simhash.staged(simhash.fingerprints(frame))
    by_points = prints.join(simhash.groups(prints, bucket=2), "fp").select("doc_id", "component_id")
    assert rows_of(by_points) == sorted([(k, c) for k, _, c in brute_classes(rows)], key=repr)


def test_keep_one(spark):
    rows = near_rows(spark)
    frame = docs(spark, rows).selectExpr("*", "'mine' AS fp", "1 AS component_id")
    got = simhash.keep_one(frame)
    assert got.columns == frame.columns
    want = sorted({c for _, _, c in brute_classes(rows)})
    assert sorted(r["doc_id"] for r in got.collect()) == want
    assert simhash.keep_one(docs(spark, [])).count() == 0 and simhash.classes(docs(spark, [])).count() == 0


def test_visits_are_not_broadcast(spark):
    """A few fingerprints make so many visits that their estimated size says nothing."""
    flips = simhash.near(2)
    hot = [5, 5 ^ 1 << 40, 5 ^ 3 << 40, -1]
    frame = spark.createDataFrame([(x,) for x in hot], "fp long")
    visits = frame.selectExpr("fp", f"explode(array({', '.join(f'{x}L' if x > -(1 << 63) else 'bigint(-9223372036854775808)' for x in flips)})) AS x").selectExpr("fp", "fp ^ x AS point")
    pairs = simhash._by_point(visits, 4)
    assert "BroadcastExchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    found = {tuple(r) for r in pairs.collect()}
    assert found and all((a ^ b).bit_count() <= 4 and a < b for a, b in found)
    assert {x for r in found for x in r} == set(hot[:3])
