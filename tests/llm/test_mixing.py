import heapq
import random
from collections import defaultdict

from llm.helpers import docs, rows_of
from pyspark.sql import functions as F

from offermend.llm import mixing


def sainte_lague(votes: dict, seats: int) -> dict:
    won = dict.fromkeys(votes, 0)
    heap = [(-v, p) for p, v in votes.items() if v > 0]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            break
        _, p = heapq.heappop(heap)
        won[p] += 1
        heapq.heappush(heap, (-votes[p] / (2 * won[p] + 1), p))
    return won


def test_apportionment_equals_the_sequential_rule(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for g in range(12):
        votes = {p: float(rng.choice([0, 1, 3, rng.randint(1, 5000)])) for p in range(rng.randint(1, 30))}
        seats = rng.choice([0, 1, 7, 100, 2000])
        rows += [(g, p, v, seats) for p, v in votes.items()]
        want |= {(g, p): n for p, n in sainte_lague(votes, seats).items()}
    frame = spark.createDataFrame(rows, "g long, p long, votes double, seats long")
    got = {(r["g"], r["p"]): r["won"] for r in mixing.apportion(frame, ["g"], "p", "votes", "seats", "won").collect()}
    assert got == want


def water_level(sizes: list[int], weights: list[float]) -> list[float]:
    """By resharing until no target is above its cap."""
    budget, free, out = 1.5 * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        level = (budget - sum(out[i] for i in range(len(sizes)) if i not in free)) / sum(weights[i] for i in free)
        over = {i for i in free if level * weights[i] > 2 * sizes[i]}
        for i in free:
            out[i] = 2.0 * sizes[i] if i in over else level * weights[i]
        if not over:
            return out
        free -= over
    return out


def test_mix_is_near_its_targets_and_never_above_twice(spark):
    rng = random.Random(11)
    rows = [(i, "w " * rng.randint(0, 900), None, rng.choice(["a", "a", "a", "b", "c", None, "Z"])) for i in range(900)] + [(None, "x y"), (5, None, None, "a"), (5, None, None, "a")]
    frame = docs(spark, rows)
    got = mixing.mix(frame, per_shard=64).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_level([sizes[s] for s in order], [(3.0, 1.0, 2.0)[i % 3] for i in range(len(order))])
    for s, w in zip(order, want, strict=True):
        assert abs(target[s] - w) < 1e-6 * max(1, w)
        assert abs(taken[s] - w) <= max(16, 0.02 * w)
    assert rows_of(mixing.mix(frame, per_shard=64).select("doc_id", "taken")) == rows_of(mixing.mix(frame.repartition(7), per_shard=64).select("doc_id", "taken"))


def test_realised_words_are_the_taken_ones(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"{i}-{k}" for k in range(rng.randint(1, 200))), None, "ab"[i % 5 == 0]) for i in range(200)]
    mixed = mixing.mix(docs(spark, rows), per_shard=32)
    taken = dict(mixed.select("doc_id", "taken").collect())
    made = mixing.realise(mixed, ["doc_id", "text", "lang", "source", "n_chars"])
    words = defaultdict(list)
    for r in made.collect():
        assert r["n_chars"] == len(r["text"])
        words[r["doc_id"]] += r["text"].split()
    assert {k: len(v) for k, v in words.items()} == {k: v for k, v in taken.items() if v}
    whole = {i: t.split() for i, t, *_ in rows}
    assert all(set(v) <= set(whole[k]) and max(v.count(w) for w in set(v)) <= 2 for k, v in words.items())


def test_empty_and_clashing_columns(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    frame = docs(spark, [(1, "a b", None, "s")]).withColumns({"taken": F.lit("t"), "shard": F.lit(1), "size": F.lit("s")})
    row = mixing.mix(frame).first()
    assert (row["size"], row["taken"] >= 0) == (2, True)
