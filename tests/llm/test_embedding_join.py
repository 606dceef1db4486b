import numpy as np

from offermend.llm import embedding_join


def brute(rows, threshold=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root = list(range(len(good)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    n = [0] * len(good)
    for a, (_, x) in enumerate(good):
        for b in range(a):
            y = good[b][1]
            if len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                n[a] += 1
                n[b] += 1
                root[top(a)] = top(b)
    least = {}
    for a, (i, _) in enumerate(good):
        least[top(a)] = min(i, least.get(top(a), i))
    out = {i: (n[a], least[top(a)]) for a, (i, _) in enumerate(good)}
    return sorted([(i, *out.get(i, (0, i)), i is None or out.get(i, (0, i))[1] == i) for i, _ in rows], key=repr)


def check(spark, rows, **more):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS key", "'x' AS rep", "2 AS label").coalesce(2)
    got = embedding_join.classes(frame, **more)
    assert sorted((tuple(r) for r in got.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr) == brute(rows)


def test_given_table_equals_brute_force(spark, monkeypatch):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    check(spark, rows)
    got = embedding_join.classes(table)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_dense_clusters_small_intervals_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "INTERVAL", 16)
    monkeypatch.setattr(embedding_join, "LEAF", 4)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    x = np.concatenate([centres[rng.integers(6, size=400)] + rng.normal(size=(400, 12)) * rng.choice([0.02, 0.25, 0.5], size=(400, 1)), rng.normal(size=(100, 12))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(600, None), (601, []), (602, [0.0] * 12), (603, [1.0, None] + [0.0] * 10), (604, [float("nan")] * 12), (605, [float("inf")] * 12), (None, x[0].tolist()), (606, x[0].tolist()), (607, x[0].tolist()), (608, [1.0]), (609, [2.0]), (610, [-1.0]), (611, [1e30] * 12), (612, [1e-30] * 12)]
    check(spark, rows)


def test_empty(spark):
    assert embedding_join.classes(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_boxes_wholly_within_reach_and_groups_of_one_interval(spark, monkeypatch):
    """A large group of near copies is linked by count; tiles of single intervals give the same."""
    monkeypatch.setattr(embedding_join, "INTERVAL", 32)
    monkeypatch.setattr(embedding_join, "LEAF", 8)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=8) + rng.normal(size=(300, 8)) * 0.01, rng.normal(size=(200, 8))])
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    check(spark, rows)
    monkeypatch.setattr(embedding_join, "GROUP", 1)
    check(spark, rows)
    monkeypatch.setattr(embedding_join, "GROUP_BYTES", 1)
    wide = spark.createDataFrame([(i, [float(k) for k in v]) for i, v in rows], "vec_id long, embedding array<double>")
    assert sorted((tuple(r) for r in embedding_join.classes(wide).collect()), key=repr) == brute(rows)
