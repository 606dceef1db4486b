import hashlib
import random

from llm.helpers import docs, rows_of

from offermend.llm import substring_dedup


def brute(rows, window=13):
    last = substring_dedup.LAST
    first = {}
    for key, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - window + 1):
            w = tuple(words[i:i + window])
            first[w] = min(first.get(w, last), last if key is None else key)
    out = []
    for key, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i:i + window])] < (last if key is None else key):
                gone |= set(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((key, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_automaton_statistics_equal_brute_force():
    rng = random.Random(8)
    for _ in range(200):
        added = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 5))]
        auto = substring_dedup.Automaton()
        for s in added:
            auto.add(list(s))
        q = "".join(rng.choice("abc") for _ in range(20))
        want = [max(n for n in range(e + 1) if n == 0 or any(q[e - n:e] in s for s in added)) for e in range(1, 21)]
        assert list(auto.statistics(list(q))) == want


def made(rng):
    vocabulary = [f"w{i}" for i in range(40)]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (12, 13, 14, 20, 40, 80)]
    rows = []
    for i in range(250):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [rng.choice(vocabulary) for _ in range(rng.randint(0, 15))]
            words += rng.choice(passages) if rng.random() < 0.6 else []
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(300 + i, rows[10][1] + " tail") for i in range(30)] + [(None, rows[3][1]), (5, rows[5][1]), (400, None), (401, ""), (402, "é\xa0b " * 20), (403, "é\xa0b " * 30), (404, "same " * 40), (405, "same " * 13)]
    rng.shuffle(rows)
    return rows


def test_removal_equals_brute_force_with_and_without_hot_anchors(spark):
    rows = made(random.Random(12))
    frame = docs(spark, rows).selectExpr("*", "1 AS id", "2 AS spans", "'x' AS anchor").repartition(5)
    for hot in (substring_dedup.HOT, 3, 0):
        assert rows_of(substring_dedup.dedup(frame, hot=hot)) == brute(rows)


def test_given_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    assert rows_of(substring_dedup.dedup(frame)) == brute(rows)


def test_kept_text_and_empty(spark):
    twelve = " ".join("abcdefghijkl")
    got = substring_dedup.dedup(docs(spark, [(1, twelve + " m"), (2, "x " + twelve + " m y"), (3, twelve)]), with_text=True)
    assert {r["doc_id"]: r["kept"] for r in got.collect()} == {1: twelve + " m", 2: "x y", 3: twelve}
    assert substring_dedup.dedup(docs(spark, [])).count() == 0


def test_hot_windows_in_a_broadcast_join_whose_rows_come_in_no_order(spark):
    shared = " ".join(f"s{i}" for i in range(20))
    rows = [(i, ("z" * 8000) + f"{i} " + (shared if i % 4 == 0 else "one")) for i in range(3000, 0, -1)]
    frame = docs(spark, rows).repartition(4)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold") if spark.conf.get(k, None) is not None}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        assert rows_of(substring_dedup.dedup(frame, hot=3)) == brute(rows)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_a_hot_window_of_a_smaller_id_is_kept_in_any_order(spark):
    words = " ".join(f"s{i}" for i in range(13))
    [anchor] = substring_dedup.anchors([words], substring_dedup.Hasher())[0].tolist()
    rows = spark.createDataFrame([(i, 0, words, [], [anchor]) for i in (7, 3, 5)], "id long, row long, text string, cold array<long>, hot array<long>").coalesce(1)
    got = substring_dedup._passages(rows, 13).collect()
    assert sorted((r["id"], r["stop"]) for r in got) == [(3, None), (5, 13), (7, None)]


def test_rows_without_an_id_or_with_one_id_keep_their_own_words(spark):
    shared = " ".join(f"s{i}" for i in range(15))
    rows = [(1, shared), (2, "two " * 3 + shared), (2, " ".join(f"q{i}" for i in range(30)))]
    for i in range(4):
        own = " ".join(f"n{i}x{j}" for j in range(12 + i))
        rows += [(None, f"{own} {shared} {own}"), (None, f"{own} {own}"), (None, f"{own} {own}")]
    for hot in (substring_dedup.HOT, 3, 0):
        assert rows_of(substring_dedup.dedup(docs(spark, rows).repartition(3), hot=hot)) == brute(rows)


def test_anchors_of_many_texts_are_those_of_each(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "a", *(rng.choice(["", " "]) + " \x0b".join(rng.choice("abcdeéß") * rng.randrange(1, 3) for _ in range(rng.randrange(60))) + rng.choice(["", "\n "]) for _ in range(200)), None, ""]
    known = substring_dedup.Hasher()
    for text, found in zip(texts, substring_dedup.anchors(texts, known), strict=True):
        assert len(found) == max(0, len(substring_dedup.words_of(text)) - 12)
        assert found.tolist() == substring_dedup.anchors([text], known)[0].tolist()
