"""Reference lookups, gate, rules and scored resolution on small hand-made tables."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from offermend.functions import fuzzy
from offermend.functions.text import norm_color
from offermend.operators import detect, matching, resolver
from offermend.operators.indexes import ReferenceIndex


def make_index(spark, chars, values, name="Tricouri"):
    """chars: (id, name, mandatory, restrictive, external id); values: (id, name, value)."""
    cats = spark.createDataFrame([("1", None, name, 0)], "category_id string, external_id string, category_name string, ordinal bigint")
    chars = spark.createDataFrame(
        [(i, e, "1", n, m, r, k) for k, (i, n, m, r, e) in enumerate(chars)],
        "characteristic_id string, external_characteristic_id string, category_id string, characteristic_name string, mandatory boolean, restrictive boolean, ordinal bigint",
    )
    vals = spark.createDataFrame(
        [("1", i, n, v, k) for k, (i, n, v) in enumerate(values)],
        "category_id string, characteristic_id string, characteristic_name string, value string, ordinal bigint",
    )
    return ReferenceIndex.build(cats, chars, vals).persist()


COLOR = [("10", "Culoare:", True, True, "100")]
COLORS = [("10", "Culoare", "Negru"), ("10", "Culoare", "Alb"), ("10", "Culoare", "Bleumarin")]


def valid(spark, index, char, *values):
    asked = spark.createDataFrame([("1", char, v) for v in values], "cat string, char_input string, value_input string")
    return {r.value_input: r.value for r in matching.find_valid(asked, index).collect()}


def test_values_are_found_by_every_tier(spark):
    index = make_index(spark, COLOR, COLORS)
    got = valid(spark, index, "Culoare", "Negru", "negru", "Bleumarîn", "Bleumarins", "Portocaliu", " Alb ")
    assert got == {"Negru": "Negru", "negru": "Negru", "Bleumarîn": "Bleumarin", "Bleumarins": "Bleumarin", "Portocaliu": None, " Alb ": "Alb"}
    sizes = make_index(spark, [("1", "Marime:", True, True, "1")], [("1", "Marime:", v) for v in ("42 EU", "42.5 EU", "XL INTL", "M")])
    got = valid(spark, sizes, "Marime", "42", "42,5", "42.0", "xl", "m", "44")
    assert got == {"42": "42 EU", "42,5": "42.5 EU", "42.0": "42 EU", "xl": "XL INTL", "m": "M", "44": None}


def test_gate_audit(spark):
    index = make_index(spark, [*COLOR, ("20", "Brand", False, False, "200"), ("30", "Note", True, True, "300")], COLORS)
    rows = spark.createDataFrame(
        [("o", "1", "Culoare:", "Roșu", "image"), ("o", "1", "Culoare", "ALB", "ai"), ("o", "1", "Brand", "Nike", "ai"), ("o", "1", "Note", "x", "ai"), ("o", "1", "Sex", "x", "ai")],
        "offer_id string, cat string, char_input string, value_input string, source string",
    )
    got = {r.char_input: (r.accept, r.value_mapped, r.reason) for r in matching.validate_gate(rows, index).collect()}
    assert got["Culoare:"] == (False, None, "value_not_in_values_table")
    assert got["Culoare"] == (True, "Alb", "ok")
    assert got["Brand"] == (True, "Nike", "ok")
    assert got["Note"] == (True, "x", "ok")
    assert got["Sex"] == (False, None, "char_not_in_characteristics")
    strict = {r.char_input: r.reason for r in matching.validate_gate(rows, index, strict_freeform=True).collect()}
    assert strict["Note"] == "no_values_defined_for_char" and strict["Brand"] == "ok"


def test_restrictive_flag(spark):
    index = make_index(spark, [("20", "Brand", False, False, "200"), ("21", "Tip", False, True, None)], [])
    pairs = spark.createDataFrame([("1", "Brand:"), ("1", "Tip"), ("1", "Other")], "cat string, char_input string")
    assert {r.char_input: r.restrictive for r in matching.is_restrictive(pairs, index).collect()} == {"Brand:": False, "Tip": True, "Other": True}


RULE_CASES = [
    ("Culoare de baza", ["negru", "alb"], "Tricou negru", "", ["negru"]),
    ("Material:", [], "Nike Cotton T-Shirt", "", ["Bumbac"]),
    ("Material:", ["Fleece"], "Cotton", "", []),
    ("Sport:", ["alergare"], "Pantofi de alergare", "", ["alergare"]),
    ("Tip produs:", ["Pantaloni", "Tricou"], "Nike Short Sleeve Running Top - L", "", []),
    ("Imprimeu:", ["Cu model", "Uni", "Logo"], "Nike Air Force 1 Model 2024 - Alb", "", []),
    ("Imprimeu:", ["Cu model", "Uni"], "Tricou Graphic Nike", "", ["Cu model"]),
    ("Sezon:", ["Toamna-Iarna"], "Bluza Fleece Lightweight", "", []),
    ("Sezon:", ["Toamna-Iarna", "Primavara-Vara"], "Bluza Fleece Lightweight", "", ["Primavara-Vara"]),
    ("Sezon:", ["Toamna-Iarna"], "Bluza Fleece", "", ["Toamna-Iarna"]),
    ("Pentru:", ["Women", "Men"], "Női cipő", "", ["Women"]),
    ("Marime:", ["42 EU"], "Nike - 42 férfi futócipő", "", ["42 EU"]),
    ("Marime:", [], "Nike - 42,5", "", ["42.5 EU"]),
    ("Marime:", [], "Nike - 2024", "", []),
    ("Marime:", [], "Nike - One Size", "", ["One Size"]),
    ("Varsta:", ["7-8 ani"], "x", "pentru 7-8 ani", ["7-8 ani"]),
    ("Crampoane detasabile:", ["N/A"], "x", "", ["N/A"]),
]


def test_rules(spark):
    """Every case is a category of its own, so one run covers them all."""
    cats, chars, vals, offers = [], [], [], []
    for n, (attribute, values, title, text, _) in enumerate(RULE_CASES):
        cats.append((str(n), None, f"cat {n}", n))
        chars.append((f"a{n}", f"e{n}", str(n), attribute, False, True, n))
        vals += [(str(n), f"a{n}", attribute, v, i) for i, v in enumerate(values)]
        offers.append((str(n), str(n), title, text))
    index = ReferenceIndex.build(
        spark.createDataFrame(cats, "category_id string, external_id string, category_name string, ordinal bigint"),
        spark.createDataFrame(
            chars,
            "characteristic_id string, external_characteristic_id string, category_id string, characteristic_name string, mandatory boolean, restrictive boolean, ordinal bigint",
        ),
        spark.createDataFrame(vals, "category_id string, characteristic_id string, characteristic_name string, value string, ordinal bigint"),
    ).persist()
    rows = spark.createDataFrame(offers, "offer_id string, cat string, title string, visible string")
    got = {r.offer_id: r.value for r in detect.detect(rows, index, detect.concept_names_table(spark)).collect()}
    assert got == {str(n): case[4][0] for n, case in enumerate(RULE_CASES) if case[4]}


def test_keyword_rules(spark):
    rules = spark.createDataFrame(
        [("sneaker, men", "kids", None, "Men shoes", 0), ("sneaker", "", None, "Shoes", 1), ("", "", "hat", "Hats", 2)],
        "keywords string, exclude string, prefix string, category string, ordinal bigint",
    )
    titles = spark.createDataFrame([("Sneaker Men 42",), ("Sneaker men kids",), ("Women sneaker",), ("Red Hat",), ("What",)], "title string")
    got = {r.title: r.category for r in detect.keyword_rules(titles, rules).collect()}
    assert got == {"Sneaker Men 42": "Men shoes", "Sneaker men kids": "Shoes", "Women sneaker": "Shoes", "Red Hat": "Hats"}


@pytest.mark.parametrize("cutoff", [0.80, 0.90])
def test_closest_equals_brute_force(spark, cutoff):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9))).strip() or "a" for _ in range(160)]
    groups = ["g1"] * 120 + ["g2"] * 40
    names = list(zip(groups, words))
    asked = list({(g, w[: rng.randint(0, len(w))] + rng.choice("abcé") + w[rng.randint(0, len(w)):]) for g, w in names})
    q = spark.createDataFrame(asked, "g string, query string")
    c = spark.createDataFrame(names, "g string, cand string")
    got = {(r.g, r.query): r.cand for r in fuzzy.closest(q, c, ["g"], "query", "cand", cutoff).collect()}
    want = {}
    for g, query in asked:
        hit = difflib.get_close_matches(query, sorted({w for h, w in names if h == g}), n=1, cutoff=cutoff)
        if hit:
            want[(g, query)] = hit[0]
    assert got == want and want


def test_ranking_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "QUERY_CHUNK", 7)  # many chunks, so that hot groups are really split
    monkeypatch.setattr(fuzzy, "VALUE_CHUNK", 5)
    rng = random.Random(3)
    pool = ["red", "dark", "blue", "navy", "light", "green", "sea"]
    values = sorted({" ".join(rng.sample(pool, rng.randint(1, 3))) for _ in range(60)})
    asked = sorted({" ".join(rng.sample(pool, 2)) + rng.choice(["", "x"]) for _ in range(30)})
    q = spark.createDataFrame([("g", s, s) for s in asked], "g string, query string, query_norm string")
    c = spark.createDataFrame([("g", s, s) for s in values], "g string, value string, value_norm string")
    got = {(r.query, r.rank): r.value for r in fuzzy.rank_candidates(q, c, ["g"], 3).collect()}
    for s in asked:
        best = sorted(values, key=lambda v: (-fuzzy.token_score(s, v), len(v), v))[:3]
        assert [got[(s, i + 1)] for i in range(3)] == best


def test_bounds_hold_for_every_pair():
    rng = random.Random(1)
    pool = ["alb", "negru", "bleu", "marin", "bleumarin", "verde", "inchis", "gri", "mat", "x", "ab", "é", "ß-1"]
    text = lambda: " ".join(rng.choice(pool) + rng.choice(["", "", "a", "u"]) for _ in range(rng.randrange(5)))
    for _ in range(20):
        queries, values = [text() for _ in range(15)], [text() for _ in range(40)]
        bounds = fuzzy.score_bounds(queries, values)
        assert all(fuzzy.token_score(q, v) <= bounds[i, j] for i, q in enumerate(queries) for j, v in enumerate(values))


def test_synonyms_rank_as_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "VALUE_CHUNK", 6)
    rng = random.Random(6)
    pool = ["red", "dark", "blue", "navy", "sea", ""]
    values = sorted({" ".join(rng.sample(pool, 2)) for _ in range(40)})
    clusters = {v: rng.sample(["c1", "c2", "c3"], rng.randrange(3)) for v in values}
    asked = {" ".join(rng.sample(pool, 2)): rng.choice([None, "c1", "c2"]) for _ in range(20)}
    q = spark.createDataFrame([("g", s, s, c) for s, c in asked.items()], "g string, query string, query_norm string, cluster string")
    c = spark.createDataFrame([("g", s, s, clusters[s]) for s in values], "g string, value string, value_norm string, clusters array<string>")
    got = {(r.query, r.rank): (r.value, round(r.score, 6), r.synonym) for r in fuzzy.rank_candidates(q, c, ["g"], 4, 0.2, 0.6).collect()}
    for s, own in asked.items():
        marks = []
        for v in values:
            score, synonym = fuzzy.token_score(s, v), own in clusters[v]
            marks.append((-(max(min(score + 0.2, 1.0), 0.6) if synonym else score), len(v), v, synonym))
        assert [got[(s, i + 1)] for i in range(4)] == [(v, round(-m, 6), syn) for m, _, v, syn in sorted(marks)[:4]]


def test_a_long_list_is_pruned_and_spread(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvz") for _ in range(rng.randint(4, 8)))
    pool = [word() for _ in range(6000)]
    values = sorted({" ".join(rng.choice(pool) for _ in range(rng.randint(2, 4))) for _ in range(100_000)})
    asked = [v.replace(rng.choice(v.split()), word()) for v in rng.sample(values, 40)]
    q = spark.createDataFrame([("g", s, s, None) for s in asked], "g string, query string, query_norm string, cluster string")
    c = spark.createDataFrame([("g", s, s, []) for s in values], "g string, value string, value_norm string, clusters array<string>")
    least = {r.query: r.least for r in fuzzy._least_scores(q, c, ["g"], 3).collect()}
    queries = [{"query": s, "query_norm": s, "cluster": None, "least": least.get(s, 0.0)} for s in asked]
    best, scored = {}, 0
    for at in range(0, len(values), fuzzy.VALUE_CHUNK):
        rows, n = fuzzy.best_of_block(queries, [{"value": v, "value_norm": v, "clusters": []} for v in values[at:at + fuzzy.VALUE_CHUNK]], 3, 0.0, 0.0)
        scored += n
        for query, v, score, _ in rows:
            best.setdefault(query, []).append((-score, len(v), v))
    assert scored < 0.05 * len(asked) * len(values)
    for s in asked[:3]:
        assert sorted(best[s])[:3] == sorted((-fuzzy.token_score(s, v), len(v), v) for v in values)[:3]
    ranked = fuzzy.rank_candidates(q, c, ["g"], 3)
    got = {(r.query, r.rank): r.value for r in ranked.collect()}
    assert got == {(s, i + 1): sorted(best[s])[i][2] for s in asked for i in range(3)}
    keys = spark.range(-(-len(values) // fuzzy.VALUE_CHUNK)).select(F.pmod(F.hash(F.lit("g"), F.lit(0).cast("long"), "id"), F.lit(4)).alias("p"))
    assert keys.distinct().count() == 4  # one list's blocks are dealt to all four partitions


def test_heavy_segments_are_split(spark, monkeypatch):
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("ab") for _ in range(8)) for _ in range(200)})
    asked = sorted({n[:3] + rng.choice("abc") + n[4:] for n in names})
    q = spark.createDataFrame([("g", s) for s in asked], "g string, query string")
    c = spark.createDataFrame([("g", s) for s in names], "g string, cand string")
    want = {s: difflib.get_close_matches(s, names, n=1, cutoff=0.8) for s in asked}
    for heavy in (3, 10**6):
        monkeypatch.setattr(fuzzy, "HEAVY", heavy)
        got = {r.query: [r.cand] for r in fuzzy.closest(q, c, ["g"], "query", "cand", 0.8).collect()}
        assert got == {s: w for s, w in want.items() if w}


def test_scores():
    assert fuzzy.token_score("black", "black") == 1.0
    assert fuzzy.token_score("black", "yellow") < 0.5
    assert fuzzy.token_set_ratio("dark blue", "blue") == 1.0
    assert round(fuzzy.token_set_ratio("fuzzy was a bear", "wuzzy fuzzy was a bear"), 4) == 1.0
    assert abs(fuzzy.token_set_ratio("ab", "ac") - 0.5) < 1e-9


ALLOWED = ["Negru", "Alb", "Gri", "Rosu", "Roz", "Albastru", "Bleumarin", "Verde", "Galben", "Portocaliu", "Mov", "Maro", "Bej", "Turcoaz", "Auriu", "Argintiu", "Multicolor"]


def test_map_color(spark):
    asked = ["Negru", "negru", "black", "purple", "teal", "navy", "beige", "rosu", "kek", "charcoal", "xyzzy123", "off-white"]
    q = spark.createDataFrame([("l", a) for a in asked], "l string, detected string")
    allowed = spark.createDataFrame([("l", a) for a in ALLOWED], "l string, value string")
    got = {r.detected: r for r in resolver.map_color(q, allowed, ["l"], resolver.cluster_table(spark)).collect()}
    want = {"Negru": "Negru", "negru": "Negru", "black": "Negru", "purple": "Mov", "teal": "Turcoaz", "navy": "Bleumarin", "beige": "Bej", "rosu": "Rosu",
            "kek": "Albastru", "charcoal": "Negru", "xyzzy123": None, "off-white": "Alb"}
    assert {k: v.mapped_value for k, v in got.items()} == want
    assert got["negru"].method == "exact" and got["black"].method == "synonym" and got["black"].score == 0.85
    assert got["xyzzy123"].method == "none" and got["xyzzy123"].needs_review and got["xyzzy123"].top_k


def test_map_color_reranks_with_vectors(spark):
    q = spark.createDataFrame([("l", "dark blue")], "l string, detected string")
    allowed = spark.createDataFrame([("l", "blue"), ("l", "dark")], "l string, value string")
    vectors = spark.createDataFrame([("dark blue", [1.0, 0.0]), ("blue", [0.0, 1.0]), ("dark", [1.0, 0.0])], "text string, vector array<double>")
    plain = resolver.map_color(q, allowed, ["l"], resolver.cluster_table(spark)).first()
    moved = resolver.map_color(q, allowed, ["l"], resolver.cluster_table(spark), vectors).first()
    assert plain.mapped_value == "blue" and moved.mapped_value == "dark" and moved.method == "semantic"


def test_resolver(spark):
    hu = ["Kék", "Fekete", "Fehér", "Piros", "Zöld", "Sárga", "Szürke"]
    index = make_index(spark, [("1", "Szín:", True, True, "1")], [("1", "Szín:", v) for v in hu])
    rows = spark.createDataFrame(
        [("o", "1", "Szín:", v, m, i) for i, (v, m) in enumerate([("Kék", False), ("Feket", False), ("Zöl", True), ("xyzzy", True), ("Pir", True)])],
        "offer_id string, cat string, char_name string, value_input string, is_mandatory boolean, position int",
    )
    choices = spark.createDataFrame([("1", "Szín:", "xyzzy", "nope"), ("1", "Szín:", "Pir", "Piros")], "cat string, char_name string, value_input string, choice string")
    got = {r.value_input: r for r in resolver.resolve_values(rows, index, choices).collect()}
    assert (got["Kék"].value, got["Kék"].method, got["Kék"].needs_review) == ("Kék", "exact", False)
    assert got["Zöl"].method == "rescue" and got["Zöl"].value == "Zöld" and got["Zöl"].low_confidence
    assert got["xyzzy"].value is None and got["xyzzy"].needs_review and len(got["xyzzy"].top_k) == 3
    assert got["Pir"].method == "repair" and got["Pir"].score >= 0.70
    none = {r.value_input: r.method for r in resolver.resolve_values(rows, index, choices, budget=0).collect()}
    assert none["Pir"] != "repair"


def test_norm_color_key(spark):
    assert spark.range(1).select(norm_color(F.lit("Albastru-Închis"))).first()[0] == "albastru inchis"


def test_vectors_are_scored_against_every_centre(spark):
    from offermend.plans import queries_match as Q

    sf_dir = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    vectors = {r.vec_id: np.array(r.embedding, np.float64) for r in rows}
    centers = {k: np.mean([vectors[r.vec_id] for r in rows if r.label == k], axis=0) for k in {r.label for r in rows}}
    score = {(v, k): x @ c / np.sqrt((x @ x) * (c @ c)) for v, x in vectors.items() for k, c in centers.items()}
    want = {v: sorted(centers, key=lambda k: (-score[v, k], k)) for v in vectors}
    got = {(r.vec_id, r.candidate): r.score for r in Q.cosine_scores(spark, sf_dir).collect()}
    assert got.keys() == score.keys() and all(abs(got[k] - score[k]) < 1e-4 for k in score)
    assert {(r.vec_id, r["rank"]): r.candidate for r in Q.top_k_candidates(spark, sf_dir).collect()} == {(v, i + 1): want[v][i] for v in vectors for i in range(3)}
    ties = {r.vec_id: (r.candidate, r.near_tie) for r in Q.near_tie(spark, sf_dir).collect()}
    assert ties == {v: (k[0], bool(score[v, k[0]] - score[v, k[1]] < Q.V.RESOLVER_TIE)) for v, k in want.items()}
    assert Q.hybrid_score(spark, sf_dir).count() == len(score)
