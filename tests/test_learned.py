"""Ledgers of what was asked, tables of what was learned, and a second run that asks nothing known."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from offermend.operators import ledger, suggest
from offermend.operators.detect import builtin_rules
from offermend.operators.indexes import ReferenceIndex
from offermend.plans import learning
from offermend.plans.process_offers import Options, process_offers
from offermend.session import staged
from offermend.sources.learned import Learned

T = lambda s: dt.datetime(2026, 1, 1, 0, 0, s)
REPLY = "batch bigint, reply string, replied_at timestamp, timed_out boolean"


def test_category_ledger(spark):
    sent = spark.createDataFrame([(b, n, f"o{b}{n}", T(0)) for b in range(6) for n in (1, 2)], "batch bigint, line int, offer_id string, sent_at timestamp")
    replies = spark.createDataFrame(
        [(0, '{"1": "cat", "2": null, "3": "x"}', T(1), False), (1, None, T(5), True), (2, None, T(5), True), (2, '{"1": "a", "2": "b"}', T(6), False),
         (3, '{" 01 ": " dog ", "2": " "}', T(9), None), (3, '{"1": "later", "2": "later"}', T(10), False), (4, "no json", T(1), False), (9, '{"1": "x"}', T(1), False)], REPLY
    )
    rows = ledger.category_ledger(sent, replies)
    got = {r.offer_id: (r.state, r.suggested) for r in rows.collect()}
    assert got == {
        "o01": ("answered", "cat"), "o02": ("missing", None), "o11": ("timed_out", None), "o12": ("timed_out", None), "o21": ("late", "a"), "o22": ("late", "b"),
        "o31": ("answered", "dog"), "o32": ("missing", None), "o41": ("missing", None), "o42": ("missing", None), "o51": ("sent", None), "o52": ("sent", None),
    }
    assert {r.offer_id: r.suggested for r in ledger.category_answers(rows).collect()} == {
        "o01": "cat", "o31": "dog", "o11": "__timeout__", "o12": "__timeout__", "o21": "__timeout__", "o22": "__timeout__"
    }
    assert {r.offer_id: r.state for r in ledger.category_ledger(sent, replies, 8).where("batch = 3").collect()} == {"o31": "late", "o32": "late"}
    assert {(r.state, r.n) for r in ledger.ledger_summary(rows).collect()} == {("answered", 2), ("missing", 4), ("timed_out", 2), ("late", 2), ("sent", 2)}
    assert ledger.category_ledger(sent.limit(0), replies).count() == 0 and ledger.category_ledger(sent, replies.limit(0)).where("state <> 'sent'").count() == 0


def test_field_ledger(spark):
    fields = spark.createDataFrame(
        [("o", "Tip:", 1), ("o", "Tip", 2), ("o", "Culoare:", 3), ("o", "Sezon:", 4), ("p", "Culoare:", 1), ("q", "Culoare:", 1)], "offer_id string, char_name string, position int"
    )
    replies = spark.createDataFrame(
        [("o", '{"Tip": "lung", "Culoare:": "Alb", "Sezon": " ", "Altul": "x"}', T(1), False), ("p", None, T(2), True), ("z", '{"a": "b"}', T(1), False)],
        "offer_id string, reply string, replied_at timestamp, timed_out boolean",
    )
    rows = ledger.field_ledger(suggest.display_names(fields), replies)
    got = {(r.offer_id, r.char_input): (r.value_input, r.state) for r in rows.collect()}
    assert got[("o", "Culoare:")] == ("Alb", "answered") and got[("o", "Sezon:")] == (None, "missing") and got[("o", "Altul")] == ("x", "unasked")
    assert got[("p", "Culoare:")] == (None, "timed_out") and got[("q", "Culoare:")] == (None, "sent") and ("z", "a") not in got
    assert ("lung", "answered") in (got[("o", "Tip")], got[("o", "Tip:")])
    assert ("o", "Altul") in {(r.offer_id, r.char_input) for r in ledger.field_answers(rows).collect()}


def _categories(spark, rows):
    return spark.createDataFrame(rows, "key string, category string")


def _table(frame):
    return {r.key: r.category for r in frame.collect()}


def test_learned_tables(spark, tmp_path):
    store = Learned(spark, str(tmp_path / "learned"), buckets=4)
    assert _table(store.read("categories")) == {} and store.compact().snapshot is None
    store.publish({"categories": _categories(spark, [("a", "1"), ("b", "1"), (None, "x")])})
    first = store.compact()
    assert first.snapshot and first.changes == () and _table(store.read("categories")) == {"a": "1", "b": "1"}
    # two writers that know nothing of each other lose nothing
    other = Learned(spark, str(tmp_path / "learned"))
    store.publish({"categories": _categories(spark, [("b", "2"), ("c", "2")])})
    other.publish({"categories": _categories(spark, [("c", "3"), ("d", "3")])})
    now = {"a": "1", "b": "2", "c": "3", "d": "3"}
    assert _table(store.read("categories")) == now == _table(other.read("categories"))
    keys = spark.createDataFrame([("a",), ("c",), ("c",), ("z",), (None,)], "key string")
    assert _table(store.lookup("categories", keys)) == {"a": "1", "c": "3"}
    # a run that fails before it publishes is not seen, nor is a part of it
    with pytest.raises(Exception):
        store.publish({"categories": _categories(spark, [("a", "9")]), "rules": _categories(spark, [("k", "9")])})
    assert _table(store.read("categories")) == now
    # a reader that holds an older version goes on reading it
    assert _table(store.read("categories", first)) == {"a": "1", "b": "1"}
    # two snapshots of different state: the one that folds more counts, and nothing is folded twice or left out
    store.compact()
    other.publish({"categories": _categories(spark, [("a", "4")])})
    assert _table(store.read("categories")) == {**now, "a": "4"} and len(store.version().changes) == 1
    # rules keep what was learned first
    rule = lambda c: spark.createDataFrame([("k", "", c, 1)], "key string, exclude string, category string, ordinal bigint")
    store.publish({"rules": rule("first")})
    store.publish({"rules": rule("second")})
    assert _table(store.read("rules")) == {"k": "first"}


def test_a_lookup_leaves_the_snapshot_where_it_is(spark, tmp_path):
    store = Learned(spark, str(tmp_path / "learned"), buckets=4)
    store.publish({"categories": _categories(spark, [(str(n), "1") for n in range(100)])})
    store.compact()
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = store.lookup("categories", spark.range(50).select(F.col("id").cast("string").alias("key")))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 50 and "Bucketed: true" in plan
        # one exchange deals the asked keys, which their distinct needs anyway; none moves the snapshot
        assert plan.count("Exchange hashpartitioning") == 1, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)


@pytest.fixture(scope="module")
def index(spark):
    cats = spark.createDataFrame([("1", "c1", "Tricouri", 0), ("2", "c2", "Pantofi", 1)], "category_id string, external_id string, category_name string, ordinal bigint")
    names = [("10", "1", "Culoare:", True, 0), ("11", "1", "Marime:", True, 1), ("12", "1", "Stil:", False, 2), ("20", "2", "Culoare:", True, 3)]
    chars = spark.createDataFrame(
        [(a, a, c, n, m, True, o) for a, c, n, m, o in names],
        "characteristic_id string, external_characteristic_id string, category_id string, characteristic_name string, mandatory boolean, restrictive boolean, ordinal bigint",
    )
    values = [("1", "10", "Culoare:", "Negru"), ("1", "10", "Culoare:", "Alb"), ("1", "11", "Marime:", "M"), ("1", "12", "Stil:", "Lejer"), ("2", "20", "Culoare:", "Rosu")]
    vals = spark.createDataFrame([(*v, n) for n, v in enumerate(values)], "category_id string, characteristic_id string, characteristic_name string, value string, ordinal bigint")
    return ReferenceIndex.build(cats, chars, vals).persist()


OFFER = "offer_id string, title string, error string, description string, category string, ean string, brand string, existing_chars map<string,string>"


def _offers(spark):
    return spark.createDataFrame(
        [
            ("o1", "Haina frumoasa lunga", "1009 - x", None, "Tricouri", "e1", "B", {"Marime:": "M"}),
            ("o1", "Haina frumoasa lunga", "1009 - x", None, "Tricouri", "e1", "B", {"Marime:": "M"}),  # a repeated row
            ("o2", "Haina scurta", "1009 - x", None, "Tricouri", None, None, {}),
            (None, "Haina scurta cu gluga", "1009 - x", None, "Tricouri", "e1", None, {"Marime:": "M"}),  # no id: takes what is known
            ("o3", "Obiect necunoscut oarecare", "1007 - x", None, "", None, "B", {}),
            ("o4", "Alt lucru", "1007 - x", None, "Nimic", None, None, {}),
            ("o5", None, "1007 - x", None, "", None, None, {}),
        ],
        OFFER,
    )


def _model(spark, asked):
    """Replies of a model that knows the category of one title and a colour for every request."""
    lines = suggest.batches(asked.titles).select("batch", "line", "offer_id", "title").collect()
    told = {}
    for r in lines:
        told.setdefault(r.batch, {})[str(r.line)] = "PANTOFI" if "necunoscut" in r.title else "Nimicuri"
    replies = spark.createDataFrame([(b, json.dumps(v), T(1), False) for b, v in told.items()], REPLY)
    sent = suggest.batches(asked.titles)
    fields = asked.fields.groupBy("offer_id").agg(F.min("cat").alias("cat")).collect()
    said = [(r.offer_id, json.dumps({"Culoare": "rosu" if r.cat == "c2" else "alb", "Marime": "XXXXXXXX"}), T(1)) for r in fields]
    values = spark.createDataFrame(said, "offer_id string, reply string, replied_at timestamp")
    return ledger.category_ledger(sent, replies), ledger.field_ledger(asked.fields, values)


def _ask(spark, offers, index, store):
    options = learning.recall(offers, store, Options(marketplace="shop", use_model=True, fuzzy=False, rules=builtin_rules()[:1]))
    return options, learning.requests(offers, process_offers(offers, index, options), index, store, options)


@pytest.fixture
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_second_run_asks_nothing_known(spark, one_partition, index, tmp_path):
    store = Learned(spark, str(tmp_path / "learned"), buckets=2)
    offers = _offers(spark)
    options, asked = _ask(spark, offers, index, store)
    assert {r.title for r in asked.titles.collect()} == {"Obiect necunoscut oarecare", "Alt lucru"}
    assert {r.title for r in asked.attributes.collect()} == {"Haina frumoasa lunga", "Haina scurta"}
    titles, fields = _model(spark, asked)
    results = staged(process_offers(offers, index, learning.answered(options, offers, asked, titles, fields)))
    got = {r.title: r for r in results.collect()}
    assert got["Obiect necunoscut oarecare"].new_category == "Pantofi" and got["Alt lucru"].new_category == ""
    assert got["Haina frumoasa lunga"].new_chars["Culoare:"] == "Alb" and got["Haina frumoasa lunga"].sources["Culoare:"] == "suggestion"
    learning.learn(store, offers, results, asked, index, titles, options, "r1")
    store.compact()
    assert _table(store.read("categories")) and {r.key for r in store.read("rules").collect()} == {"obiect, necunoscut, oarecare"}
    known = [(r.ean, r.final_attributes, r.confidence) for r in store.read("knowledge").collect()]
    assert known == [("e1", {"Culoare:": "Alb"}, 0.5)]  # Culoare: and Stil: were asked for

    # known titles, requests and products are not asked about again: only the title that nobody knew, the attributes of
    # the offer whose category is known by now, and what is not known of another offer of a known product
    more = offers.unionByName(spark.createDataFrame([("o9", "Haina altfel", "1009 - x", None, "Tricouri", "e1", "B", {"Marime:": "M"})], OFFER))
    options, asked = _ask(spark, more, index, store)
    assert {r.title for r in asked.titles.collect()} == {"Alt lucru"}
    assert {(r.title, r.char_name) for r in asked.attributes.join(asked.fields, "offer_id").collect()} == {("Obiect necunoscut oarecare", "Culoare:"), ("Haina altfel", "Stil:")}
    results = process_offers(more, index, learning.answered(options, more, asked, None, None))
    again = {r.title: (r.new_category, r.new_chars, r.sources) for r in results.collect()}
    assert again["Haina frumoasa lunga"] == ("Tricouri", {"Culoare:": "Alb"}, {"Culoare:": "knowledge"}) == again["Haina altfel"] == again["Haina scurta cu gluga"]
    assert again["Haina scurta"] == ("Tricouri", {"Culoare:": "Alb"}, {"Culoare:": "suggestion"})
    assert again["Obiect necunoscut oarecare"][0] == "Pantofi" and again["Alt lucru"][0] == ""


def test_nothing_to_learn_from(spark, one_partition, index, tmp_path):
    store = Learned(spark, str(tmp_path / "learned"))
    none = _offers(spark).limit(0)
    options = learning.recall(none, store, Options(marketplace="shop"))
    first = process_offers(none, index, options)
    asked = learning.requests(none, first, index, store, options)
    assert asked.titles.count() == asked.attributes.count() == asked.cached.count() == 0
    learning.learn(store, none, first, asked, index, None, options, "r")
    assert store.read("knowledge").count() == 0 and len(store.version().changes) == 1
