"""Rows of attributes are dealt by offer once and not shuffled again; what is looked up is broadcast."""

import datetime as dt

from pyspark.sql import functions as F

from offermend.operators import ledger, suggest
from offermend.operators.indexes import ReferenceIndex
from offermend.plans.registry import QUERIES


def _shuffles(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [line.split("Exchange ")[1] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]


def _index(spark):
    cats = spark.createDataFrame([("1", "1", "Tops", 1)], "category_id string, external_id string, category_name string, ordinal bigint")
    chars = spark.createDataFrame(
        [("a", "1", "Color:", True, 1), ("b", "1", "Size", False, 2)],
        "characteristic_id string, category_id string, characteristic_name string, mandatory boolean, ordinal bigint",
    ).withColumns({"restrictive": F.lit(True), "external_characteristic_id": F.lit(None).cast("string")})
    values = spark.createDataFrame(
        [("1", "Color:", "red"), ("1", "Color:", "blue"), ("1", "Size", "M")], "category_id string, characteristic_name string, value string"
    )
    return ReferenceIndex.build(cats, chars, values)


def _fields(spark):
    offers = spark.createDataFrame([("o1", "1"), ("o1", "1"), ("o2", "1"), (None, "1")], "offer_id string, cat string")
    filled = spark.createDataFrame(
        [("o1", "Color:", "x"), ("o1", None, "x"), ("o2", "Size", ""), (None, "Size", "M")], "offer_id string, char_input string, value_input string"
    )
    index = _index(spark)
    return suggest.prompt_fields(suggest.fillable_options(offers, filled, index), index)


def test_missing_attributes_are_told_apart_by_offer(spark):
    fields = suggest.display_names(_fields(spark))
    assert all(s.startswith("hashpartitioning(offer_id#") and s.count("#") == 1 for s in _shuffles(fields)), _shuffles(fields)
    got = sorted((str(r.offer_id), r.char_name, r.mandatory, r.position, tuple(r.options)) for r in fields.collect())
    assert got == [
        ("None", "Color:", True, 1, ("blue", "red")), ("None", "Size", False, 2, ("M",)), ("o1", "Size", False, 1, ("M",)), ("o1", "Size", False, 2, ("M",)),
        ("o2", "Color:", True, 1, ("blue", "red")), ("o2", "Size", False, 2, ("M",)),
    ]


def test_names_that_were_not_asked_are_found_by_offer(spark):
    fields = suggest.display_names(_fields(spark).where("offer_id = 'o2'"))
    replies = spark.createDataFrame(
        [("o2", '{"Color": "red", "Extra": "x"}', dt.datetime(2026, 1, 1)), ("o9", '{"Extra": "x"}', dt.datetime(2026, 1, 1))],
        "offer_id string, reply string, replied_at timestamp",
    )
    rows = ledger.field_ledger(fields, replies)
    assert all(s.count("#") == 1 for s in _shuffles(rows)), _shuffles(rows)
    got = sorted((r.offer_id, r.char_input, r.value_input, r.state) for r in rows.collect())
    assert got == [("o2", "Color:", "red", "answered"), ("o2", "Extra", "x", "unasked"), ("o2", "Size", None, "missing")]


def test_schema_rows_are_not_shuffled(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    parts = [(i, f"{c} ring", "b", "LARGE", i, 1.0) for i, c in enumerate(("red", "blue", "old"))]
    events = [(i, at, i, "error", 1.0, "{}") for i in range(1, 6)]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(events, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    rows = QUERIES["json_schema"](spark, str(tmp_path))
    wide = [s for s in _shuffles(rows) if not s.startswith("hashpartitioning(offer_id#") and "p_partkey" not in s]
    assert not wide, wide
    assert rows.count() == 5 and '"enum":["blue","red"]' in rows.first()["schema"].replace(" ", "")
