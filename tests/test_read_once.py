"""Markup, sizes and joined rows are worked out once and written; later steps read what was written."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from offermend import fixed_values as V
from offermend import schemas
from offermend.functions.html import strip_html
from offermend.operators import detect, report
from offermend.operators.export import export_model_rows
from offermend.plans import process_offers as process
from offermend.plans.process_offers import _read_once
from offermend.plans.runs import fixture_offers, fresh_run, located, run_options
from offermend.session import staged
from offermend.sources.store import Store


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, at = tmp_path_factory.mktemp("shop"), dt.datetime(2024, 1, 1)
    parts = [(i, f"{c} ring", "b", "LARGE", 30 + i, 1.0) for i, c in enumerate(("red", "blue", "old"))]
    events = [(i, at, i, k, 1.0, "{}") for i, k in enumerate(("error", "view", "click", "signup", "error", "error"), 1)]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{path}/part.parquet")
    # one event comes three times
    spark.createDataFrame([*events, events[0], events[0]], "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return str(path)


@pytest.fixture(scope="module")
def results(spark, folder):
    return fresh_run(spark, folder)


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def _executed(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_a_run_reads_sizes_and_ages_once(results):
    rows = results
    assert V.AGE_PATTERNS[0] not in _plan(rows) and "row_key" not in _plan(rows)
    got = sorted((r.offer_id, r.action) for r in rows.collect())
    assert [o for o, _ in got] == ["1", "1", "1", "2", "3", "4", "5", "6"] and len({a for o, a in got if o == "1"}) == 1


def test_image_values_are_opened_in_place_and_turned_down_in_order(spark, folder, monkeypatch):
    fx, index, offers = located(spark, folder)
    seen = offers.selectExpr("offer_id", "inline(array(named_struct('char_input', 'Nope', 'value_input', 'red'), named_struct('char_input', 'Color', 'value_input', 'zzqq'), named_struct('char_input', 'Nope', 'value_input', 'blue')))")
    written = []
    monkeypatch.setattr(process, "staged", lambda frame: written.append(staged(frame)) or written[-1])
    rows = process.process_offers(fixture_offers(fx), index, run_options(image_values=seen.where("offer_id <> '1'").distinct()))
    long = [w for w in written if "source" in w.columns]
    assert long and not any(w.where("source = 'image'").count() for w in long)
    got = {r.offer_id: [(x.source, x.char_name, x.value_input, x.reason) for x in r.rejected] for r in rows.where("cat IS NOT NULL").collect()}
    none, unlisted = "char_not_in_characteristics", "value_not_in_values_table"
    asked = [("image", "Color", "zzqq", unlisted), ("image", "Nope", "blue", none), ("image", "Nope", "red", none)]
    assert len(got) > 2 and got.pop("1") == [] and all(v == asked for v in got.values())


def test_copies_are_numbered_apart_and_dealt_without_a_digest(spark, folder):
    fx, _, _ = located(spark, folder)
    rows = _read_once(fixture_offers(fx), run_options())
    assert "copies" not in rows.columns
    assert rows.count() == rows.select("offer_id").distinct().count() == 8


def test_detection_reads_markup_once(spark, folder):
    _, index, offers = located(spark, folder)
    rows = offers.where("cat IS NOT NULL").withColumn("visible", strip_html("description"))
    found = detect.detect(rows, index, detect.concept_names_table(spark))
    assert "ArrowEvalPython" not in _executed(found)


def test_the_first_accepted_rule_of_a_concept_counts(spark):
    rules = [detect.Rule("kind", 1, ("tee", "slim fit"), "b"), detect.Rule("kind", 0, ("top",), "a"), detect.Rule("care", 0, (), "c"), detect.Rule("kind", 2, ("wool",), "d", unless=("thin",))]
    entry = lambda n, step, value, concept="kind": (concept, step, n, "x", value)
    resolved = spark.createDataFrame(
        [("1", [entry(2, 0, "c", "care"), entry(1, 0, "a"), entry(0, 1, "b"), entry(3, 2, "d")]), ("2", [entry(0, 1, "b")])],
        "cat string, rules array<struct<concept:string,step:int,rule:int,attribute:string,value:string>>",
    )
    offers = spark.createDataFrame(
        [(1, "1", "a tee top tee", None), (2, "2", "Tee top", "x"), (3, "1", None, "is slim fit"), (4, "1", "thin wool", ""), (5, "1", "wool", ""), (6, "9", "tee", ""), (7, None, "tee", "")],
        "id int, cat string, title string, visible string",
    )
    got = {r.id: [d.value for d in r.detected] for r in detect.detect_by_words(offers, resolved, rules).collect()}
    assert got == {1: ["c", "a"], 2: ["b"], 3: ["c", "b"], 4: ["c"], 5: ["c", "d"], 6: [], 7: []}


def test_wide_rows_are_joined_once(spark, folder, results):
    fx, _, _ = located(spark, folder)
    wide = export_model_rows(fixture_offers(fx), results)
    assert "Join" not in _executed(wide) and wide.count() == 3 * 3 + 5


def test_a_log_is_read_back_without_looking_for_its_columns(spark, results, tmp_path):
    store, rows = Store(spark, str(tmp_path)), report.run_log_rows(results, ["1007", "1009", "1010"])
    store.write_run_log(rows, "r1")
    back = store.read_log("r1", schemas.RUN_LOG)
    types = lambda frame: {f.name: f.dataType.simpleString() for f in frame.schema}
    assert types(rows).items() <= types(back).items()
    shown = [c for c in rows.columns if c not in ("new_chars", "chars_reasons")]
    assert sorted(map(str, back.select(*shown).collect())) == sorted(map(str, rows.select(*shown).collect()))
    assert store.list_logs().select("run_id", "entries").collect()[0]["entries"] == rows.agg(F.count("*")).first()[0]
