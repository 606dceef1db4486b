"""Import, files, offer repair, streams, stores and exports on hand-made tables."""

import csv
import datetime as dt
import io
import random

import pytest
from pyspark.sql import functions as F

from offermend import schemas
from offermend.operators import export, knowledge, report, suggest, vision
from offermend.operators.indexes import ReferenceIndex
from offermend.plans.import_marketplace import import_marketplace
from offermend.plans.process_offers import Options, process_offers
from offermend.sources import store as stores
from offermend.sources import splits, tabular
from offermend.streaming import jobs

CATS = "id,emag_id,name,parent_id\n1,2819.0,Tricouri,\n2,2820,Pantofi,\n,9,Nameless,\n"
CHARS = "id,category_id,name,mandatory\n10,2819,Culoare:,1\n11,1,Marime:,1\n20,2,Culoare:,0\n30,77,Lost,0\n"
VALS = "category_id,characteristic_id,characteristic_name,value\n,10,,Negru\n1,10,Culoare,Alb\n,20,,Rosu\n1,11,Marime:,M\n2,20,Culoare:,\n"
OFFERS = (
    "id intern oferta,nume,categorie,eroare oferta,descriere,Offer ch. 1 name,Offer ch. 1 val.,Offer ch. 2 name,Offer ch. 2 val.\n"
    "o1,Tricou negru - M,Tricouri,1009 - x,,Culoare:,Verde,Alt,foo\n"
    "o2,Tricou alb,tricouri,1010 - x,,Culoare:,ALB,,\n"
    "o3,Ceva,Nimic,1007 - x,,,,,\n"
    "o4,Ceva,Tricouri,2001 - x,,,,,\n"
)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    for name, text in (("cats.csv", CATS), ("chars.csv", CHARS), ("vals.csv", VALS), ("offers.csv", OFFERS), ("t.tsv", "A\tB\n1\t2\n")):
        (folder / name).write_text(text, encoding="utf-8")
    return folder


@pytest.fixture(scope="module")
def tables(spark, files):
    read = lambda n: tabular.read_tabular(spark, str(files / n))
    return tabular.load_categories(read("cats.csv")), tabular.load_characteristics(read("chars.csv")), tabular.load_values(read("vals.csv"))


def test_files(spark, files, tables):
    cats, chars, vals = tables
    assert cats.count() == 2 and chars.where("restrictive").count() == 4 and vals.count() == 4
    assert tabular.read_tabular(spark, str(files / "t.tsv")).columns == ["A", "B"]
    a = spark.createDataFrame([("1", "2")], "x string, y string")
    sql = spark.createDataFrame([("1",)], "`select * from t` string")
    got = tabular.concat_same_schema([("q", sql), ("one", a), ("two", a), ("other", a.select("x"))])
    assert got.rows.count() == 2 and got.skipped == ["q", "other"]
    assert tabular.autodetect_external_id(["id", "Allegro_ID", "x"], ["id"]) == "Allegro_ID"


def test_offers_file(spark, files):
    offers = tabular.read_offers(tabular.read_tabular(spark, str(files / "offers.csv")))
    rows = {r.offer_id: r for r in offers.collect()}
    assert rows["o1"].existing_chars == {"Culoare:": "Verde", "Alt": "foo"} and rows["o3"].existing_chars == {}
    assert [rows[f"o{i}"].ordinal for i in (1, 2, 3, 4)] == [0, 1, 2, 3]
    twice = spark.createDataFrame([("a", "1", "a", "2", "nan", "3")], "n1 string, v1 string, n2 string, v2 string, n3 string, v3 string")
    folded = twice.select(tabular.fold_existing_chars([("n1", "v1"), ("n2", "v2"), ("n3", "v3")])).first()[0]
    assert folded == {"a": "2"}


@pytest.fixture(scope="module")
def imported(spark, tables, tmp_path_factory):
    store = stores.Store(spark, str(tmp_path_factory.mktemp("store")))
    import_marketplace(store, "shop", *tables)
    return store


def test_import(spark, tables, imported):
    loaded = imported.load_marketplace("shop")
    values = {(r.category_id, r.characteristic_name, r.value) for r in loaded["characteristic_values"].collect()}
    assert values == {("1", "Culoare:", "Negru"), ("1", "Culoare", "Alb"), ("2", "Culoare:", "Rosu"), ("1", "Marime:", "M")}
    assert {r.category_id for r in loaded["characteristics"].collect()} == {"1", "2", "77"}
    kinds = {r.issue_type for r in imported.read("import_issues").collect()}
    assert {"orphan_characteristic", "orphan_value"} <= kinds
    import_marketplace(imported, "other", *tables)
    import_marketplace(imported, "shop", *tables)
    assert imported.load_marketplace("shop")["characteristic_values"].count() == 4
    with pytest.raises(Exception):
        import_marketplace(imported, "shop", tables[0], tables[1], tables[2].drop("value"))
    assert imported.read("import_runs").where("status = 'failed' AND notes IS NOT NULL").count() == 1
    assert imported.load_marketplace("shop")["categories"].count() == 2
    imported.clear_marketplace("other")
    assert imported.load_marketplace("other")["categories"].count() == 0
    imported.upsert_marketplace("shop", "Shop")
    imported.upsert_marketplace("shop", "Shop HU")
    assert [r.marketplace_name for r in imported.marketplaces().collect()] == ["Shop HU"]


@pytest.fixture(scope="module")
def index(imported):
    loaded = imported.load_marketplace("shop")
    return ReferenceIndex.build(loaded["categories"], loaded["characteristics"], loaded["characteristic_values"]).persist()


@pytest.fixture(scope="module")
def offers(spark, files):
    return tabular.read_offers(tabular.read_tabular(spark, str(files / "offers.csv")))


@pytest.fixture(scope="module")
def results(offers, index):
    return process_offers(offers, index, Options()).persist()


def test_repair(results):
    got = {r.offer_id: r for r in results.collect()}
    assert sorted(got["o1"].cleared) == ["Alt", "Culoare:"] and got["o1"].new_chars == {"Marime:": "M"}
    assert got["o1"].missing_mandatory == ["Culoare:"] and got["o1"].action == "updated" and got["o1"].needs_manual
    assert got["o2"].cleared == [] and got["o2"].missing_mandatory == ["Marime:"] and got["o2"].new_category == "tricouri"
    assert got["o3"].needs_manual and got["o3"].category_reason and got["o3"].action == "skip"
    assert not got["o4"].needs_manual and got["o4"].action == "skip" and got["o4"].new_chars == {}


def test_repair_with_suggestions(spark, offers, index):
    said = spark.createDataFrame(
        [("o1", 0, "Culoare", "negru"), ("o2", 0, "Marime", "XXXXXXXX"), ("o3", 0, "Culoare", "alb")], "offer_id string, position int, char_input string, value_input string"
    )
    cats = spark.createDataFrame([("o3", "TRICOURI ")], "offer_id string, suggested string")
    rows = process_offers(offers, index, Options(suggestions=said, category_suggestions=cats, use_model=True)).collect()
    got = {r.offer_id: r for r in rows}
    assert got["o1"].new_chars == {"Culoare:": "Negru", "Marime:": "M"} and not got["o1"].needs_manual
    assert [x.char_name for x in got["o2"].review] == ["Marime"] and got["o2"].missing_mandatory == ["Marime:"]
    assert got["o3"].action == "cat_assigned" and got["o3"].new_category == "Tricouri" and got["o3"].new_chars == {"Culoare:": "Alb"}


def test_repair_with_images_and_knowledge(spark, offers, index, tmp_path):
    seen = spark.createDataFrame(
        [("o1", "Culoare", "alb"), ("o1", "Marime", "M"), ("o2", "Marime", "qqqqqqqq"), ("o2", "Sclipici", "da"), ("o2", "Culoare", "Negru"), ("o2", "Alt", " "), ("o3", "Culoare", "alb"), ("o9", "Culoare", "alb")],
        "offer_id string, char_input string, value_input string",
    )
    hints = spark.createDataFrame(
        [("o1", "Pantofi", 0.9), ("o1", "Tricouri", 0.4), ("o2", "Elicopter", 0.9), ("o3", "Pantofi", 0.9)], "offer_id string, image_candidate string, image_confidence double"
    )
    options = Options(image_values=seen, image_hints=hints)
    got = {r.offer_id: r for r in process_offers(offers, index, options).collect()}
    assert got["o1"].new_chars == {"Culoare:": "Alb", "Marime:": "M"} and got["o1"].rejected == []
    assert got["o1"].new_category == "Pantofi" and got["o1"].fusion_reason == "prefer_image: strong_image"
    assert got["o1"].image_analysis.hint == "Pantofi" and got["o1"].image_analysis.proposed == {"Culoare": "alb", "Marime": "M"}
    assert [tuple(x) for x in got["o2"].rejected] == [
        ("image", "Marime", "qqqqqqqq", "value_not_in_values_table"), ("image", "Sclipici", "da", "char_not_in_characteristics")
    ]
    # a kept value stays, an unknown hint changes nothing, offers without category have no image stage
    assert got["o2"].new_chars == {} and got["o2"].new_category == "tricouri" and got["o2"].fusion_reason is None
    assert got["o3"].image_analysis is None and got["o3"].new_category == "" and got["o4"].image_analysis is None
    only = {r.offer_id: r for r in process_offers(offers, index, Options(image_values=seen, image_suggestion_only=True)).collect()}
    assert only["o1"].new_chars == {"Marime:": "M"} and only["o2"].rejected == [] and only["o1"].image_analysis.proposed["Culoare"] == "alb"

    stored = spark.createDataFrame(
        [(None, "b", "tricou alb", "shop", "x", "Tricouri", {"Marime": "M", "Culoare": "Negru", "Lost": "1"}, 1.0, "r1", dt.datetime(2024, 1, 1))], schemas.PRODUCT_KNOWLEDGE
    )
    branded = offers.withColumn("brand", F.lit("b"))
    again = {r.offer_id: r for r in process_offers(branded, index, Options(knowledge=stored, marketplace="shop")).collect()}
    assert again["o2"].new_chars == {"Marime:": "M"} and not again["o2"].needs_manual and again["o1"].new_chars == {"Marime:": "M"}
    assert [tuple(x) for x in again["o2"].rejected] == [("knowledge", "Lost", "1", "char_not_in_characteristics")]


def test_offers_are_read_once(spark, offers, index, tmp_path):
    offers.write.parquet(str(tmp_path / "offers"))
    rows = process_offers(spark.read.parquet(str(tmp_path / "offers")), index, Options())
    assert str(tmp_path / "offers") not in rows._jdf.queryExecution().toString()
    assert not any(str(tmp_path / "offers") in f for f in rows.inputFiles())


def test_exports(spark, offers, results):
    wide = export.export_model_rows(offers, results)
    first = {r["Internal ID"]: r for r in wide.collect()}
    assert first["o1"]["Characteristic Name"] == "Marime:" and first["o1"]["Characteristic Value.1"] is None and wide.columns[5] == "Characteristic Name"
    slots = F.array(*[F.struct(F.lit(n).cast("string").alias("name"), F.lit(v).cast("string").alias("value")) for n, v in (("Culoare:", "Verde"), (None, None), (None, None))])
    kept = {r.offer_id: r for r in export.export_original_rows(offers.where("offer_id = 'o1'").withColumn("slots", slots), results, 3).collect()}["o1"]
    assert (kept["Offer ch. 1 val."], kept["Offer ch. 2 name"], kept["Offer ch. 2 val."], kept["Offer ch. 3 name"]) == (None, "Marime:", "M", "Culoare:")
    tags = {(r.offer_id, r.field, r.tag) for r in export.change_tags(offers, results).collect()}
    assert {("o1", "Marime:", "new"), ("o1", "Alt", "cleared"), ("o3", "row", "manual"), ("o2", "Marime:", "missing")} <= tags


def test_streams(spark, offers, index, results, tmp_path):
    folder = str(tmp_path / "in")
    rows = offers.select(*[F.col(f.split()[0]) for f in schemas.OFFERS.replace("map<string,string>", "map").split(", ")])
    rows.where("offer_id < 'o3'").coalesce(1).write.parquet(folder)
    rows.where("offer_id >= 'o3'").coalesce(1).write.mode("append").parquet(folder)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for _ in range(2):  # the second start finds nothing new
        jobs.process_offers_stream(jobs.offer_stream(spark, folder, files_per_batch=1), index, out, mark).awaitTermination()
    streamed = spark.read.parquet(out)
    assert streamed.select("batch_id").distinct().count() == 2
    key = lambda r: (r.offer_id, r.action, sorted(r.cleared), r.new_chars, r.missing_mandatory)
    assert sorted(map(key, streamed.collect()), key=str) == sorted(map(key, results.collect()), key=str)
    events = jobs.offer_stream(spark, folder).select("offer_id", F.lit(dt.datetime(2026, 1, 2)).alias("ts"))
    jobs.log_stream(events, str(tmp_path / "log"), str(tmp_path / "logmark")).awaitTermination()
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_run_store(spark, results, tmp_path):
    store = stores.Store(spark, str(tmp_path))
    store.save_run(results, "shop", "r1")
    store.save_run(results.limit(1), "shop", "r2")
    assert store.last_run("shop").count() == 1
    store.write_run_log(report.run_log_rows(results, ["1007", "1009", "1010"]), "r1")
    assert store.list_logs().first()["entries"] == 3 and store.read_log("r1").count() == 3
    assert store.expire("run_logs", 7) == []
    later = dt.date.today() + dt.timedelta(days=9)
    assert len(store.expire("run_logs", 7, later)) == 1
    empty = store.spark.createDataFrame([("a",)], "x string")
    stores.write_reference_set({"categories": empty, "characteristics": empty, "values": empty}, str(tmp_path / "sets" / "Shop"))
    assert stores.read_reference_set(spark, str(tmp_path / "sets" / "Shop"))["values"].count() == 1
    registry = spark.createDataFrame([("Other",)], "marketplace_name string")
    assert [tuple(r) for r in stores.discover_marketplaces(spark, str(tmp_path / "sets"), registry).collect()] == [("Shop", False)]
    a = spark.createDataFrame([("categories", 5), ("values", 100)], "what string, n int")
    b = spark.createDataFrame([("categories", 5), ("values", 90)], "what string, n int")
    assert {r.what: r.ok for r in stores.reconcile_counts(a, b).collect()} == {"categories": True, "values": False}


def test_knowledge_round_trip(spark):
    cols = "ean string, brand string, normalized_title string, marketplace_id string, offer_id string, category string, final_attributes map<string,string>, confidence double, run_id string, updated_at timestamp"
    t = lambda d: dt.datetime(2026, 1, d)
    old = spark.createDataFrame([("1", "b", "t", "m", "o1", "c", {"a": "x"}, 0.5, "r", t(1)), (None, "b", "t", "m", "o2", "c", {"a": "y"}, 0.5, "r", t(1))], cols)
    new = spark.createDataFrame([("1", "b", "t", "m", "o3", "c", {"a": "z"}, 0.9, "r", t(2))], cols)
    stored = knowledge.knowledge_upsert(old, new)
    asked = spark.createDataFrame([("q1", "1", "b", "t", "m"), ("q2", None, "b", "t", "m"), ("q3", "9", "b", "t", "m")], "offer_id string, ean string, brand string, normalized_title string, marketplace_id string")
    got = {r.offer_id: r.final_attributes["a"] for r in knowledge.knowledge_lookup(asked, stored).collect()}
    assert got == {"q1": "z", "q2": "y"}


def test_fusion_policies(spark):
    s = spark.createDataFrame([("Tricouri", 0.5, "Pantaloni", 0.6)], "text_candidate string, text_confidence double, image_candidate string, image_confidence double")
    rule = lambda p: vision.fuse_category(s, p).first()
    assert rule("prefer_text").final_category == "Tricouri" and rule("prefer_image").final_category == "Pantaloni"
    assert rule("review").needs_review and abs(rule("review").final_confidence - 0.48) < 1e-9


def test_replies(spark):
    from offermend.functions.replies import parse_json_reply

    texts = ['```json\n{"a": "1", "_reasoning": "x"}\n```', 'so: {"a": ["x", "y"]} end', "no json", "[1]", '{"a": {"b": 1}}']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_json_reply("t").alias("m")).collect()
    assert [r.m for r in rows] == [{"a": "1"}, {"a": '["x","y"]'}, {}, {}, {"a": '{"b":1}'}]
    fields = spark.createDataFrame([("o", "Tip:", 1), ("o", "Tip", 2)], "offer_id string, char_name string, position int")
    assert {r.char_name: r.display for r in suggest.display_names(fields).collect()} == {"Tip:": "Tip", "Tip": "Tip"}


def test_blank_and_repeated_ids_are_offers_of_their_own(offers, index, results):
    from pyspark.sql import functions as F

    one = offers.where("offer_id = 'o1'")
    other = offers.where("offer_id = 'o2'").withColumn("offer_id", F.lit("o1"))
    blank = one.withColumn("offer_id", F.lit(None).cast("string"))
    alone = {r.title: r for r in results.where("offer_id IN ('o1', 'o2')").collect()}
    rows = process_offers(one.union(other).union(blank).union(blank), index, Options()).collect()
    titles = [one.first().title, other.first().title]
    assert sorted((r.offer_id or "", r.title) for r in rows) == sorted([("", titles[0]), ("", titles[0]), ("o1", titles[0]), ("o1", titles[1])])
    for r in rows:
        assert (r.kept, r.new_chars, r.cleared) == (alone[r.title].kept, alone[r.title].new_chars, alone[r.title].cleared)


def test_cells_with_line_breaks_and_row_numbers(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text('id,text\n1,"first\nsecond"\n2,plain\n')
    rows = tabular.with_ordinal(tabular.read_tabular(spark, str(path))).collect()
    assert [(r.id, r.text, r.ordinal) for r in rows] == [("1", "first\nsecond", 0), ("2", "plain", 1)]


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    """Rows equal those of a single-task reader wherever the byte ranges are cut, and are numbered in file order."""
    rng = random.Random(12)
    cells = ["plain", "", "with, comma", 'a "quoted" word', "line\nbreak", "crlf\r\nin it", "\n\n", '"', "é ß 日本", "x" * 90, 'say ""', ",", '5" screen']
    for line_end in ("\n", "\r\n"):
        files = []
        for k in range(2):
            rows = [[str(1000 * k + i), rng.choice(cells), rng.choice(cells)] for i in range(60)]
            out = io.StringIO()
            writer = csv.writer(out, lineterminator=line_end)
            writer.writerows([["id", "a.b", "c"], *rows])
            text = out.getvalue().replace("plain" + line_end, "plain" + line_end + line_end)  # blank lines between rows
            folder = tmp_path / f"many{len(line_end)}.csv"
            folder.mkdir(exist_ok=True)
            (folder / f"part-{k}.csv").write_bytes(text.encode())
            files += rows
        for size in (37, 150, 10**6):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            frame = tabular.read_tabular(spark, str(folder), numbered=True)
            got = sorted(frame.collect(), key=lambda r: r.ordinal)
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
            assert [[r["id"], r["a.b"] or "", r["c"] or ""] for r in got] == files, (line_end, size)
            assert len({r.ordinal for r in got}) == len(files)
            alone = spark.read.csv(str(folder), header=True, multiLine=True, escape='"').collect()
            plain = lambda r: tuple(x and x.replace("\r\n", "\n") for x in tuple(r)[:3])  # noqa: E731 - that reader turns line ends into LF
            assert sorted(map(plain, alone), key=repr) == sorted(map(plain, got), key=repr)
    bad = tmp_path / "bad.csv"
    bad.write_bytes(b"\n\r\nid,text\n1,a\xffb\n\n2\n3,c,d")
    assert [tuple(r) for r in tabular.read_tabular(spark, str(bad)).collect()] == [("1", "a\ufffdb"), ("2", None), ("3", "c")]
    empty = tmp_path / "empty.csv"
    empty.write_bytes(b"id,text\n")
    assert tabular.read_tabular(spark, str(empty)).count() == 0


def test_line_states():
    for line, outside in ((b"a,b", False), (b'"a,b', True), (b'a"b,c', False), (b'"a""b"', False), (b'"a"b",c', False), (b'","', False), (b'"', True), (b'""', False)):
        assert splits.ends_inside(line, False, b",") == outside, line
    assert splits.ends_inside(b'x",y', True, b",") is False and splits.ends_inside(b'x""', True, b",") is True


def test_small_lookups_do_not_shuffle_the_offers(spark, offers, index):
    seen = offers.select("offer_id", F.explode(F.array(F.lit("Culoare:"), F.lit("Nope"))).alias("char_input"), F.lit("Alb").alias("value_input"))
    hints = offers.select("offer_id", F.lit("Pantofi").alias("image_candidate"), F.lit(0.9).alias("image_confidence"))
    plan = process_offers(offers, index, Options(image_values=seen, image_hints=hints))._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert len(shuffles) == 2 and all("hashpartitioning(offer_id" in line for line in shuffles), shuffles


def test_image_shows_the_least_value_of_an_attribute(spark, offers, index):
    seen = spark.createDataFrame(
        [("o1", "Culoare:", "Negru"), ("o1", "Culoare:", "Alb"), ("o1", "Culoare:", None), ("o1", "Alt", None), ("o1", "Alt", "b"), ("o1", "Gol", None), ("x", "Alt", "a")],
        "offer_id string, char_input string, value_input string",
    )
    got = {r.offer_id: r for r in process_offers(offers.union(offers), index, Options(image_values=seen)).collect()}
    assert got["o1"].image_analysis.proposed == {"Culoare:": "Alb", "Alt": "b", "Gol": None} and got["o2"].image_analysis is None
    assert got["o1"].new_chars["Culoare:"] == "Alb" and got["o1"].sources["Culoare:"] == "image"
