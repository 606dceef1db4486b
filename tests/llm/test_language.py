import math

import numpy as np
from llm.helpers import docs
from pyspark.sql import functions as F

from offermend.llm import language


def test_held_out_accuracy(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(frame.where(~language.held_out()))
    got = language.predict(frame.where(language.held_out()), model).where("text rlike '[a-zA-Z]{3}'").select((F.col("lang") == F.col("lang_pred")).alias("ok"), "score").collect()
    assert sum(r["ok"] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_a_document_in_two_languages_has_both(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names, logs = language.train(frame)
    texts = {r["lang"]: r["text"] for r in frame.where("lang in ('en', 'de') and length(text) between 2000 and 3000").orderBy("doc_id").limit(60).collect()}
    shares, chosen = language.infer([texts["en"] + " " + texts["de"], texts["en"]], np.exp(logs).T)
    assert {names[i] for i in np.flatnonzero(chosen[0])} == {"en", "de"} and {names[i] for i in np.flatnonzero(chosen[1])} == {"en"}
    assert 0.3 < shares[0, names.index("en")] < 0.7


def test_codes_equal_a_plain_count():
    def plain(text):
        raw = f" {text} ".encode()
        folded = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in raw]
        kept = [c for i, c in enumerate(folded) if c != 32 or i == 0 or folded[i - 1] != 32]
        return [(((a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF) >> 16) for a, b, c in zip(kept, kept[1:], kept[2:], strict=False)]

    texts = ["Hello,  World", "", "é1ß", "a"]
    got, sizes = language.codes(texts)
    assert got.tolist() == [c for t in texts for c in plain(t)] and sizes.tolist() == [len(plain(t)) for t in texts]


def test_one_language_share_is_the_likeliest(spark):
    """Without mixing, the selected language is the one with the highest likelihood."""
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names, logs = language.train(frame)
    texts = [r["text"] for r in frame.limit(50).collect()]
    shares, chosen = language.infer(texts, np.exp(logs).T)
    for t, share, some in zip(texts, shares, chosen, strict=True):
        if some.sum() == 1:
            code, _ = language.codes([t])
            assert int(share.argmax()) == int(logs[:, code].sum(axis=1).argmax())


def test_odd_rows(spark):
    rows = [(1, "the of and to in is", "en"), (2, "le la les des un", "fr"), (3, None, "en"), (4, "123 -- !", "en"), (5, "", None), (None, "the the", None), (6, "the " * 200_000, "en"), (6, "the " * 200_000, "en")]
    frame = docs(spark, rows).withColumns({"score": F.lit("mine"), "fp": F.lit(1)})
    got = language.predict(frame, language.train(frame.where("doc_id < 6"))).select("doc_id", "lang_pred", "score").collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and by[1]["lang_pred"] == "en" and by[2]["lang_pred"] == "fr" and by[6]["lang_pred"] == "en"
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (3, 4, 5))
    assert by[None]["lang_pred"] == "en" and math.isclose(by[6]["score"], 1, abs_tol=1e-6)
    empty = docs(spark, [])
    model = language.train(empty)
    assert language.predict(empty, model).count() == 0
    assert {r["lang_pred"] for r in language.predict(docs(spark, rows), model).collect()} == {"und"}
