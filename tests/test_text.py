"""Text functions against the standard library, on every assigned part of Unicode and on samples."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from offermend.functions import text as T
from offermend.functions.html import visible_text

SAMPLES = [
    "Mărime:", "  Culoare:  ", "CULOARE:", "Straße", "İzmir", "ŞOSETE", "ﬁne ①", "Türkiz", "Μαύρο", "Albastru-Închis", "off-white", "red/white",
    "Samsung Galaxy S24 128GB Negru!", "한국어", "", "  ", "a b", "Größe::", "x²_y", "tie-dye, 100%", "ＦＵＬＬ",
]


def py_norm(s):
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower().strip()


def py_char(s):
    s = re.sub(r"\s+", " ", s.strip()).rstrip(":").strip().casefold()
    return py_norm(s)


def py_color(s):
    s = unicodedata.normalize("NFKD", s.strip().lower())
    s = "".join(c for c in s if not unicodedata.combining(c))
    s = re.sub(r"[-/_.,;:]+", " ", s)
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", s)).strip()


def py_title(s):
    s = unicodedata.normalize("NFD", s.lower().strip())
    s = "".join(c for c in s if unicodedata.category(c) != "Mn")
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", s)).strip()


def test_normal_forms(spark):
    rng = random.Random(1)
    # blocks the Java and Python character tables agree on
    pool = [chr(c) for c in [*range(0x20, 0x860), *range(0x1E00, 0x2000)] if unicodedata.category(chr(c)) != "Cn"]
    rows = SAMPLES + ["".join(rng.choice(pool) for _ in range(12)) for _ in range(400)]
    frame = spark.createDataFrame([(s,) for s in rows], "s string")
    got = frame.select("s", T.norm_text("s"), T.norm_char_name("s"), T.norm_color("s"), T.norm_title("s")).collect()
    for s, norm, char, color, title in got:
        assert norm == py_norm(s), s
        assert char == py_char(s), s
        assert color == py_color(s), s
        assert title == py_title(s), s


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_ids_and_numbers(spark):
    for raw, want in [("2819.0", "2819"), ("cat-001", "cat-001"), (" nan ", None), ("None", None), ("", None), ("12d", "12d"), ("inf", "inf"), (" 7 ", "7")]:
        assert one(spark, T.norm_id(F.lit(raw))) == want, raw
    for x in (42.0, 42.5, 38.333333333, 0.5, 123456.0, 1234567.0, 199.99, 0.00012345, 99999.96, 9.9999999):
        assert one(spark, T.compact_number(F.lit(x))) == f"{x:g}", x
    for raw, want in [("42,5", "42.5 EU"), ("2024", None), ("42", "42 EU"), ("x", None)]:
        assert one(spark, T.size_format(F.lit(raw))) == want, raw


def test_titles_and_words(spark):
    for title, want in [("Nike Air - 42", "42"), ("A - B - XL ", "XL"), ("no size", None), ("end - ", None)]:
        assert one(spark, T.size_from_title(F.lit(title))) == want, title
    for text, word, want in [("album foto", "alb", False), ("tricou alb", "alb", True), ("férfi cipő", "férfi", True), ("3/4 lung", "3/4", True), ("ALB", "alb", True)]:
        assert one(spark, T.word_match(F.lit(text), word)) is want, text
    assert one(spark, T.error_code(F.lit(" 1007 - x"))) == "1007"
    assert one(spark, T.slug(F.lit("eMAG HU"))) == "emag_hu"
    assert one(spark, T.slug(F.lit("!!"))) == "marketplace"
    assert one(spark, T.sanitize(F.lit('a\n"b"'), 5)) == 'a \\"b'


def test_url_guard(spark):
    cases = [("https://x.com/a.jpg, http://y", None), ("ftp://x", "scheme"), ("http://10.0.0.1/a", "private"), ("http://192.168.1.5/", "private"), ("http://8.8.8.8/", None), ("", "scheme"), ("http:///x", "host")]
    for url, want in cases:
        assert one(spark, T.url_guard(F.lit(url))) == want, url


def test_visible_text():
    assert visible_text("<p>Cotton &amp; mesh</p><script>var a='</p>';</script><!-- x --><b> slim </b>") == "Cotton & mesh slim"
    assert visible_text("plain") == "plain"


def test_keys_of_null_text(spark):
    from offermend.functions import text

    row = spark.createDataFrame([("ș",), (None,)], "t string").where("t IS NULL").select(
        text.norm_text("t"), text.norm_title("t"), text.norm_color("t"), text.norm_char_name("t"), text.casefold("t"), text.drop_marks("t")
    ).first()
    assert list(row) == [None] * 6
