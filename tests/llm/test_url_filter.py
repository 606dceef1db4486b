import datetime

from offermend.llm import url_filter

DAY = datetime.date


def test_entries_hold_from_their_date_until_the_next_change(spark):
    changes = spark.createDataFrame(
        [("host", "a.x.org", "block", DAY(2024, 1, 10)), ("host", "a.x.org", "drop", DAY(2024, 2, 1)), ("host", "a.x.org", "block", DAY(2024, 3, 1)), ("domain", "x.org", "block", DAY(2024, 1, 1)),
         ("path", "a.x.org/ok", "allow", DAY(2024, 1, 5)), ("host", None, "block", DAY(2024, 1, 1)), ("domain", "y.org", "block", None), ("domain", "y.org", "allow", DAY(2024, 1, 2)), ("domain", "y.org", "block", DAY(2024, 1, 2))],
        "kind string, key string, verdict string, dated date",
    )
    asked = [
        (1, "https://a.x.org/p", DAY(2024, 1, 9), "block", "domain"), (2, "https://u@A.X.org:80/p", DAY(2024, 1, 10), "block", "host"), (3, "http://a.x.org/ok/1", DAY(2024, 1, 10), "keep", "path"),
        (4, "http://a.x.org/ok?x", DAY(2024, 1, 4), "block", "domain"), (5, "http://a.x.org", DAY(2024, 2, 1), "block", "domain"), (6, "http://b.x.org", DAY(2023, 12, 31), "keep", None),
        (7, None, DAY(2024, 5, 5), "keep", None), (8, "", DAY(2024, 5, 5), "keep", None), (9, "not a url", DAY(2024, 5, 5), "keep", None), (10, "http://a.x.org/", None, "keep", None),
        (11, "http://y.org/", DAY(2024, 1, 2), "block", "domain"), (11, "http://y.org/", DAY(2024, 1, 2), "block", "domain"), (12, "http://a.x.org/#ok", DAY(2024, 3, 1), "block", "host"),
    ]
    captures = spark.createDataFrame([r[:3] for r in asked], "page_id long, url string, fetched_on date").selectExpr("*", "'mine' AS verdict", "1 AS kind", "2 AS key")
    got = url_filter.evaluate(captures, changes).select("page_id", "verdict", "matched_kind").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(r[0], r[3], r[4]) for r in asked], key=repr)


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, fetched_on date")
    assert url_filter.evaluate(none, url_filter.changes_of(none)).count() == 0
