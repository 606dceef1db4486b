"""URL filters by a temporal list join, in DataFrame operations only.

List changes (key, kind, verdict, dated) become validity intervals: a change holds from its date until
the next change of the same key. Every capture is evaluated against the entries active when it was
fetched: its keys (registered domain, host, host with first path segment) are paired with the day, the
distinct pairs and the changes of a key are put in one time order, and the last change seen is the one
in force. Only distinct (key, day) pairs enter that order, so a host with a third of all captures
brings at most one row per day; the verdicts go back to the captures by a join that can be split.
The most specific key with an active entry decides; a ``drop`` verdict lifts the key's entry.

Defined results: a null, empty or unparsable URL has no host and is kept; a capture without a date is
kept; of several changes of a key on one day the last by verdict holds; entries with a null key or date
are ignored; rows that repeat are evaluated alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("domain", "host", "path")
BLOCK, ALLOW, DROP = "block", "allow", "drop"
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
DOMAIN = r"([^.]+\.[^.]+)$"
PATH = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]+(?::[0-9]*)?/([^/?#]+)"


def url_keys(url: Column) -> dict[str, Column]:
    """Lower-cased host, its last two labels, and host/first path segment; '' where there is none."""
    low = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(low, HOST, 1)
    path = F.regexp_extract(low, PATH, 1)
    return {"domain": F.regexp_extract(host, DOMAIN, 1), "host": host, "path": F.when(path != "", F.concat(host, F.lit("/"), path)).otherwise(F.lit(""))}


def intervals(changes: DataFrame) -> DataFrame:
    """(kind, key, verdict, since, until) with until exclusive, null while it holds; lifted times are left out."""
    own = Window.partitionBy("kind", "key").orderBy("dated")
    daily = changes.where("key IS NOT NULL AND key <> '' AND dated IS NOT NULL").groupBy("kind", "key", "dated").agg(F.max("verdict").alias("verdict"))
    held = daily.withColumns({"since": F.col("dated"), "until": F.lead("dated").over(own)})
    return held.where(F.col("verdict") != DROP).select("kind", "key", "verdict", "since", "until")


def evaluate(captures: DataFrame, changes: DataFrame, url: str = "url", fetched: str = "fetched_on") -> DataFrame:
    """The captures with host, verdict (keep or block), matched_kind, matched_key and listed_since."""
    added = ("host", "verdict", "matched_kind", "matched_key", "listed_since")
    columns = [c for c in captures.columns if c not in added]
    rows = captures.select(*[F.col(f"`{c}`") for c in columns]).withColumns({f"__{k}": v for k, v in url_keys(F.col(url)).items()}).withColumn("__day", F.to_date(fetched))
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"__{k}").alias("key")) for k in KINDS])).alias("p")
    asked = rows.where("__day IS NOT NULL").select(pairs, "__day").select("p.kind", "p.key", "__day").where("key <> ''").distinct()
    spells = intervals(changes)
    events = spells.select("kind", "key", F.col("since").alias("day"), F.lit(0).alias("asks"), F.struct("verdict", "since", "until").alias("entry"))
    asks = asked.select("kind", "key", F.col("__day").alias("day"), F.lit(1).alias("asks"), F.lit(None).cast(events.schema["entry"].dataType).alias("entry"))
    order = Window.partitionBy("kind", "key").orderBy("day", "asks").rowsBetween(Window.unboundedPreceding, 0)
    as_of = events.union(asks).withColumn("now", F.last("entry", ignorenulls=True).over(order)).where("asks = 1 AND now IS NOT NULL AND (now.until IS NULL OR day < now.until)")
    answers = as_of.select("kind", "key", "day", "now.verdict", "now.since")
    for k in KINDS:
        mine = answers.where(F.col("kind") == k).select(F.col("key").alias(f"__{k}"), F.col("day").alias("__day"), F.struct(F.lit(k).alias("kind"), F.col("key").alias("key"), "verdict", "since").alias(f"__hit_{k}"))
        rows = rows.join(mine, [f"__{k}", "__day"], "left")
    hit = F.coalesce(*[F.col(f"__hit_{k}") for k in reversed(KINDS)])
    verdict = F.when(hit["verdict"] == BLOCK, F.lit(BLOCK)).otherwise(F.lit("keep"))
    return rows.select(*[F.col(f"`{c}`") for c in columns], F.col("__host").alias("host"), verdict.alias("verdict"), hit["kind"].alias("matched_kind"), hit["key"].alias("matched_key"), hit["since"].alias("listed_since"))


def changes_of(pages: DataFrame, url: str = "url") -> DataFrame:
    """Dated list changes for the keys of a crawl, for want of a list: a digest of the key says whether it is listed, when, and when it is lifted."""
    keys = url_keys(F.col(url))
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in keys.items()])).alias("p")
    listed = pages.select(pairs).select("p.kind", "p.key").where("key <> ''").distinct().withColumn("h", F.md5(F.concat("kind", F.lit(":"), "key")))
    number = lambda at: F.conv(F.substring("h", at, 4), 16, 10).cast("int")
    base = F.to_date(F.lit("2024-01-01"))
    first = F.date_add(base, number(5) % 300)
    steps = F.array(
        F.struct(F.when(number(9) % 3 == 0, F.lit(ALLOW)).otherwise(F.lit(BLOCK)).alias("verdict"), first.alias("dated")),
        F.struct(F.lit(DROP).alias("verdict"), F.date_add(first, number(13) % 120 + 1).alias("dated")),
        F.struct(F.lit(BLOCK).alias("verdict"), F.date_add(first, number(17) % 200 + 122).alias("dated")),
    )
    return listed.where(number(1) % 4 == 0).select("kind", "key", F.explode(steps).alias("s")).select("kind", "key", "s.verdict", "s.dated")
