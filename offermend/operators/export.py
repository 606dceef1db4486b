"""Corrected offers as export rows, and what changed in each cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offermend.session import staged

STRINGS = "map<string,string>"


def _merged(offers: DataFrame, results: DataFrame) -> DataFrame:
    """Offer rows with ``merged``: array of (char_name, value, is_new, is_missing), existing first.

    Existing attributes lose the cleared ones; new values replace existing ones of the same name;
    missing mandatory names follow as blanks.
    """
    item = lambda n, v, new, miss: F.struct(
        n.alias("char_name"), v.alias("value"), F.lit(new).alias("is_new"), F.lit(miss).alias("is_missing")
    )
    rows = offers.select("offer_id", "title", "brand", "description", "category", "existing_chars").join(
        results.select("offer_id", "action", "new_category", "new_chars", "cleared", "missing_mandatory", "needs_manual"), "offer_id"
    )
    kept = F.map_filter(
        F.coalesce("existing_chars", F.create_map().cast(STRINGS)),
        lambda k, v: ~F.array_contains(F.col("cleared"), k) & (F.coalesce(v, F.lit("")) != ""),
    )
    overlay = F.transform(
        F.map_entries(kept),
        lambda e: F.struct(
            e["key"].alias("char_name"), F.coalesce(F.element_at("new_chars", e["key"]), e["value"]).alias("value"),
            F.map_contains_key(F.col("new_chars"), e["key"]).alias("is_new"), F.lit(False).alias("is_missing"),
        ),
    )
    added = F.transform(
        F.map_entries(F.map_filter("new_chars", lambda k, v: ~F.map_contains_key(F.col("_kept"), k))), lambda e: item(e["key"], e["value"], True, False)
    )
    blanks = F.transform(
        F.filter("missing_mandatory", lambda m: ~F.map_contains_key(F.col("_kept"), m) & ~F.map_contains_key(F.col("new_chars"), m)),
        lambda m: item(m, F.lit(""), False, True),
    )
    return rows.withColumn("_kept", kept).withColumn("merged", F.concat(overlay, added, blanks)).drop("_kept")


def long_attributes(offers: DataFrame, results: DataFrame) -> DataFrame:
    """(offer_id, slot, char_name, value, is_new, is_missing) of the corrected offers."""
    return _merged(offers, results).select("offer_id", F.posexplode("merged").alias("slot", "m")).select("offer_id", "slot", "m.*")


def export_model_rows(offers: DataFrame, results: DataFrame) -> DataFrame:
    """Wide rows: five base columns and as many name/value pairs as the fullest offer has.

    The pair columns are read from the row's own array, so nothing is pivoted across tasks; the one
    number that leaves the cluster is the width.
    """
    rows = staged(_merged(offers, results))  # read for the width and again for the rows
    width = max(1, rows.agg(F.max(F.size("merged"))).first()[0] or 0)
    base = [
        F.col("offer_id").alias("Internal ID"), F.col("title").alias("Name"), F.col("brand").alias("Brand"),
        F.col("description").alias("Description"),
        F.coalesce(F.nullif("new_category", F.lit("")), F.col("category"), F.lit("")).alias("Category"),
    ]
    pairs = []
    for i in range(width):
        suffix = "" if i == 0 else f".{i}"
        slot = F.get("merged", F.lit(i))
        pairs += [
            slot["char_name"].alias(f"Characteristic Name{suffix}"),
            F.nullif(slot["value"], F.lit("")).alias(f"Characteristic Value{suffix}"),
        ]
    return rows.select(*base, *pairs)


def _additions() -> Column:
    """New attributes, then mandatory names that are still missing, as (name, value)."""
    return F.concat(
        F.transform(F.map_entries("new_chars"), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"))),
        F.transform(
            F.filter("missing_mandatory", lambda m: ~F.map_contains_key(F.col("new_chars"), m)),
            lambda m: F.struct(m.alias("name"), F.lit(None).cast("string").alias("value")),
        ),
    )


def export_overflow(offers: DataFrame, results: DataFrame) -> DataFrame:
    """(offer_id, position, name, value) of additions that find no free slot in the original layout."""
    rows = offers.select("offer_id", "slots").join(results.select("offer_id", "new_chars", "missing_mandatory"), "offer_id")
    free = F.size(F.filter("slots", lambda s: s["name"].isNull()))
    left = rows.select("offer_id", free.alias("free"), F.posexplode(_additions()).alias("position", "a")).where("position >= free")
    return left.select("offer_id", "position", "a.name", "a.value")


def export_original_rows(offers: DataFrame, results: DataFrame, n_slots: int) -> DataFrame:
    """Source slots kept in place: cleared names lose their value, new attributes and then missing
    mandatory names go to the first free slots; what does not fit is left out, as the file has no
    more columns. ``offers`` carry ``slots``: array of (name, value), one entry per column pair.
    """
    rows = offers.select("offer_id", "category", "slots").join(
        results.select("offer_id", "action", "new_category", "new_chars", "cleared", "missing_mandatory"), "offer_id"
    )
    rows = rows.withColumn("_add", _additions())
    # rank of a free slot among the free ones = position of the addition it takes
    free_before = lambda i: F.size(F.filter(F.slice("slots", 1, i), lambda s: s["name"].isNull()))
    first_named = lambda s, i: ~F.exists(F.slice("slots", 1, i), lambda t: t["name"] == s["name"])
    filled = F.transform(
        "slots",
        lambda s, i: F.when(s["name"].isNull(), F.coalesce(F.get("_add", free_before(i)), s)).otherwise(
            F.struct(
                s["name"].alias("name"),
                F.when(F.array_contains("cleared", s["name"]) & first_named(s, i), None).otherwise(s["value"]).alias("value"),
            )
        ),
    )
    rows = rows.withColumn("filled", filled)
    category = F.when(F.col("action").isin("cat_assigned", "cat_corrected"), F.col("new_category")).otherwise(F.col("category"))
    out = []
    for i in range(n_slots):
        slot = F.get("filled", F.lit(i))
        out += [slot["name"].alias(f"Offer ch. {i + 1} name"), slot["value"].alias(f"Offer ch. {i + 1} val.")]
    return rows.select("offer_id", category.alias("category"), *out)


def change_tags(offers: DataFrame, results: DataFrame) -> DataFrame:
    """(offer_id, field, tag): new / missing / cleared attributes, assigned / corrected categories,
    and rows for manual work."""
    cells = long_attributes(offers, results)
    attributes = cells.select(
        "offer_id", F.col("char_name").alias("field"), F.when(F.col("is_new"), "new").when(F.col("is_missing"), "missing").alias("tag")
    ).where("tag IS NOT NULL")
    cleared = results.select("offer_id", F.explode("cleared").alias("field"), F.lit("cleared").alias("tag"))
    category = results.where("action IN ('cat_assigned', 'cat_corrected')").select(
        "offer_id", F.lit("category").alias("field"), F.when(F.col("action") == "cat_assigned", "assigned").otherwise("corrected").alias("tag")
    )
    manual = results.where("needs_manual").select("offer_id", F.lit("row").alias("field"), F.lit("manual").alias("tag"))
    return attributes.unionByName(cleared).unionByName(category).unionByName(manual)


