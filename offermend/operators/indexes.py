"""Lookup tables derived from the reference tables.

Each index is a lazy DataFrame with one row per key, so every later lookup is an equi-join whose
reference side is unique. First-wins and last-wins choices use the stored ``ordinal``.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offermend.functions.text import norm_char_name, norm_text, null_if_blank, strip
from offermend.session import staged


def join_id(internal: Column, external: Column) -> Column:
    """External id where present and different from the internal one, else the internal id."""
    external = null_if_blank(external)
    return F.when(external.isNotNull() & (external != internal), external).otherwise(internal)


def category_joins(categories: DataFrame) -> DataFrame:
    """internal id -> join id, last row of a repeated id wins."""
    return categories.groupBy("category_id").agg(
        F.max_by(join_id(F.col("category_id"), F.col("external_id")), F.col("ordinal")).alias("join_id")
    )


def category_index(
    categories: DataFrame, characteristics: DataFrame | None = None, prefer_most_chars: bool = False
) -> DataFrame:
    """category_name -> cat, with the normalised name and the position used for its first-wins rule.

    Repeated names keep the last row, or with ``prefer_most_chars`` the category with most attributes.
    """
    rows = categories.select(
        strip("category_name").alias("category_name"),
        join_id(F.col("category_id"), F.col("external_id")).alias("cat"),
        "category_id",
        "ordinal",
    )
    if prefer_most_chars:
        sizes = characteristics.groupBy("category_id").agg(F.count("*").alias("n"))
        ranked = rows.join(sizes, "category_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        best = keep_best_duplicate(ranked, ["category_name"], F.col("n"), F.col("ordinal"))
        index = best.select("category_name", "cat", F.struct(-F.col("n"), F.col("ordinal")).alias("position"))
    else:
        index = rows.groupBy("category_name").agg(
            F.max_by("cat", "ordinal").alias("cat"),
            F.struct(F.lit(0).cast("bigint").alias("n"), F.min("ordinal").alias("ordinal")).alias("position"),
        )
    return index.withColumn("category_key", norm_text("category_name"))


def keep_best_duplicate(rows: DataFrame, keys: list[str], score: Column, tie: Column) -> DataFrame:
    """One row per key: highest score, then lowest tie value. Aggregates on the map side, so a hot
    key never gathers its rows in one task."""
    packed = F.struct(*[F.col(c) for c in rows.columns])
    best = rows.groupBy(*keys).agg(F.min_by(packed, F.struct(-score, tie)).alias("_row"))
    return best.select("_row.*")


def category_key_index(index: DataFrame) -> DataFrame:
    """normalised name -> cat, first name wins."""
    return index.groupBy("category_key").agg(F.min_by("cat", "position").alias("cat"))


def _attributes(categories: DataFrame, characteristics: DataFrame) -> DataFrame:
    """Attribute rows keyed by the category's join id; blank names left out."""
    return (
        characteristics.join(category_joins(categories), "category_id", "left")
        .withColumn("cat", F.coalesce("join_id", "category_id"))
        .withColumn("char_name", strip("characteristic_name"))
        .where(~F.col("char_name").isin("", "nan"))
        .select(
            "cat", "char_name", norm_char_name("char_name").alias("char_key"), "mandatory", "restrictive",
            null_if_blank("external_characteristic_id").alias("external_characteristic_id"), "ordinal",
        )
    )


def char_names_index(attributes: DataFrame) -> DataFrame:
    """Known (cat, char_name) pairs."""
    return attributes.select("cat", "char_name").distinct()


def char_index(attributes: DataFrame) -> DataFrame:
    """(cat, char_key) -> display name, external id and restrictive flag; last row wins.

    The flag of an attribute with an external id is true if any row of that id is restrictive.
    """
    by_id = (
        attributes.where(F.col("external_characteristic_id").isNotNull())
        .groupBy("external_characteristic_id")
        .agg(F.max("restrictive").alias("by_id"))
    )
    by_key = attributes.groupBy("cat", "char_key").agg(
        F.max_by("char_name", "ordinal").alias("canonical"),
        F.max_by("restrictive", "ordinal").alias("by_name"),
        F.max_by(
            "external_characteristic_id",
            F.when(F.col("external_characteristic_id").isNotNull(), F.col("ordinal")),
        ).alias("external_characteristic_id"),
    )
    return by_key.join(by_id, "external_characteristic_id", "left").select(
        "cat", "char_key", "canonical", "external_characteristic_id",
        F.coalesce("by_id", "by_name", F.lit(True)).alias("restrictive"),
    )


def mandatory_index(attributes: DataFrame) -> DataFrame:
    """(cat, char_name, ordinal) of mandatory attributes, one row per name at its first position."""
    return attributes.where("mandatory").groupBy("cat", "char_name").agg(F.min("ordinal").alias("ordinal"))


def mandatory_lists(attributes: DataFrame) -> DataFrame:
    """cat -> mandatory names in file order. A list is as long as the result column that shows it."""
    return mandatory_index(attributes).groupBy("cat").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "char_name"))), lambda s: s["char_name"]).alias(
            "mandatory"
        )
    )


def value_index(categories: DataFrame, attributes: DataFrame, values: DataFrame) -> DataFrame:
    """Distinct (cat, canonical name, value) with the lower-cased and normalised value.

    Several spellings of one attribute in a category are united.
    """
    keys = attributes.groupBy("cat", "char_key").agg(F.max_by("char_name", "ordinal").alias("canonical"))
    return (
        values.where(F.col("characteristic_name").isNotNull() & F.col("value").isNotNull())
        .join(category_joins(categories), "category_id", "left")
        .select(
            F.coalesce("join_id", "category_id").alias("cat"),
            strip("characteristic_name").alias("raw_name"),
            strip("value").alias("value"),
        )
        .where(F.col("value") != "nan")
        .distinct()
        .withColumn("char_key", norm_char_name("raw_name"))
        .join(keys, ["cat", "char_key"], "left")
        .select("cat", F.coalesce("canonical", "raw_name").alias("char_name"), "value")
        .distinct()
        .withColumn("value_lower", F.lower("value"))
        .withColumn("value_norm", norm_text("value"))
    )


def value_index_by_char_id(values: DataFrame) -> DataFrame:
    """Distinct (attribute id, value)."""
    return (
        values.where(null_if_blank("characteristic_id").isNotNull() & F.col("value").isNotNull())
        .select("characteristic_id", strip("value").alias("value"))
        .distinct()
    )


def value_norm_index(values: DataFrame) -> DataFrame:
    """(cat, char_name, normalised value) -> value; the smallest of equal keys."""
    return values.groupBy("cat", "char_name", "value_norm").agg(F.min("value").alias("value"))


def marketplace_value_index(values: DataFrame) -> DataFrame:
    """Distinct (attribute key, value) over all categories."""
    return values.select(norm_char_name("char_name").alias("char_key"), "value", "value_norm").distinct()


@dataclass(frozen=True)
class ReferenceIndex:
    """Lookup tables of one marketplace."""

    categories: DataFrame
    category_keys: DataFrame
    attributes: DataFrame
    char_names: DataFrame
    chars: DataFrame
    values: DataFrame
    lookup: DataFrame
    written: bool = False

    @classmethod
    def build(cls, categories, characteristics, values, prefer_most_chars: bool = False) -> "ReferenceIndex":
        names = category_index(categories, characteristics, prefer_most_chars)
        attributes = _attributes(categories, characteristics)
        listed = value_index(categories, attributes, values)
        from offermend.operators.matching import value_lookup

        return cls(
            categories=names.select("category_name", "cat", "position"),
            category_keys=category_key_index(names),
            attributes=attributes,
            char_names=char_names_index(attributes),
            chars=char_index(attributes),
            values=listed,
            lookup=value_lookup(listed),
        )

    def frames(self) -> list[DataFrame]:
        return [
            self.categories, self.category_keys, self.attributes, self.char_names, self.chars, self.values, self.lookup
        ]

    def persist(self) -> "ReferenceIndex":
        """Keep the derived tables for a run that joins them several times."""
        for frame in self.frames():
            frame.persist()
        return self

    def stored(self) -> "ReferenceIndex":
        """The tables written once to the shared folder. Their sizes are then known when a plan is made, so that small
        ones are broadcast and the rows that look something up are not shuffled."""
        if self.written:
            return self
        return ReferenceIndex(**{f.name: staged(getattr(self, f.name)) for f in fields(self) if f.name != "written"}, written=True)

    def unpersist(self) -> None:
        for frame in self.frames():
            frame.unpersist()
