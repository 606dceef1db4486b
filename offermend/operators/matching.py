"""Category and value matching against a ``ReferenceIndex``.

Every function works on the *distinct* keys of its input and returns a mapping; callers join the
mapping back. Cheap tiers are equi-joins, and only keys no tier answered reach the fuzzy step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offermend import fixed_values as V
from offermend.functions.fuzzy import closest
from offermend.functions.text import compact_number, norm_char_name, norm_text, strip, to_number
from offermend.operators.indexes import ReferenceIndex, value_norm_index
from offermend.session import staged


# ---------------------------------------------------------------- categories


def resolve_categories(names: DataFrame, index: ReferenceIndex, fuzzy: bool = True) -> DataFrame:
    """category -> (cat, tier): exact name, normalised name, closest name at 0.90.

    With ``fuzzy`` the distinct names are read once and the mapping is written, so that its size is known where it is joined.
    """
    names = names.select("category").where(F.col("category").isNotNull()).distinct()
    exact = index.categories.select(F.col("category_name").alias("category"), F.col("cat").alias("cat_exact"))
    keys = index.category_keys.withColumnRenamed("cat", "cat_key")
    tiers = (
        names.join(exact, "category", "left")
        .withColumn("category_key", norm_text("category"))
        .join(keys, "category_key", "left")
    )
    cat, tier = [F.col("cat_exact"), F.col("cat_key")], F.when(F.col("cat_exact").isNotNull(), "exact").when(
        F.col("cat_key").isNotNull(), "normalised"
    )
    if fuzzy:
        tiers = staged(tiers)
        missed = tiers.where("cat_exact IS NULL AND cat_key IS NULL").select("category")
        near = closest(missed, index.categories.select("category_name"), [], "category", "category_name", V.CATEGORY_CUTOFF)
        near = near.join(index.categories, "category_name").select("category", F.col("cat").alias("cat_near"))
        tiers = tiers.join(near, "category", "left")
        cat.append(F.col("cat_near"))
        tier = tier.when(F.col("cat_near").isNotNull(), "closest")
    out = tiers.select("category", F.coalesce(*cat).alias("cat"), tier.alias("tier"))
    return staged(out) if fuzzy else out


def match_suggested_categories(replies: DataFrame, index: ReferenceIndex, fuzzy: bool = True) -> DataFrame:
    """suggested -> category_name: exact, lower-cased and stripped, closest at 0.88."""
    names = index.categories.select("category_name")
    asked = replies.select("suggested").where(F.col("suggested").isNotNull()).distinct()
    lowered = names.groupBy(F.lower(strip("category_name")).alias("key")).agg(F.max("category_name").alias("by_key"))
    tiers = (
        asked.join(names.select("category_name", F.col("category_name").alias("suggested")), "suggested", "left")
        .withColumn("key", F.lower(strip("suggested")))
        .join(lowered, "key", "left")
    )
    out = [F.col("category_name"), F.col("by_key")]
    if fuzzy:
        missed = tiers.where("category_name IS NULL AND by_key IS NULL").select("suggested")
        near = closest(
            missed, names.withColumnRenamed("category_name", "near"), [], "suggested", "near", V.SUGGESTED_CATEGORY_CUTOFF
        ).select("suggested", "near")
        tiers = tiers.join(near, "suggested", "left")
        out.append(F.col("near"))
    return tiers.select("suggested", F.coalesce(*out).alias("category_name"))


# ---------------------------------------------------------------- attribute names


def canonical_chars(pairs: DataFrame, index: ReferenceIndex) -> DataFrame:
    """Distinct (cat, char_input) -> display name, attribute key, external id, restrictive flag."""
    pairs = pairs.select("cat", "char_input").where("cat IS NOT NULL AND char_input IS NOT NULL").distinct()
    exact = index.char_names.select("cat", F.col("char_name").alias("char_input"), F.col("char_name").alias("exact_name"))
    return (
        pairs.join(exact, ["cat", "char_input"], "left")
        .withColumn("char_key", norm_char_name("char_input"))
        .join(index.chars, ["cat", "char_key"], "left")
        .select(
            "cat", "char_input", F.coalesce("exact_name", "canonical").alias("canonical"), "char_key",
            "external_characteristic_id", F.coalesce("restrictive", F.lit(True)).alias("restrictive"),
        )
    )


def has_char(pairs: DataFrame, index: ReferenceIndex) -> DataFrame:
    """Pairs whose attribute the category knows."""
    return canonical_chars(pairs, index).where(F.col("canonical").isNotNull()).select("cat", "char_input")


# ---------------------------------------------------------------- values

_NORM_TIER, _LOWER_TIER, _LIST_TIER = 8, 20, 30
_SAME_TIER, _TWIN_TIER = 40, 41
ANY_CATEGORY = "*"


def _forms(value: Column, cat: Column, name: Column, key: Column) -> Column:
    """Everything to look up for one value, as (scope, name, kind, tier, text).

    Tiers 1-7 are the ordered spellings under which a value may stand in its list, 8 its normalised
    form, 20 its lower-case form, 30 asks whether the list has values at all, 40 and 41 look the
    value up for the attribute in any category.
    """
    s = strip(value)
    dotted = F.replace(s, F.lit(","), F.lit("."))
    number = to_number(dotted)
    texts = [
        s,
        F.upper(s),
        F.concat(s, F.lit(" INTL")),
        F.concat(F.upper(s), F.lit(" INTL")),
        F.concat(s, F.lit(" EU")),
        F.concat(dotted, F.lit(" EU")),
        F.when(number.isNotNull(), F.concat(compact_number(number), F.lit(" EU"))),
    ]

    def form(scope: Column, of: Column, kind: str, tier: int, text: Column) -> Column:
        return F.struct(
            scope.alias("scope"), of.alias("name"), F.lit(kind).alias("kind"), F.lit(tier).alias("tier"), text.alias("text")
        )

    forms = [form(cat, name, "value", tier, text) for tier, text in enumerate(texts, 1)]
    forms.append(form(cat, name, "norm", _NORM_TIER, norm_text(s)))
    forms.append(form(cat, name, "lower", _LOWER_TIER, F.lower(s)))
    forms.append(form(cat, name, "list", _LIST_TIER, F.lit("")))
    forms.append(form(F.lit(ANY_CATEGORY), key, "value", _SAME_TIER, s))
    forms.append(form(F.lit(ANY_CATEGORY), key, "norm", _TWIN_TIER, norm_text(s)))
    return F.filter(F.array(*forms), lambda f: f["text"].isNotNull() & f["name"].isNotNull())


def value_lookup(values: DataFrame) -> DataFrame:
    """(scope, name, kind, text) -> value, one row per key; the smallest of equal keys."""

    def keyed(scope: Column, of: Column, kind: str, text: Column) -> Column:
        return F.struct(scope.alias("scope"), of.alias("name"), F.lit(kind).alias("kind"), text.alias("text"))

    cat, name, anywhere, key = F.col("cat"), F.col("char_name"), F.lit(ANY_CATEGORY), F.col("char_key")
    rows = values.withColumn("char_key", norm_char_name("char_name")).select(
        "value",
        F.explode(
            F.array(
                keyed(cat, name, "value", F.col("value")),
                keyed(cat, name, "norm", F.col("value_norm")),
                keyed(cat, name, "lower", F.col("value_lower")),
                keyed(cat, name, "list", F.lit("")),
                keyed(anywhere, key, "value", F.col("value")),
                keyed(anywhere, key, "norm", F.col("value_norm")),
            )
        ).alias("k"),
    )
    return rows.groupBy("k.scope", "k.name", "k.kind", "k.text").agg(F.min("value").alias("value"))


KEY = ["cat", "char_input", "value_input"]


def match_values(requests: DataFrame, index: ReferenceIndex, fuzzy: bool = True) -> DataFrame:
    """Distinct (cat, char_input, value_input) -> everything the rules and the gate need to know.

    ``canonical``/``restrictive``: the attribute; ``has_values``: its list is not empty;
    ``exact_hit``: the value is in the list as it is; ``lower_value``: listed value equal in lower
    case; ``found``/``tier``: listed value by the ordered spellings, normalisation or closeness;
    ``fallback``: for an empty list, the value as listed for the attribute in any category.
    """
    keys = (
        requests.select(*KEY)
        .where("cat IS NOT NULL AND char_input IS NOT NULL AND value_input IS NOT NULL")
        .distinct()
    )
    exact = index.char_names.select("cat", F.col("char_name").alias("char_input"), F.col("char_name").alias("exact_name"))
    named = (
        keys.join(exact, ["cat", "char_input"], "left")
        .withColumn("char_key", norm_char_name("char_input"))
        .join(index.chars.select("cat", "char_key", F.col("canonical").alias("by_key"), "restrictive"), ["cat", "char_key"], "left")
        .withColumn("canonical", F.coalesce("exact_name", "by_key"))
        .withColumn("restrictive", F.coalesce("restrictive", F.lit(True)))
    )
    # an attribute outside the characteristics table may still have listed values under its raw name
    name = F.coalesce("canonical", "char_input")
    asked = named.select(
        *KEY, "canonical", "restrictive",
        F.explode(_forms(F.col("value_input"), F.col("cat"), name, F.when(F.col("canonical").isNotNull(), F.col("char_key")))).alias("f"),
    ).select(*KEY, "canonical", "restrictive", "f.*")

    def at(tier: int) -> Column:
        return F.max(F.when(F.col("tier") == tier, F.col("value")))

    listed = F.col("value").isNotNull() & (F.col("tier") <= _NORM_TIER)
    matched = (
        asked.join(index.lookup, ["scope", "name", "kind", "text"], "left")
        .groupBy(*KEY, "canonical", "restrictive")
        .agg(
            at(_LIST_TIER).isNotNull().alias("has_values"),
            at(1).isNotNull().alias("exact_hit"),
            at(_LOWER_TIER).alias("lower_value"),
            F.min_by("value", F.when(listed, F.col("tier"))).alias("found"),
            F.min(F.when(listed, F.col("tier"))).alias("tier"),
            F.coalesce(at(_SAME_TIER), at(_TWIN_TIER)).alias("fallback"),
        )
        .withColumn("fallback", F.when(~F.col("has_values"), F.col("fallback")))
    )
    if fuzzy:
        matched = _add_closest(matched, index)
    return matched.select(
        *KEY, "canonical", "restrictive", "has_values", "exact_hit", "lower_value", "found", "tier", "fallback"
    )


def _add_closest(matched: DataFrame, index: ReferenceIndex) -> DataFrame:
    """Fill ``found`` of still unmatched keys with the closest listed value at 0.80.

    The keys are written once: they feed both the search and the result, which is written for its size to be known
    where it is joined.
    """
    matched = staged(matched)
    missed = matched.where("has_values AND found IS NULL").select(
        *KEY, F.coalesce("canonical", "char_input").alias("char_name"), norm_text(strip("value_input")).alias("query")
    )
    norms = value_norm_index(index.values)
    near = closest(missed, norms, ["cat", "char_name"], "query", "value_norm", V.VALUE_CUTOFF)
    near = near.join(norms, ["cat", "char_name", "value_norm"]).select("cat", "char_name", "query", F.col("value").alias("near"))
    near = missed.join(near, ["cat", "char_name", "query"]).select(*KEY, "near")
    return staged(
        matched.join(near, KEY, "left")
        .withColumn("tier", F.coalesce("tier", F.when(F.col("near").isNotNull(), F.lit(9))))
        .withColumn("found", F.coalesce("found", "near"))
    )


def find_valid(requests: DataFrame, index: ReferenceIndex, fuzzy: bool = True) -> DataFrame:
    """(cat, char_input, value_input) -> listed value or null, with the tier that found it."""
    return match_values(requests, index, fuzzy).select(*KEY, F.col("found").alias("value"), "tier")


def marketplace_fallback(requests: DataFrame, index: ReferenceIndex) -> DataFrame:
    """Values of attributes without a list, matched over all categories."""
    return match_values(requests, index, fuzzy=False).where("fallback IS NOT NULL").select(*KEY, F.col("fallback").alias("value"))


def is_restrictive(pairs: DataFrame, index: ReferenceIndex) -> DataFrame:
    return canonical_chars(pairs, index).select("cat", "char_input", "restrictive")


# ---------------------------------------------------------------- the gate


def gate_columns(strict_freeform: bool = False) -> tuple[Column, Column]:
    """(value_mapped, reason) for a row of ``match_values``.

    With ``strict_freeform`` a restrictive attribute without values rejects free text.
    """
    known = F.col("canonical").isNotNull()
    free = F.lit(True) if not strict_freeform else ~F.col("restrictive")
    mapped = F.when(
        known,
        F.coalesce(
            "found",
            F.when(~F.col("has_values"), F.coalesce(F.col("fallback"), F.when(free, strip("value_input")))),
        ),
    )
    reason = (
        F.when(~known, F.lit("char_not_in_characteristics"))
        .when(mapped.isNotNull(), F.lit("ok"))
        .when(F.col("has_values"), F.lit("value_not_in_values_table"))
        .otherwise(F.lit("no_values_defined_for_char"))
    )
    return mapped, reason


def validate_gate(
    proposals: DataFrame, index: ReferenceIndex, fuzzy: bool = True, strict_freeform: bool = False
) -> DataFrame:
    """Proposals (offer_id, cat, char_input, value_input, source) with the audit columns added.

    One row in, one row out: char_canonical, value_mapped, accept, reason.
    """
    proposals = proposals.withColumn("value_input", strip(F.coalesce("value_input", F.lit(""))))
    mapped, reason = gate_columns(strict_freeform)
    return (
        proposals.join(match_values(proposals, index, fuzzy), KEY, "left")
        .withColumn("value_mapped", mapped)
        .withColumn("reason", reason)
        .withColumn("accept", F.col("value_mapped").isNotNull())
        .withColumn("char_canonical", F.col("canonical"))
        .withColumn("char_output", F.col("canonical"))
        .drop("canonical", "restrictive", "has_values", "exact_hit", "lower_value", "found", "tier", "fallback")
    )


# ---------------------------------------------------------------- existing attributes


def check_existing(attributes: DataFrame, index: ReferenceIndex) -> DataFrame:
    """Existing values (offer_id, cat, char_input, value_input) with a verdict.

    ``invalid``: outside a non-empty list even in lower case; ``foreign``: unknown to the category;
    ``keep`` otherwise.
    """
    asked = attributes.where("cat IS NOT NULL AND value_input <> ''")
    return asked.join(match_values(asked, index, fuzzy=False), KEY, "left").withColumn(
        "verdict",
        F.when(F.col("has_values") & F.col("lower_value").isNull(), F.lit("invalid"))
        .when(F.col("canonical").isNull(), F.lit("foreign"))
        .otherwise(F.lit("keep")),
    )


def clear_invalid(attributes: DataFrame, index: ReferenceIndex) -> DataFrame:
    return check_existing(attributes, index).where("verdict = 'invalid'").select("offer_id", "char_input", "value_input")


def clear_foreign(attributes: DataFrame, index: ReferenceIndex) -> DataFrame:
    """Existing attributes the category does not know."""
    known = has_char(attributes, index)
    return (
        attributes.where("cat IS NOT NULL AND value_input IS NOT NULL AND value_input <> ''")
        .join(known, ["cat", "char_input"], "left_anti")
        .select("offer_id", "char_input", "value_input")
    )


def missing_or_invalid_mandatory(offers: DataFrame, attributes: DataFrame, index: ReferenceIndex) -> DataFrame:
    """(offer_id, char_name) mandatory and absent, or holding a value outside a non-empty list."""
    from offermend.operators.indexes import mandatory_index

    wanted = offers.select("offer_id", "cat").join(mandatory_index(index.attributes), "cat").select("offer_id", "cat", "char_name")
    filled = attributes.where(F.col("value_input") != "").select("offer_id", F.col("char_input").alias("char_name"), "value_input")
    held = wanted.join(filled, ["offer_id", "char_name"], "left")
    values = index.values.select("cat", "char_name", F.col("value").alias("value_input"), F.lit(True).alias("listed"))
    lists = index.values.select("cat", "char_name").distinct().withColumn("has_values", F.lit(True))
    return (
        held.join(values, ["cat", "char_name", "value_input"], "left")
        .join(lists, ["cat", "char_name"], "left")
        .where("value_input IS NULL OR (has_values AND listed IS NULL)")
        .select("offer_id", "char_name")
    )
