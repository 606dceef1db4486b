"""Attribute values read from titles and descriptions.

The rules are rows (concept, step, words, value). Per offer the words are tested in generated code;
which concept feeds which attribute is one row per category, joined once.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offermend import fixed_values as V
from offermend.functions.text import WORD, norm_char_name, size_format, size_from_title, strip, to_number, word_pattern
from offermend.operators.indexes import ReferenceIndex
from offermend.session import staged


@dataclass(frozen=True)
class Rule:
    """Words that propose a value. ``mode``: how the value must stand in the attribute's list."""

    concept: str
    step: int
    words: tuple[str, ...]
    value: str
    mode: str = "valid"  # valid | exact | lower
    unless: tuple[str, ...] = ()


def builtin_rules() -> list[Rule]:
    rules = []
    for concept, table in V.WORD_RULES.items():
        rules += [Rule(concept, step, tuple(words), value) for step, (words, value) in enumerate(table)]
    for step, (words, spellings) in enumerate(V.AUDIENCE_RULES):
        rules += [Rule("audience", step * 100 + i, tuple(words), s, "lower") for i, s in enumerate(spellings)]
    for step, (words, value, exact) in enumerate(V.PRINT_RULES):
        rules.append(Rule("print", step, tuple(words), value, "exact" if exact else "valid"))
    rules.append(Rule("season", 0, tuple(V.WINTER_WORDS), V.WINTER_VALUE))
    rules.append(Rule("season", 0, ("fleece",), V.WINTER_VALUE, unless=tuple(V.LIGHT_WORDS)))
    rules.append(Rule("season", 1, tuple(V.SUMMER_WORDS + V.LIGHT_WORDS), V.SUMMER_VALUE))
    rules += [Rule("care", step, (), value, "exact") for step, value in enumerate(V.CARE_VALUES)]
    rules.append(Rule("studs", 0, (), V.STUDS_VALUE, "exact"))
    return rules


def concept_names_table(spark: SparkSession, names: dict[str, list[str]] | None = None) -> DataFrame:
    """(concept, priority, name) rows."""
    rows = [(c, i, n) for c, ns in (names or V.CONCEPT_NAMES).items() for i, n in enumerate(ns)]
    return spark.createDataFrame(rows, "concept string, priority int, name string")


def applicable_concepts(index: ReferenceIndex, names: DataFrame) -> DataFrame:
    """(cat, concept) -> attribute: the first of the concept's names the category knows."""
    exact = index.char_names.join(names, F.col("char_name") == F.col("name")).select(
        "cat", "concept", "priority", F.col("char_name").alias("attribute"), F.lit(0).alias("loose")
    )
    keyed = index.chars.join(
        names.withColumn("char_key", norm_char_name("name")), "char_key"
    ).select("cat", "concept", "priority", F.col("canonical").alias("attribute"), F.lit(1).alias("loose"))
    return exact.unionByName(keyed).groupBy("cat", "concept").agg(
        F.min_by("attribute", F.struct("priority", "loose")).alias("attribute")
    )


def resolve_rules(
    index: ReferenceIndex, concepts: DataFrame, rules: list[Rule], fuzzy: bool = True, gated: bool = False
) -> DataFrame:
    """cat -> sorted array of (concept, step, rule, attribute, value): what each rule yields there.

    Rules name a fixed set of values, so their lists are consulted once per category and rule and
    not once per offer. A list holds at most one entry per rule. ``gated`` gives values as they
    leave the validation gate: free text takes the spelling other categories list.
    """
    from offermend.operators.matching import KEY, match_values

    spark = concepts.sparkSession
    table = spark.createDataFrame(
        [(i, r.concept, r.step, r.value, r.mode) for i, r in enumerate(rules)],
        "rule int, concept string, step int, value_input string, mode string",
    )
    asked = concepts.join(table, "concept").withColumnRenamed("attribute", "char_input")
    free = F.col("concept").isin(*V.FREEFORM_CONCEPTS) & ~F.col("has_values")
    value = (
        F.when(F.col("mode") == "exact", F.when(F.col("exact_hit"), F.col("value_input")))
        .when(F.col("mode") == "lower", F.col("lower_value"))
        .otherwise(F.coalesce("found", F.when(free, F.coalesce("fallback", "value_input") if gated else F.col("value_input"))))
    )
    entry = F.struct("concept", "step", "rule", F.col("char_input").alias("attribute"), "value")
    return (
        asked.join(match_values(asked, index, fuzzy), KEY)
        .withColumn("value", value)
        .where(F.col("value").isNotNull())
        .groupBy("cat")
        .agg(F.sort_array(F.collect_list(entry)).alias("rules"))
    )


def _is_token(word: str) -> bool:
    return re.fullmatch(r"\w+", word) is not None


def words_present(text: Column, words: list[str]) -> Column:
    """Those of the words that stand in the lower-cased text as whole words.

    Every token of the text is looked up in one constant set of the single words, phrases are searched.
    """
    tokens = F.split(text, f"[^{WORD}]+")
    singles = [w for w in words if _is_token(w)]
    found = [F.filter(tokens, lambda t: t.isin(*singles))] if singles else []
    phrases = [w for w in words if not _is_token(w)]
    if phrases:
        found.append(
            F.array_compact(F.array(*[F.when(text.contains(w) & text.rlike(word_pattern(w)), F.lit(w)) for w in phrases]))
        )
    return F.concat(*found) if found else F.array().cast("array<string>")


def _fired(rules: list[tuple[int, Rule]], present: Column) -> Column:
    """Numbers of the rules one of whose words is present."""
    # one constant each, so the plan holds a map and not a thousand literals; a map is searched from its
    # start, so words are found by their first character first
    of_word: dict[str, dict[str, list[int]]] = {}
    for w in _words(rules):
        of_word.setdefault(w[:1], {})[w] = [i for i, r in rules if w in r.words]
    numbers = F.from_json(F.lit(json.dumps(of_word)), "map<string,map<string,array<int>>>")
    always = F.array(*[F.lit(i) for i, r in rules if not r.words]).cast("array<int>")
    out = F.concat(always, F.flatten(F.transform(present, lambda w: F.element_at(F.element_at(numbers, F.substring(w, 1, 1)), w))))
    for number, unless in [(i, r.unless) for i, r in rules if r.unless]:
        out = F.when(F.arrays_overlap(F.array(*[F.lit(w) for w in unless]), present), F.array_remove(out, number)).otherwise(out)
    return out


def _words(rules: list[tuple[int, Rule]]) -> list[str]:
    return sorted({w for _, r in rules for w in r.words + r.unless})


def detect_by_words(offers: DataFrame, resolved: DataFrame, rules: list[Rule]) -> DataFrame:
    """offers (cat, title, visible, ...) with ``detected``: array of (concept, step, rule, attribute,
    value), the first accepted rule per concept. No shuffle when the per-category lists broadcast."""
    read_title = [(i, r) for i, r in enumerate(rules) if r.concept in V.TITLE_CONCEPTS]
    read_both = [(i, r) for i, r in enumerate(rules) if r.concept not in V.TITLE_CONCEPTS]
    lowered = offers.withColumn("_title", F.lower(F.coalesce("title", F.lit("")))).withColumn(
        "_text", F.concat("_title", F.lit(" "), F.lower(F.coalesce("visible", F.lit(""))))
    )
    present = lowered.withColumns({
        "_in_title": words_present(F.col("_title"), _words(read_title)), "_in_text": words_present(F.col("_text"), _words(read_both))
    })
    fired = F.concat(*[_fired(part, F.col(c)) for part, c in ((read_title, "_in_title"), (read_both, "_in_text")) if part])
    fired = present.withColumn("_fired", F.array_distinct(fired))
    # the rules of a category by their number, so that those fired are fetched and the others not looked at
    placed = resolved.select("cat", F.transform(
        F.sequence(F.lit(0), F.lit(max(0, len(rules) - 1))), lambda n: F.get(F.filter("rules", lambda r: r["rule"] == n), F.lit(0))
    ).alias("rules"))
    hits = fired.join(placed, "cat", "left").withColumn(
        "_hits", F.sort_array(F.array_compact(F.transform("_fired", lambda n: F.get("rules", n))))
    )
    first = F.filter("_hits", lambda r, i: (i == 0) | (F.get("_hits", i - 1)["concept"] != r["concept"]))
    return hits.withColumn("detected", first).drop(
        "_title", "_text", "_in_title", "_in_text", "_fired", "_hits", "rules"
    )


def size_and_age(offers: DataFrame, concepts: DataFrame) -> DataFrame:
    """Proposals whose value comes from the text itself (offer_id, cat, concept, step, char_input,
    value_input, mode): the title's size in up to four forms and an age range of the description."""
    text = F.lower(F.coalesce("visible", F.lit("")))
    offers = offers.select(
        "offer_id", "cat", text.alias("_text"), size_from_title(F.coalesce("title", F.lit(""))).alias("_size")
    ).withColumn("_lead", F.nullif(F.regexp_extract("_size", r"^([0-9]+(?:[,.][0-9]+)?)", 1), F.lit("")))
    text, size, leading = F.col("_text"), F.col("_size"), F.col("_lead")
    # free forms apply only to an attribute without a list
    words_only = F.when(to_number(F.replace(size, F.lit(","), F.lit("."))).isNull(), size)
    forms = [
        ("size", 0, "valid", size),
        ("size", 1, "valid", leading),
        ("size", 2, "free", size_format(leading)),
        ("size", 3, "free", F.coalesce(size_format(size), words_only)),
    ]
    forms += [
        ("age", step, "exact", F.nullif(strip(F.regexp_extract(text, f"({pattern})", 1)), F.lit("")))
        for step, pattern in enumerate(V.AGE_PATTERNS)
    ]
    wide = offers.select(
        "offer_id", "cat",
        F.explode(
            F.filter(
                F.array(*[
                    F.struct(F.lit(c).alias("concept"), F.lit(s).alias("step"), F.lit(m).alias("mode"), v.alias("value_input"))
                    for c, s, m, v in forms
                ]),
                lambda f: f["value_input"].isNotNull(),
            )
        ).alias("f"),
    ).select("offer_id", "cat", "f.*")
    fed = concepts.where(F.col("concept").isin("size", "age")).select("cat", "concept", F.col("attribute").alias("char_input"))
    return wide.join(fed, ["cat", "concept"])


def size_and_age_value() -> Column:
    """Value a matched text proposal yields, null if its list does not take it."""
    return (
        F.when(F.col("mode") == "exact", F.when(F.col("exact_hit"), F.col("value_input")))
        .when(F.col("mode") == "free", F.when(~F.col("has_values"), F.col("value_input")))
        .otherwise(F.col("found"))
    )


def detect(
    offers: DataFrame, index: ReferenceIndex, names: DataFrame, rules: list[Rule] | None = None, fuzzy: bool = True
) -> DataFrame:
    """(offer_id, cat, concept, char_name, value): the first proposal per concept its list accepts.

    ``offers``: offer_id, cat, title, visible (description text). An optional ``filled`` array names
    attributes that already have a value; they are left alone.
    """
    from offermend.operators.matching import KEY, match_values

    rules = rules or builtin_rules()
    concepts = staged(applicable_concepts(index, names))
    # markup is read once, and so are the proposals, which give the keys to match and take what was matched
    offers = staged(offers.select("offer_id", "cat", "title", "visible", *[c for c in ("filled",) if c in offers.columns]))
    by_words = (
        detect_by_words(offers, resolve_rules(index, concepts, rules, fuzzy), rules)
        .select("offer_id", "cat", F.explode("detected").alias("d"))
        .select("offer_id", "cat", "d.concept", F.col("d.attribute").alias("char_name"), "d.value")
    )
    read = staged(size_and_age(offers, concepts))
    by_text = (
        read.join(match_values(read, index, fuzzy), KEY)
        .withColumn("value", size_and_age_value())
        .where(F.col("value").isNotNull())
        .groupBy("offer_id", "cat", "concept", F.col("char_input").alias("char_name"))
        .agg(F.min_by("value", "step").alias("value"))
    )
    found = by_words.unionByName(by_text)
    if "filled" in offers.columns:
        filled = offers.select("offer_id", F.explode("filled").alias("char_name"))
        found = found.join(filled, ["offer_id", "char_name"], "left_anti")
    return found


# ---------------------------------------------------------------- category rules


def _tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


def _padded(tokens: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def prepare_category_rules(rules: DataFrame) -> DataFrame:
    """Keyword rules (keywords, exclude, category, ordinal) as arrays of padded word runs; the old
    ``prefix`` form is one phrase. Columns: rule_id, keywords, exclude, category, n, anchor."""

    def runs(text: Column) -> Column:
        parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda w: _padded(_tokens(w)))
        return F.filter(parts, lambda w: strip(w) != "")

    keywords = runs(F.col("keywords"))
    if "prefix" in rules.columns:
        keywords = F.when(F.size(keywords) > 0, keywords).otherwise(
            F.filter(F.array(_padded(_tokens(F.col("prefix")))), lambda w: strip(w) != "")
        )
    exclude = runs(F.col("exclude")) if "exclude" in rules.columns else F.array().cast("array<string>")
    longest = F.array_max(
        F.transform(_tokens(F.array_join("keywords", " ")), lambda t: F.struct(F.length(t).alias("l"), t.alias("t")))
    )["t"]
    return (
        rules.select(F.col("ordinal").alias("rule_id"), keywords.alias("keywords"), exclude.alias("exclude"), "category")
        .withColumn("n", F.size("keywords"))
        .where("n > 0")
        .withColumn("anchor", longest)
    )


def keyword_rules(titles: DataFrame, rules: DataFrame) -> DataFrame:
    """title -> (category, rule_id) of the most specific rule that holds; earlier rules win ties.

    All keywords must stand in the title as words and no exclude word may. A rule is found through
    its longest word (an equi-join on the words of the title) and then checked in full, so the work
    follows the words shared and not titles times rules.
    """
    words = titles.select("title").where(F.col("title").isNotNull()).distinct().withColumn("_tokens", _tokens(F.col("title")))
    words = words.select("title", _padded(F.col("_tokens")).alias("_all"), F.explode(F.array_distinct("_tokens")).alias("anchor"))
    hits = words.join(prepare_category_rules(rules), "anchor").where(
        F.forall("keywords", lambda k: F.contains(F.col("_all"), k))
        & ~F.exists("exclude", lambda k: F.contains(F.col("_all"), k))
    )
    best = F.min_by(F.struct("category", "rule_id"), F.struct(-F.col("n"), F.col("rule_id")))
    return hits.groupBy("title").agg(best.alias("_r")).select("title", "_r.*")


def learn_keywords(title: Column) -> Column:
    """Up to five telling words of a title, as a rule's keyword text."""
    base = F.when(F.instr(title, " - ") > 0, F.regexp_replace(title, r"(?s) - (?!.* - ).*$", "")).otherwise(title)
    words = F.filter(
        F.split(strip(base), r"(?U)[\s\-]+"),
        lambda w: (F.length(w) > 3) & ~w.rlike(r"\p{N}") & ~((w == F.upper(w)) & (w != F.lower(w))),
    )
    return F.array_join(F.slice(F.transform(words, lambda w: F.lower(w)), 1, 5), ", ")
