"""Common SQL pieces of the check queries, independent of the Spark code."""

from __future__ import annotations

import re

from offermend import fixed_values as V
from offermend.plans.fixtures import view_sql

WORD = "[\\p{L}\\p{N}_]"


def with_views(*names: str, **ctes: str) -> str:
    """``WITH`` prefix: fixture views, then the given common table expressions in order."""
    text = view_sql(*names) if names else "WITH "
    parts = [f"{n} AS ({q})" for n, q in ctes.items()]
    return text + (",\n" if names and parts else "") + ",\n".join(parts) + "\n"


# lookup tables over the fixture reference data
CATS = "SELECT category_name, external_id AS cat, ordinal FROM fx_categories"
ATTRS = (
    "SELECT external_id AS cat, characteristic_name AS char_name, "
    "lower(rtrim(trim(characteristic_name), ':')) AS char_key, mandatory, restrictive, h.ordinal "
    "FROM fx_characteristics h JOIN fx_categories c USING (category_id)"
)
VALS = (
    "SELECT DISTINCT c.external_id AS cat, coalesce(a.char_name, v.characteristic_name) AS char_name, v.value "
    "FROM fx_values v JOIN fx_categories c USING (category_id) "
    "LEFT JOIN attrs a ON a.cat = c.external_id AND a.char_key = lower(rtrim(trim(v.characteristic_name), ':'))"
)
RESOLVED = (
    "SELECT category, coalesce(max(cat) FILTER (WHERE category = category_name), min(cat)) AS cat "
    "FROM (SELECT DISTINCT category FROM fx_offers WHERE category <> '') o "
    "JOIN cats ON lower(trim(o.category)) = lower(category_name) GROUP BY category"
)
REFERENCE = {"cats": CATS, "attrs": ATTRS, "vals": VALS}
VIEWS = ("fx_categories", "fx_characteristics", "fx_values", "fx_offers", "fx_attributes")


def lit(x) -> str:
    return "'" + str(x).replace("'", "''") + "'"


def word_runs(words) -> str:
    """Words as runs of tokens between spaces, joined by '|'."""
    return "|".join(" " + " ".join(re.findall(r"\w+", w)) + " " for w in words)


def rule_rows(concept: str | None = None) -> str:
    """The word rules as a VALUES list (concept, step, words, unless, value, mode, title_only)."""
    rows = []
    for name, table in V.WORD_RULES.items():
        for step, (words, value) in enumerate(table):
            rows.append((name, step, word_runs(words), "", value, "valid", name in V.TITLE_CONCEPTS))
    for step, (words, spellings) in enumerate(V.AUDIENCE_RULES):
        rows += [("audience", step * 100 + i, word_runs(words), "", s, "lower", False) for i, s in enumerate(spellings)]
    for step, (words, value, exact) in enumerate(V.PRINT_RULES):
        rows.append(("print", step, word_runs(words), "", value, "exact" if exact else "valid", False))
    rows.append(("season", 0, word_runs(V.WINTER_WORDS), "", V.WINTER_VALUE, "valid", False))
    rows.append(("season", 0, word_runs(["fleece"]), word_runs(V.LIGHT_WORDS), V.WINTER_VALUE, "valid", False))
    rows.append(("season", 1, word_runs(V.SUMMER_WORDS + V.LIGHT_WORDS), "", V.SUMMER_VALUE, "valid", False))
    rows += [("care", i, "", "", v, "exact", False) for i, v in enumerate(V.CARE_VALUES)]
    rows.append(("studs", 0, "", "", V.STUDS_VALUE, "exact", False))
    rows = [r for r in rows if concept in (None, r[0])] or [("none", 0, "", "", "", "exact", False)]
    body = ", ".join(f"({lit(c)}, {s}, {lit(p)}, {lit(u)}, {lit(v)}, {lit(m)}, {str(t).lower()})" for c, s, p, u, v, m, t in rows)
    return f"SELECT * FROM (VALUES {body}) AS r(concept, step, words, unless, value, mode, title_only)"


def concept_rows() -> str:
    rows = [(c, i, n) for c, names in V.CONCEPT_NAMES.items() for i, n in enumerate(names)]
    body = ", ".join(f"({lit(c)}, {i}, {lit(n)})" for c, i, n in rows)
    return f"SELECT * FROM (VALUES {body}) AS k(concept, priority, name)"


FED = (
    "SELECT cat, concept, arg_min(char_name, priority) AS attribute FROM attrs JOIN concept_names k "
    "ON attrs.char_name = k.name OR attrs.char_key = lower(rtrim(k.name, ':')) GROUP BY cat, concept"
)
# description text without its markup, for the fixture's one marked-up description
VISIBLE = (
    "SELECT *, trim(regexp_replace(replace(regexp_replace(coalesce(description, ''), '<[^>]+>', ' ', 'g'), '&amp;', '&'), "
    "'\\s+', ' ', 'g')) AS visible FROM fx_offers"
)
# what a rule yields per category and attribute, null when its list does not take the value
RULE_VALUES = """
SELECT f.cat, f.attribute, r.concept, r.step, string_split(r.words, '|') AS words, string_split(r.unless, '|') AS unless, r.words = '' AS always,
  r.unless = '' AS no_unless, r.title_only,
  CASE r.mode WHEN 'exact' THEN max(v.value) FILTER (WHERE v.value = r.value)
    WHEN 'lower' THEN min(v.value) FILTER (WHERE lower(v.value) = r.value)
    ELSE coalesce(min(v.value) FILTER (WHERE lower(v.value) = lower(r.value)),
      CASE WHEN count(v.value) = 0 AND r.concept IN ('base_color', 'material', 'sport', 'closure_system') THEN r.value END) END AS value
FROM fed f JOIN word_rules r ON r.concept = f.concept LEFT JOIN vals v ON v.cat = f.cat AND v.char_name = f.attribute
GROUP BY f.cat, f.attribute, r.concept, r.step, r.words, r.unless, r.title_only, r.mode, r.value"""
_RUN = "concat(' ', array_to_string(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'), ' '), ' ')"
TEXTS = (
    f"SELECT offer_id, cat, {_RUN.format('title')} AS title_run, "
    + _RUN.format("concat(title, ' ', visible)") + " AS text_run FROM live"
)
# first accepted proposal per offer and concept; static rules, then size and age from the text
DETECTED = """
SELECT offer_id, cat, concept, attribute AS char_name, arg_min(value, step) AS value FROM (
  SELECT o.offer_id, o.cat, r.concept, r.attribute, r.step, r.value
  FROM texts o JOIN rule_values r ON r.cat = o.cat AND r.value IS NOT NULL
  WHERE (r.always OR len(list_filter(r.words, lambda w: contains(CASE WHEN r.title_only THEN o.title_run ELSE o.text_run END, w))) > 0)
    AND (r.no_unless OR len(list_filter(r.unless, lambda w: contains(o.text_run, w))) = 0)
  UNION ALL
  SELECT o.offer_id, o.cat, 'size', f.attribute, 0, v.value
  FROM live o JOIN fed f ON f.cat = o.cat AND f.concept = 'size'
  JOIN vals v ON v.cat = o.cat AND v.char_name = f.attribute AND v.value = concat(regexp_extract(o.title, ' - ([0-9]+)$', 1), ' EU')
  UNION ALL
  SELECT o.offer_id, o.cat, 'age', f.attribute, 0, v.value
  FROM live o JOIN fed f ON f.cat = o.cat AND f.concept = 'age'
  JOIN vals v ON v.cat = o.cat AND v.char_name = f.attribute AND v.value = regexp_extract(lower(o.visible), '([0-9]+-[0-9]+\\s*ani)', 1)
) p WHERE value IS NOT NULL GROUP BY offer_id, cat, concept, attribute"""
