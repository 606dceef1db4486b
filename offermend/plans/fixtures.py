"""Offer-domain tables derived from the star-schema test tables.

Reference data come from ``part``, offers from ``events`` joined with ``part``. The same SQL text,
with ``STRING`` read as ``VARCHAR``, gives the tables in an ANSI engine, which the check queries use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from offermend.operators.indexes import ReferenceIndex

# attributes every category has: number, name, mandatory, restrictive
ATTRIBUTES = [
    (1, "Color:", True, True),
    (2, "Size", True, True),
    (3, "Kind:", False, True),
    (4, "Note", True, False),
    (5, "Brand", False, False),
    (6, "Culoare de baza", False, True),
    (7, "Material:", False, True),
    (8, "Sezon:", True, True),
    (9, "Pentru:", False, True),
    (10, "Sport:", False, True),
    (11, "Tip produs:", False, True),
    (12, "Croiala:", False, True),
    (13, "Lungime maneca:", False, True),
    (14, "Varsta:", False, True),
    (15, "Instructiuni ingrijire:", False, True),
    (16, "Crampoane detasabile:", False, True),
    (17, "Imprimeu:", False, True),
    (18, "Sistem inchidere:", False, True),
    (19, "Stil:", False, True),
    (20, "Tip inchidere:", False, True),
    (21, "Tip:", False, True),
]
# listed values that do not depend on the parts
LISTED = [
    (7, "Bumbac"), (7, "Mesh"), (8, "Toamna-Iarna"), (8, "Primavara-Vara"), (9, "Barbati"), (9, "Femei"),
    (9, "Copii"), (11, "Tricou"), (12, "Slim fit"), (12, "Lejer"), (13, "Maneca lunga"), (13, "Maneca scurta"),
    (14, "7-8 ani"), (15, "Compatibil masina spalat rufe"), (16, "N/A"), (17, "Logo"), (17, "Cu model"),
    (18, "Fermoar"), (18, "Siret"), (19, "Profil jos"), (19, "Profil inalt"), (20, "Fermoar"), (20, "Nasturi"),
    (21, "Lungi"), (21, "Scurti"),
]


def _values(rows, names: str) -> str:
    def lit(x) -> str:
        return str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") {names}"


NAME_OF = {n: name for n, name, _, _ in ATTRIBUTES}

SQL = {
    "fx_categories": """
SELECT concat('c', substr(md5(p_type), 1, 6)) AS category_id, concat('x', substr(md5(p_type), 1, 6)) AS external_id,
       p_type AS category_name, CAST(min(p_partkey) AS BIGINT) AS ordinal
FROM part GROUP BY p_type""",
    "fx_characteristics": f"""
SELECT concat(c.category_id, '-', k.n) AS characteristic_id, concat('e', k.n) AS external_characteristic_id,
       c.category_id, k.name AS characteristic_name, k.mandatory, k.restrictive, c.ordinal * 100 + k.n AS ordinal
FROM fx_categories c JOIN {_values(ATTRIBUTES, "AS k(n, name, mandatory, restrictive)")} ON k.n > 0""",
    "fx_values": f"""
SELECT category_id, concat(category_id, '-', n) AS characteristic_id, name AS characteristic_name, value, min(ordinal) AS ordinal
FROM (
  SELECT c.category_id, 1 AS n, 'Color' AS name, split_part(p.p_name, ' ', 1) AS value, CAST(p.p_partkey AS BIGINT) AS ordinal
  FROM part p JOIN fx_categories c ON c.category_name = p.p_type
  WHERE split_part(p.p_name, ' ', 1) IN ('red', 'blue', 'cold', 'hot')
  UNION ALL
  SELECT c.category_id, 2, 'Size', concat(CAST(p.p_size AS STRING), ' EU'), CAST(p.p_partkey AS BIGINT)
  FROM part p JOIN fx_categories c ON c.category_name = p.p_type WHERE p.p_size <= 40
  UNION ALL
  SELECT c.category_id, 3, 'Kind:', split_part(p.p_name, ' ', 2), CAST(p.p_partkey AS BIGINT)
  FROM part p JOIN fx_categories c ON c.category_name = p.p_type WHERE split_part(p.p_name, ' ', 2) <> 'rod'
  UNION ALL
  SELECT c.category_id, 6, 'Culoare de baza', CASE split_part(p.p_name, ' ', 1) WHEN 'red' THEN 'Rosu' ELSE 'Albastru' END,
         CAST(p.p_partkey AS BIGINT)
  FROM part p JOIN fx_categories c ON c.category_name = p.p_type
  WHERE split_part(p.p_name, ' ', 1) IN ('red', 'blue')
  UNION ALL
  SELECT c.category_id, k.n, k.name, k.value, c.ordinal
  FROM fx_categories c JOIN {_values([(n, NAME_OF[n], v) for n, v in LISTED], "AS k(n, name, value)")} ON k.n > 0
) v GROUP BY category_id, n, name, value""",
    "fx_offers": """
SELECT CAST(e.event_id AS STRING) AS offer_id, e.event_id AS ordinal, e.ts,
       concat(p.p_name, ' - ', CAST(p.p_size AS STRING)) AS title, p.p_brand AS brand,
       CASE WHEN e.event_id % 4 <> 0 THEN concat('ean', CAST(e.user_id AS STRING)) END AS ean,
       CASE e.event_type WHEN 'error' THEN '1007 - category not found' WHEN 'view' THEN '1009 - mandatory missing'
                         WHEN 'click' THEN '1010 - invalid value' WHEN 'signup' THEN '2001 - other' END AS error,
       CASE e.event_type
         WHEN 'error' THEN '<p>Cotton t-shirt for men, <b>slim fit</b>, long sleeve &amp; lightweight</p>'
         WHEN 'view' THEN 'Mesh top, short sleeve, women, oversized, zipper, graphic'
         WHEN 'click' THEN 'Winter running tee for kids 7-8 ani, low, button, laces, shorts'
         WHEN 'signup' THEN 'Warm fleece, long, logo' END AS description,
       CASE WHEN e.event_id % 7 = 0 THEN '' WHEN e.event_id % 11 = 0 THEN lower(p.p_type)
            WHEN e.event_id % 13 = 0 THEN 'UNKNOWN' ELSE p.p_type END AS category,
       CASE WHEN e.event_id % 2 = 0 THEN split_part(p.p_name, ' ', 1) END AS color,
       CASE WHEN e.event_id % 3 = 0 THEN concat(CAST(p.p_size AS STRING), ' EU') END AS size_value,
       CASE WHEN e.event_id % 4 = 1 THEN upper(split_part(p.p_name, ' ', 2)) END AS kind_value,
       CASE WHEN e.event_id % 5 = 0 THEN 'x' END AS foreign_value
FROM events e JOIN part p ON p.p_partkey = e.event_id % (SELECT count(*) FROM part)""",
    "fx_attributes": """
SELECT offer_id, category, 'Color' AS char_name, color AS value FROM fx_offers WHERE color IS NOT NULL
UNION ALL SELECT offer_id, category, 'Size', size_value FROM fx_offers WHERE size_value IS NOT NULL
UNION ALL SELECT offer_id, category, 'Kind', kind_value FROM fx_offers WHERE kind_value IS NOT NULL
UNION ALL SELECT offer_id, category, 'Foreign', foreign_value FROM fx_offers WHERE foreign_value IS NOT NULL""",
    "fx_run_log": """
SELECT CAST(event_id AS STRING) AS run_id, event_type AS marketplace, ts AS created_at,
       CAST(user_id % 4 AS INT) AS fields_accepted, CAST(user_id % 5 AS INT) AS fields_requested,
       CAST(event_id % 3 AS INT) AS retry_count, event_id % 6 = 0 AS fallback_used, value AS cost_usd,
       CASE event_id % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'shadow' ELSE 'on' END AS structured_mode,
       event_id % 2 = 0 AS structured_attempted, event_id % 4 = 0 AS structured_success,
       event_id % 8 = 2 AS structured_fallback_used, CAST(user_id % 700 AS INT) AS structured_latency_ms,
       concat('model-', CAST(user_id % 3 AS STRING)) AS structured_model_used
FROM events""",
}


def view_sql(*names: str) -> str:
    """``WITH`` prefix that defines the named tables and what they build on, for the check engine."""
    needs = {
        "fx_characteristics": ["fx_categories"],
        "fx_values": ["fx_categories"],
        "fx_attributes": ["fx_offers"],
    }
    wanted: list[str] = []
    for name in names:
        for n in [*needs.get(name, []), name]:
            if n not in wanted:
                wanted.append(n)
    body = ",\n".join(f"{n} AS ({SQL[n]}\n)" for n in wanted)
    return ("WITH " + body).replace("AS STRING)", "AS VARCHAR)")


def load(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Register the test tables and the derived views; return the views by name."""
    for name in ("part", "events"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    # one count up front instead of a scalar subquery repeated in every plan that reads the offers
    n_parts = str(spark.table("part").count())
    frames = {}
    for name, text in SQL.items():
        frames[name] = spark.sql(text.replace("(SELECT count(*) FROM part)", n_parts))
        frames[name].createOrReplaceTempView(name)
    return frames


def reference(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], ReferenceIndex]:
    fx = load(spark, sf_dir)
    index = ReferenceIndex.build(fx["fx_categories"], fx["fx_characteristics"], fx["fx_values"])
    return fx, index.persist()
