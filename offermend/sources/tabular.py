"""Reading category, attribute, value and offer files with loosely named headers."""

from __future__ import annotations

import csv
import io
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offermend import fixed_values as V
from offermend.functions.text import null_if_blank, strip
from offermend.sources import splits

ORDINAL = "ordinal"


def header_names(record: str, sep: str) -> list[str]:
    """Column names of a header row: empty ones by place, repeated ones (whatever their case) with their place."""
    names = next(csv.reader(io.StringIO(record, newline=""), delimiter=sep), [])
    times = Counter(n.lower() for n in names)
    return [f"_c{i}" if not n else f"{n}{i}" if times[n.lower()] > 1 else n for i, n in enumerate(names)]


def read_tabular(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """CSV or TSV by extension, every cell a string; bytes that are not UTF-8 are replaced.

    Cells may hold line breaks within quotes; a file is read by as many tasks as it has byte ranges.
    The first row of each file is a header, the first file's names count. ``numbered`` adds the row
    number ``ordinal`` in order of file name and row, which first-wins and last-wins rules refer to:
    the rows themselves come in no order.
    """
    sep = "\t" if path.lower().rstrip("/").endswith(".tsv") else ","
    records = splits.rows_of(spark, path, sep)
    first = records.where("number = 0").first()
    if first is None:
        return spark.createDataFrame([], "ordinal long" if numbered else "")
    columns = header_names(first["record"].removeprefix("\ufeff"), sep)
    # a cell is missing where the row is too short; names may hold anything
    kinds = ", ".join(f"c{i} string" for i in range(len(columns)))
    rows = records.where("in_file > 0").select("number", F.from_csv("record", kinds, {"sep": sep, "escape": '"', "mode": "PERMISSIVE"}).alias("r"))
    cells = [F.col(f"r.c{i}").alias(c) for i, c in enumerate(columns)]
    return drop_blank_rows(rows.select(*cells, (F.col("number") - 1).alias(ORDINAL))) if numbered else drop_blank_rows(rows.select(*cells))


def drop_blank_rows(frame: DataFrame) -> DataFrame:
    """Rows with at least one cell; headers may hold dots, so columns are quoted."""
    cells = [F.col(f"`{c}`").cast("string") for c in frame.columns if c != ORDINAL]
    return frame.where(F.coalesce(*cells).isNotNull()) if cells else frame


def with_ordinal(frame: DataFrame) -> DataFrame:
    """Rows numbered in the order of the scan, for frames that have no number of their own.

    Numbers are made in the scan itself and are the same on every run of immutable files, but several
    files follow in the order that the scan packs them: ``read_tabular`` with ``numbered`` has them in
    file order.
    """
    return frame.withColumn(ORDINAL, F.monotonically_increasing_id())


@dataclass
class Concatenated:
    rows: DataFrame | None
    skipped: list[str] = field(default_factory=list)


def concat_same_schema(parts: list[tuple[str, DataFrame]]) -> Concatenated:
    """Named parts whose header equals the first data part's, put together.

    Parts without rows, and parts whose first header is a query text, are no data parts. Headers
    are compared on the driver; rows are not touched there.
    """
    chosen, header, skipped = [], None, []
    for name, part in parts:
        first = part.columns[0].strip().upper() if part.columns else ""
        rows = drop_blank_rows(part)
        if not part.columns or first.startswith(("SELECT", "--", "/*")) or rows.isEmpty():
            skipped.append(name)
        elif header is None or part.columns == header:
            header = part.columns
            chosen.append(rows)
        else:
            skipped.append(name)
    out = None
    for i, rows in enumerate(chosen):
        if ORDINAL in rows.columns:  # part by part
            rows = rows.withColumn(ORDINAL, F.col(ORDINAL) + F.lit(i << 40))
        out = rows if out is None else out.unionByName(rows)
    return Concatenated(out, skipped)


def find_column(columns: list[str], aliases: list[str]) -> str | None:
    """First alias that matches a header without case and outer spaces."""
    known = {c.lower().strip(): c for c in columns}
    return next((known[a.lower()] for a in aliases if a.lower() in known), None)


def alias_columns(frame: DataFrame, aliases: dict[str, list[str]]) -> dict[str, str | None]:
    return {name: find_column(frame.columns, options) for name, options in aliases.items()}


def autodetect_external_id(columns: list[str], reserved: list[str | None]) -> str | None:
    """First column ending in ``_id`` that has no other role."""
    taken = {c.lower() for c in reserved if c}
    return next((c for c in columns if c.lower().endswith("_id") and c.lower() not in taken), None)


def _pick(mapping: dict[str, str | None], name: str, default: Column | None = None) -> Column:
    found = mapping[name]
    column = F.col(f"`{found}`") if found else (default if default is not None else F.lit(None))
    return column.cast("string")


def _ordered(frame: DataFrame) -> DataFrame:
    return frame if ORDINAL in frame.columns else with_ordinal(frame)


def load_categories(frame: DataFrame) -> DataFrame:
    """category_id, external_id, category_name, parent_category_id, ordinal; rows need id and name."""
    frame = _ordered(frame)
    m = alias_columns(frame, V.CATEGORY_ALIASES)
    m["external_id"] = m["external_id"] or autodetect_external_id(frame.columns, [m["id"], m["parent_id"]])
    rows = frame.select(
        _pick(m, "id").alias("category_id"), _pick(m, "external_id", _pick(m, "id")).alias("external_id"),
        _pick(m, "name").alias("category_name"), _pick(m, "parent_id").alias("parent_category_id"), ORDINAL,
    )
    return rows.where("category_id IS NOT NULL AND category_name IS NOT NULL")


def load_characteristics(frame: DataFrame) -> DataFrame:
    """Attribute rows with defaults: id = row number, external id = id, optional, restrictive."""
    from offermend.functions.text import truthy

    frame = _ordered(frame)
    m = alias_columns(frame, V.CHARACTERISTIC_ALIASES)
    own = _pick(m, "id", F.col(ORDINAL))
    rows = frame.select(
        own.alias("characteristic_id"), _pick(m, "characteristic_id", own).alias("external_characteristic_id"),
        _pick(m, "category_id").alias("category_id"), _pick(m, "name").alias("characteristic_name"),
        truthy(_pick(m, "mandatory", F.lit("0"))).alias("mandatory"), truthy(_pick(m, "restrictive", F.lit("1"))).alias("restrictive"), ORDINAL,
    )
    return rows.where("category_id IS NOT NULL AND characteristic_name IS NOT NULL")


def load_values(frame: DataFrame) -> DataFrame:
    """Value rows; only the value itself is required, the category may be joined later."""
    frame = _ordered(frame)
    m = alias_columns(frame, V.VALUE_ALIASES)
    rows = frame.select(
        _pick(m, "category_id").alias("category_id"), _pick(m, "characteristic_id").alias("characteristic_id"),
        _pick(m, "characteristic_name").alias("characteristic_name"), _pick(m, "value").alias("value"), ORDINAL,
    )
    return rows.where("value IS NOT NULL")


NAME_HEADER = re.compile(r"offer\s+ch\.\s*(\d+)\s+name")
VALUE_HEADER = r"offer\s+ch\.\s*{}\s+val"


def attribute_pairs(columns: list[str]) -> list[tuple[str, str]]:
    """(name column, value column) of each attribute slot, in file order."""
    pairs, seen = [], set()
    for column in columns:
        match = NAME_HEADER.match(column.lower().strip())
        if match and match.group(1) not in seen:
            pattern = re.compile(VALUE_HEADER.format(match.group(1)))
            value = next((c for c in columns if pattern.match(c.lower().strip())), None)
            if value:
                seen.add(match.group(1))
                pairs.append((column, value))
    return pairs


def fold_existing_chars(pairs: list[tuple[str, str]]) -> Column:
    """Name and value columns as one map; blank names go, blank values become null, and the last of
    two equal names wins at the first one's place."""
    empty = F.create_map().cast("map<string,string>")
    if not pairs:
        return empty
    entries = F.array(
        *[F.struct(strip(F.col(f"`{n}`")).alias("name"), null_if_blank(F.col(f"`{v}`")).alias("value")) for n, v in pairs]
    )
    named = F.filter(entries, lambda e: F.coalesce(null_if_blank(e["name"]), F.lit("")) != "")
    names = F.array_distinct(F.transform(named, lambda e: e["name"]))
    last = lambda n: F.element_at(F.filter(named, lambda e: e["name"] == n), -1)["value"]
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, last(n))))


def read_offers(frame: DataFrame, numbered: bool = True) -> DataFrame:
    """Offer rows in the ``OFFERS`` schema from an export with any of the known headers.

    The row number only serves display order; ``numbered=False`` leaves it null.
    """
    frame = drop_blank_rows(frame)
    frame = _ordered(frame) if numbered else frame.withColumn(ORDINAL, F.lit(None).cast("bigint"))
    m = alias_columns(frame, V.OFFER_ALIASES)
    pairs = attribute_pairs(frame.columns)
    return frame.select(*[_pick(m, name).alias(name) for name in V.OFFER_ALIASES], fold_existing_chars(pairs).alias("existing_chars"), ORDINAL)
