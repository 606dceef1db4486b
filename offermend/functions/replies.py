"""Model replies: JSON text to attribute rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offermend.functions.text import bound, strip


def _unfenced(c: Column) -> Column:
    text = F.regexp_replace(strip(c), r"^```(?:json)?\s*", "")
    return F.regexp_replace(text, r"\s*```$", "")


def parse_json_reply(c: Column | str, strict: bool = False) -> Column:
    """Map of a reply's fields (nested values stay JSON text); empty for anything but an object.

    The whole text is tried first, then its outermost ``{...}`` (``strict``: the first flat one).
    """
    c = F.col(c) if isinstance(c, str) else c

    def parsed(t: Column) -> Column:
        return F.when(t.rlike(r"(?s)^\s*\{.*\}\s*$"), F.from_json(t, "map<string,string>"))

    inner = r"(\{[^{}]*\})" if strict else r"(?s)(\{.*\})"
    reply = bound(
        _unfenced(F.coalesce(c, F.lit(""))),
        lambda t: F.coalesce(parsed(t), parsed(F.nullif(F.regexp_extract(t, inner, 1), F.lit("")))),
    )
    return F.map_filter(
        F.coalesce(reply, F.create_map().cast("map<string,string>")), lambda k, v: (k != "_reasoning") & v.isNotNull()
    )


def reply_rows(replies: DataFrame, reply: str = "reply", strict: bool = False) -> DataFrame:
    """One row per field: every other column, position, char_input, raw value text."""
    others = [c for c in replies.columns if c != reply]
    return replies.select(*others, F.posexplode(parse_json_reply(reply, strict)).alias("position", "char_input", "value_input"))


def array_items(value: Column) -> Column:
    """Elements of a value that is a JSON array, null for any other value."""
    return F.when(value.rlike(r"(?s)^\s*\["), F.from_json(value, "array<string>"))
