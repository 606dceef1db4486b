"""Visible text of markup; an Arrow function because entities and raw-text elements need a parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offermend.functions import ship_by_value
from offermend.functions.text import _col, collapse_spaces

ship_by_value(__name__)

# elements whose content is not shown
HIDDEN = ("script", "style", "template")


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in HIDDEN

    def handle_endtag(self, tag):
        self.hidden -= tag in HIDDEN and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.pieces.append(data.strip())


def visible_text(markup: str) -> str:
    parser = _Visible()
    parser.feed(markup)
    parser.close()
    return " ".join(" ".join(parser.pieces).split())


@F.pandas_udf(T.StringType())
def _visible_text(markup: pd.Series) -> pd.Series:
    return markup.map(visible_text, na_action="ignore")


def strip_html(c: Column | str) -> Column:
    """Visible text with single spaces. Text without markup or entities never leaves the JVM."""
    c = F.coalesce(_col(c), F.lit(""))
    marked = c.contains("<") | c.contains("&")
    return F.when(marked, _visible_text(F.when(marked, c))).otherwise(collapse_spaces(c))
