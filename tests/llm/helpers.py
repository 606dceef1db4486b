"""Small tables with the odd cases every operator must stand."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra: str = ""):
    """rows: (doc_id, text[, lang[, source]])."""
    full = []
    for r in rows:
        r = (*r, *[None] * (4 - len(r)))
        full.append((*r, None if r[1] is None else len(r[1])))
    return spark.createDataFrame(full, DOCS).coalesce(2)


def rows_of(frame) -> list[tuple]:
    return sorted((tuple(r) for r in frame.collect()), key=repr)
