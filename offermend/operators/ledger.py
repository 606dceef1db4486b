"""What became of every line and field that was asked: replies joined back to the offers they answer.

A ledger is a table with one row per thing asked and its ``state``:

``sent`` (no reply yet), ``answered``, ``missing`` (the reply leaves it out or blank), ``timed_out`` (the call was
given up), ``late`` (the reply came after that, or after the deadline: its text is shown but not used), and for
fields also ``unasked`` (the reply names something that was not asked).

Defined results: an unreadable reply is one that leaves everything out; of several replies to one batch the earliest
counts, equal ones in text order; a reply to a batch that was never sent is no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offermend import fixed_values as V
from offermend.functions.replies import parse_json_reply
from offermend.functions.text import strip

_ANSWERS = "map<string,string>"


def _verdicts(replies: DataFrame, key: str) -> DataFrame:
    """One row per key: ``answers`` of the earliest reply (null if none came), when it came and when the call was given up.

    ``replies``: key, reply, replied_at and optionally timed_out; a given-up call has its time in ``replied_at``.
    """
    gave_up = F.coalesce("timed_out", F.lit(False)) if "timed_out" in replies.columns else F.lit(False)
    rows = replies.withColumn("_up", gave_up)
    came = ~F.col("_up") & F.col("reply").isNotNull()
    # a reply without a time stands behind those with one
    order = F.struct(F.col("replied_at").isNull().alias("a"), F.col("replied_at").alias("b"), F.col("reply").alias("c"))
    earliest = F.min_by("reply", F.when(came, order))
    return rows.groupBy(key).agg(
        F.when(F.max(came), parse_json_reply(earliest)).cast(_ANSWERS).alias("_answers"),
        F.min(F.when(came, F.col("replied_at"))).alias("_came"),
        F.max("_up").alias("_gave_up"), F.min(F.when(F.col("_up"), F.col("replied_at"))).alias("_up_at"),
    )


def _state(value: Column, seconds: float | None) -> Column:
    """State of one thing asked, from its batch's verdict and its own answer."""
    late = F.col("_gave_up") & (F.col("_up_at").isNull() | F.col("_came").isNull() | (F.col("_up_at") <= F.col("_came")))
    if seconds is not None:
        late = late | (F.col("_came") > F.col("sent_at") + F.make_dt_interval(secs=F.lit(float(seconds))))
    return (
        F.when(F.col("_answers").isNull(), F.when(F.col("_gave_up"), F.lit("timed_out")).otherwise(F.lit("sent")))
        .when(F.coalesce(late, F.lit(False)), F.lit("late"))
        .when(value.isNull(), F.lit("missing"))
        .otherwise(F.lit("answered"))
    )


def category_ledger(sent: DataFrame, replies: DataFrame, seconds: float | None = None) -> DataFrame:
    """Every line of the category requests with ``state`` and ``suggested``, the text said about it.

    ``sent``: batch, line, offer_id (see ``suggest.batches``) and, where ``seconds`` sets a deadline, sent_at.
    ``replies``: batch, reply (``{"1": "name", …}``), replied_at and optionally timed_out. A line's number may be
    written with blanks or leading zeros. A batch's reply has as many entries as the batch has lines, so each row
    looks its line up in it.
    """
    rows = sent.join(_verdicts(replies, "batch"), "batch", "left")
    wanted = F.col("line").cast("string")
    mine = F.filter(
        F.map_entries("_answers"),
        lambda e: (F.regexp_extract(strip(e["key"]), r"^0*([0-9]+)$", 1) == wanted) & (strip(e["value"]) != ""),
    )
    said = F.get(F.transform(mine, lambda e: strip(e["value"])), F.lit(0))
    told = rows.withColumn("suggested", said)
    return told.select(*sent.columns, _state(F.col("suggested"), seconds).alias("state"), "suggested")


def category_answers(ledger: DataFrame) -> DataFrame:
    """(offer_id, suggested) for ``Options.category_suggestions``: usable answers, and the mark of a call given up."""
    given_up = F.col("state").isin("timed_out", "late")
    rows = ledger.where(given_up | (F.col("state") == "answered"))
    return rows.groupBy("offer_id").agg(
        F.coalesce(F.min(F.when(~given_up, F.col("suggested"))), F.lit(V.TIMEOUT_MARK)).alias("suggested")
    )


def field_ledger(fields: DataFrame, replies: DataFrame, seconds: float | None = None) -> DataFrame:
    """(offer_id, position, char_input, value_input, state) of every field asked, and of those a reply adds.

    ``fields``: ``suggest.display_names`` of what was asked, with sent_at where ``seconds`` sets a deadline.
    ``replies``: offer_id, reply and replied_at, optionally timed_out. Names come back as shown or as they are;
    either way the row has the attribute's real name. A name that was not asked keeps its spelling.
    """
    verdicts = _verdicts(replies, "offer_id")
    at = ["sent_at"] if "sent_at" in fields.columns else []
    asked = fields.select("offer_id", "char_name", "display", "position", *at).join(verdicts, "offer_id", "left")
    blank = lambda c: F.when(strip(c) != "", strip(c))
    value = F.coalesce(blank(F.try_element_at("_answers", F.col("display"))), blank(F.try_element_at("_answers", F.col("char_name"))))
    own = asked.withColumn("value_input", value).select(
        "offer_id", F.col("position").cast("int").alias("position"), F.col("char_name").alias("char_input"), "value_input",
        _state(F.col("value_input"), seconds).alias("state"),
    )
    names = fields.groupBy("offer_id").agg(F.flatten(F.collect_list(F.array("display", "char_name"))).alias("_names"))
    others = verdicts.where("NOT coalesce(_gave_up, false)").select("offer_id", F.posexplode("_answers").alias("position", "char_input", "value_input"))
    others = others.join(names, "offer_id").where(~F.coalesce(F.array_contains("_names", F.col("char_input")), F.lit(False)))
    return own.unionByName(others.select("offer_id", "position", "char_input", strip("value_input").alias("value_input"), F.lit("unasked").alias("state")))


def field_answers(ledger: DataFrame) -> DataFrame:
    """(offer_id, position, char_input, value_input) for ``Options.suggestions``."""
    used = ledger.where("state IN ('answered', 'unasked') AND value_input <> ''")
    return used.select("offer_id", "position", "char_input", "value_input")


def ledger_summary(ledger: DataFrame, *by: str) -> DataFrame:
    """Rows per state."""
    return ledger.groupBy(*by, "state").agg(F.count("*").alias("n"))
