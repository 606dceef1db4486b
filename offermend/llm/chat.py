"""Chat formatting: a finite-state machine over roles, and text segments with loss flags.

The template is data: how a turn opens and ends, the escape, which roles are trained on, and which
role may follow which. Turns are sorted within each conversation and streamed: the machine's state is
the last role, so a conversation of any length passes through in constant memory. Each turn makes
three segments (opening, text, end); only the text of a trained role carries the loss flag. Control
strings inside a text are escaped, so that ``read_back`` recovers every turn from the segments' text
alone.

Defined results: null role or text counts as empty; a null conversation id is one conversation; rows
sort by turn, then role and text, nulls first, so rows that repeat are separate turns; an unknown role
is written under the template's general opening and breaks the turn order; an empty table gives no segments. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    openings: dict[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other: tuple[str, str] = ("### Role ", ": ")
    end: str = "</turn>\n"
    escape: str = "\\"
    controls: tuple[str, ...] = ("###", "</turn>")
    trained: frozenset[str] = frozenset({"assistant"})
    #: state -> roles that may come next; "" is the start
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: frozenset[str] = frozenset({"assistant"})

    def _units(self, extra: str = "") -> str:
        return "|".join(re.escape(c) for c in (self.escape, *self.controls, *extra))

    def hide(self, text: str, extra: str = "") -> str:
        return re.sub(self._units(extra), lambda m: self.escape + m[0], text)

    def show(self, text: str, extra: str = "") -> str:
        return re.sub(f"{re.escape(self.escape)}({self._units(extra)})", lambda m: m[1], text)

    def opening(self, role: str) -> str:
        return self.openings.get(role) or self.other[0] + self.hide(role, self.other[1][0]) + self.other[1]

    def role(self, opening: str) -> str:
        known = {v: k for k, v in self.openings.items()}
        return known[opening] if opening in known else self.show(opening[len(self.other[0]):len(opening) - len(self.other[1])], self.other[1][0])

    def allows(self, state: str, role: str) -> bool:
        return role in self.moves.get(state, ())

    def turns(self) -> re.Pattern:
        """One turn of formatted text: opening, escaped text."""
        e, stop = re.escape(self.escape), re.escape(self.end.rstrip("\n"))
        first = re.escape(self.end[0])
        body = f"(?:[^{e}{first}]++|{e}(?:{self._units()})|{first}(?!{stop[len(first):]}))*+"
        named = "|".join(re.escape(o) for o in self.openings.values())
        close = self.other[1][0]
        general = f"{re.escape(self.other[0])}(?:[^{e}{re.escape(close)}]++|{e}(?:{self._units(close)}))*+{re.escape(self.other[1])}"
        return re.compile(f"({named}|{general})({body}){re.escape(self.end)}", re.S)


TEMPLATE = Template()


def _in_order(rows: DataFrame, conv: str, *order: str) -> DataFrame:
    return rows.repartition(conv).sortWithinPartitions(conv, *order)


def segments(turns: DataFrame, template: Template = TEMPLATE, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, seq, turn_no, part, text, loss, in_order: the formatted text in ``seq`` order; in_order is the machine's verdict on the turn."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, number, state = object(), 0, ""
        for batch in batches:
            out = []
            for key, who, said in zip(batch["c"].tolist(), batch["r"].tolist(), batch["x"].tolist(), strict=True):
                if key != now:
                    now, number, state = key, 0, ""
                ok = template.allows(state, who)
                for part, piece in enumerate((template.opening(who), template.hide(said), template.end)):
                    out.append((key, 3 * number + part, number, ("opening", "text", "end")[part], piece, part == 1 and who in template.trained, ok))
                number, state = number + 1, who
            yield pd.DataFrame(out, columns=["c", "seq", "turn_no", "part", "text", "loss", "in_order"])

    kind = turns.schema[conv].dataType.simpleString()
    # the id travels as text: pandas would turn a long column with a null into floats
    rows = turns.select(F.coalesce(F.col(conv).cast("string"), F.lit("")).alias("c"), F.col(turn).alias("t"), F.coalesce(role, F.lit("")).alias("r"), F.coalesce(text, F.lit("")).alias("x"))
    made = _in_order(rows, "c", "t", "r", "x").select("c", "r", "x").mapInPandas(run, "c string, seq long, turn_no long, part string, text string, loss boolean, in_order boolean")
    return made.withColumn("c", F.when(F.col("c") != "", F.col("c")).cast(kind)).withColumnRenamed("c", conv)


def read_back(made: DataFrame, template: Template = TEMPLATE, conv: str = "conv_id") -> DataFrame:
    """Per conversation what its formatted text says: counts and digests of turns and of what is trained on, and the machine's verdict.

    Only the segments' text and loss flags are used; roles and texts come out of the formatted text.
    """
    pattern = template.turns()

    class Tally:
        def __init__(self, key: str):
            self.key, self.turns, self.loss, self.chars, self.buffer = key, 0, 0, 0, ""
            self.all, self.trained, self.state, self.valid = hashlib.sha256(), hashlib.sha256(), "", True

        def add(self, piece: str, loss: bool) -> None:
            self.chars += len(piece)
            self.buffer += piece
            if loss:
                shown = template.show(piece)
                self.loss += len(shown)
                self.trained.update(shown.encode())
            if piece.endswith(template.end) and (m := pattern.fullmatch(self.buffer)):
                who, said = template.role(m[1]), template.show(m[2])
                self.all.update(f"{who}\n{said}\n".encode())
                self.valid &= template.allows(self.state, who)
                self.turns, self.state, self.buffer = self.turns + 1, who, ""

        def row(self) -> tuple:
            if self.buffer:
                raise ValueError(f"conversation {self.key}: formatted text that is no turn")
            return self.key, self.turns, self.all.hexdigest(), self.loss, self.trained.hexdigest(), self.chars, self.valid, self.valid and self.state in template.final

    names = ["c", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "in_order", "complete"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally = None
        for batch in batches:
            out = []
            for key, piece, loss in zip(batch["c"].tolist(), batch["text"].tolist(), batch["loss"].tolist(), strict=True):
                if tally is None or tally.key != key:
                    if tally is not None:
                        out.append(tally.row())
                    tally = Tally(key)
                tally.add(piece, loss)
            yield pd.DataFrame(out, columns=names)
        if tally is not None:
            yield pd.DataFrame([tally.row()], columns=names)

    kind = made.schema[conv].dataType.simpleString()
    rows = made.select(F.coalesce(F.col(conv).cast("string"), F.lit("")).alias("c"), "seq", "text", "loss")
    schema = "c string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, in_order boolean, complete boolean"
    told = _in_order(rows, "c", "seq").select("c", "text", "loss").mapInPandas(run, schema)
    return told.withColumn("c", F.when(F.col("c") != "", F.col("c")).cast(kind)).withColumnRenamed("c", conv)
