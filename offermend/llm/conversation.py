"""Conversation structure repair by the cheapest edits, with Four-Russians block tables.

A conversation's roles must read system (at most one, first), then user and assistant in turn, the
assistant last. A row is a symbol: the initial of its role, whether its text is cut short, or that it must
go (blank, or said before). The cost that is still to come, for each of the four states a conversation can
be in, is a vector; less its least entry it is one of a few normalised vectors. ``Tables`` finds them all,
and what every block of ``BLOCK`` symbols makes of each: next vector and cost added. A conversation is
read once into one byte a row, its blocks are looked up from the last to the first, and then each block is
expanded backward from the vector at its end, which tells in every state which edits lie on a cheapest
way; the first in order of their letters (D, I, K, R) is taken.

Rows are dealt by conversation and streamed in order. Faults and symbols are columns made in the JVM; a
first stream sees symbols alone and hands out the edits in pieces of ``PIECE`` rows, a second one merges
them with the texts in the same order, so that of a conversation of any length only a byte a row (as much
as its audit) and one piece are in memory, never its texts.

Defined results: null role, text, and in the damage's key null id or turn, read as one space; rows sort by
turn (nulls first), then role and a digest of the text, so rows that repeat are adjacent and all but the
first are duplicates; rows with a null id are one conversation; an empty or unknown role has no legal
place and is renamed or goes. A conversation without rows has zeros, an empty audit and the digest of the
empty string. Texts may have any length. An empty table has an empty result. Columns of the input other
than id, turn, role and text are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from offermend.session import staged

#: Costs of the edits, and of leaving a text that is cut short.
RENAME, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
BLOCK = 3
PIECE = 4096
#: States: nothing yet, after system, after user, after assistant; the role that may be put in next, and the state it leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
ACCEPTS = {START, ASSISTANT}
KEEP = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
#: A symbol is 2 * initial + cut short; the last one must go.
INITIALS = "sua?"
MUST_GO = 2 * len(INITIALS)
SYMBOLS = MUST_GO + 1


def _closed(costs: list[int]) -> tuple[int, ...]:
    """The costs where rows may also be put in."""
    now = list(costs)
    for _ in range(4):
        now = [min(now[q], INSERT + now[NEXT[q][1]]) for q in range(4)]
    return tuple(now)


FINAL = _closed([0 if q in ACCEPTS else 10**6 for q in range(4)])


def _options(symbol: int, q: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state) of the edits that consume a row, in order of their letters."""
    out = [("D", DELETE, q)]
    if symbol != MUST_GO:
        extra = CUT_SHORT * (symbol % 2)
        kept = KEEP.get((INITIALS[symbol // 2], q))
        if kept is not None:
            out.append(("K", extra, kept))
        out.append(("R", RENAME + extra, NEXT[q][1]))
    return out


class Tables:
    """All normalised vectors, and the transition of every block of symbols on each."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.vectors: list[tuple[int, ...]] = [_normal(FINAL)[0]]
        number = {self.vectors[0]: 0}
        step: list[list[tuple[int, int]]] = []
        while len(step) < len(self.vectors):
            v = self.vectors[len(step)]
            row = []
            for symbol in range(SYMBOLS):
                w, least = _normal(_closed([min(c + v[to] for _, c, to in _options(symbol, q)) for q in range(4)]))
                if w not in number:
                    number[w] = len(self.vectors)
                    self.vectors.append(w)
                row.append((number[w], least))
            step.append(row)
        both = np.array(step, dtype=np.int64)
        self.next, self.add = both[..., 0], both[..., 1]
        # blocks by their code, the first symbol the most significant: one symbol more in front at a time
        self.block_next, self.block_add = self.next, self.add
        for _ in range(block - 1):
            after, so_far = self.block_next, self.block_add
            self.block_next = np.stack([self.next[after, s] for s in range(SYMBOLS)], axis=1).reshape(len(self.vectors), -1)
            self.block_add = np.stack([so_far + self.add[after, s] for s in range(SYMBOLS)], axis=1).reshape(len(self.vectors), -1)
        self.expand = functools.cache(self._expand)
        self._next, self._add = self.block_next.tolist(), self.block_add.tolist()

    def _expand(self, v: int, symbols: bytes, q: int) -> tuple[tuple[str, ...], int]:
        """The edits of a block whose end has vector ``v``, entered in state ``q``: the letters of each row, and the state it is left in."""
        behind = [v]
        for s in reversed(symbols):
            behind.append(int(self.next[behind[-1], s]))
        out = []
        for i, s in enumerate(symbols):
            here, after = self.vectors[behind[len(symbols) - i]], self.vectors[behind[len(symbols) - i - 1]]
            add = int(self.add[behind[len(symbols) - i - 1], s])
            letters = ""
            while True:
                left = here[q] + add
                options = [(a, to) for a, c, to in _options(s, q) if c + after[to] == left]
                if INSERT + here[NEXT[q][1]] + add == left:
                    options.append(("I", NEXT[q][1]))
                letter, q = min(options)
                letters += letter
                if letter != "I":
                    break
            out.append(letters)
        return tuple(out), q

    def repair(self, symbols: bytes) -> tuple[int, list[str]]:
        """Cost, and the letters of each row's edits (what is put in before it comes first); what is put in at the end is the last item."""
        t, n = self.block, len(symbols)
        front = n % t
        ends, v, cost = [], 0, 0
        for at in range(n - t, front - 1, -t):
            ends.append(v)
            code = 0
            for s in symbols[at:at + t]:
                code = code * SYMBOLS + s
            v, cost = self._next[v][code], cost + self._add[v][code]
        middle = v
        for s in reversed(symbols[:front]):
            v, cost = int(self.next[v, s]), cost + int(self.add[v, s])
        cost += self.vectors[v][START] + min(FINAL)
        letters, q = self.expand(middle, symbols[:front], START)
        out = list(letters)
        for at, end in zip(range(front, n, t), reversed(ends), strict=True):
            letters, q = self.expand(end, symbols[at:at + t], q)
            out += letters
        last = ""
        while q not in ACCEPTS:
            last, q = last + "I", NEXT[q][1]
        return cost, [*out, last]


def _normal(v: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    least = min(v)
    return tuple(x - least for x in v), least


@functools.cache
def tables() -> Tables:
    return Tables()


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """c, t, r, x, gone: rows as a digest of their id and turn damages them; a row that is dropped stays with ``gone`` set."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(space(conv), F.lit(":"), space(turn))) % 20
    said = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("x", "[.!?]", "")).otherwise(F.col("x"))
    copies = F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = turns.select(F.col(conv).alias("c"), F.col(turn).cast("long").alias("t"), space(role).alias("r"), space(text).alias("x"), hit.alias("h"))
    return rows.select("c", "t", F.when(F.col("h") == 4, "user").otherwise(F.col("r")).alias("r"), said.alias("x"), (F.col("h") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def as_rows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """c, t, r, x, gone of rows as they are."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select(F.col(conv).alias("c"), F.col(turn).cast("long").alias("t"), space(role).alias("r"), space(text).alias("x"), F.lit(False).alias("gone"))


def _order() -> list:
    return [F.col("t").asc_nulls_first(), F.col("r"), F.col("d")]


def _digest() -> Column:
    return F.unhex(F.sha2("x", 256))


def _symbols(rows: DataFrame) -> DataFrame:
    """c, t, r, d, gone, fault (0 none, 1 blank, 2 duplicate, 3 cut short), initial: everything but the text."""
    end = F.right(F.rtrim("x", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    seen = Window.partitionBy("c", "r", "d", "gone").orderBy(F.col("t").asc_nulls_first())
    slim = rows.select("c", "t", "r", _digest().alias("d"), "gone", (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("short"))
    fault = F.when(F.col("blank"), 1).when(F.row_number().over(seen) > 1, 2).when(F.col("short"), 3).otherwise(0)
    return slim.withColumn("fault", fault).select("c", "t", "r", "d", "gone", "fault", F.substring("r", 1, 1).alias("initial"))


LEGAL = {"su", "ua", "au"}
STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _edits(rows: DataFrame) -> DataFrame:
    """c, t, r, d, piece, edits, and on the first piece the conversation's figures; a piece sorts before the rows it edits."""

    class Conversation:
        def __init__(self, key):
            self.key, self.symbols, self.starts, self.faults = key, bytearray(), [], [0] * 4
            self.illegal, self.before, self.first, self.last, self.turns = 0, None, None, None, 0

        def add(self, t, r, d, fault, initial) -> None:
            if len(self.symbols) % PIECE == 0:
                self.starts.append((t, r, d))
            known = INITIALS.find(initial) if initial and initial != "?" else -1
            self.symbols.append(MUST_GO if fault in (1, 2) else 2 * (known if known >= 0 else INITIALS.index("?")) + (fault == 3))
            self.faults[fault] += 1
            if self.before is not None and self.before + initial not in LEGAL:
                self.illegal += 1
            self.before = initial
            if t is not None and t != self.last:
                self.first, self.last, self.turns = t if self.first is None else self.first, t, self.turns + 1

        def pieces(self) -> Iterator[tuple]:
            cost, letters = tables().repair(bytes(self.symbols))
            gaps = self.last - self.first + 1 - self.turns if self.turns else 0
            figures = (gaps, *self.faults[1:], self.illegal, cost)
            for k in range(max(1, len(self.starts))):
                part = letters[k * PIECE:(k + 1) * PIECE] if k + 1 < len(self.starts) else letters[k * PIECE:]
                yield (self.key, *(self.starts[k] if self.starts else (None, "", b"")), k, "".join(part), *(figures if k == 0 else (None,) * 6))

    kind = rows.schema["c"].dataType
    schema = f"c {kind.simpleString()}, t long, r string, d binary, piece long, edits string, " + ", ".join(f"{s} long" for s in STATS)
    fields = pa.schema([("c", to_arrow_type(kind)), ("t", pa.int64()), ("r", pa.string()), ("d", pa.binary()), ("piece", pa.int64()), ("edits", pa.string()), *[(s, pa.int64()) for s in STATS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out = []
            for c, t, r, d, gone, fault, initial in zip(*[col.to_pylist() for col in batch.columns], strict=True):
                if now is None or now.key != c:
                    if now is not None:
                        out += now.pieces()
                    now = Conversation(c)
                if not gone:
                    now.add(t, r, d, fault, initial)
            yield _batch(out, fields)
        if now is not None:
            yield _batch(list(now.pieces()), fields)

    ordered = _symbols(rows).repartition("c").sortWithinPartitions("c", *_order())
    return ordered.mapInArrow(run, schema)


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)


class _Repaired:
    """Takes a conversation's edits and rows in their common order and gives its rows after repair."""

    def __init__(self):
        self.waiting, self.at, self.state = "", 0, START

    def edits(self, letters: str) -> None:
        self.waiting, self.at = self.waiting[self.at:] + letters, 0

    def put_in(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.waiting) and self.waiting[self.at] == "I":
            self.at += 1
            role, self.state = NEXT[self.state]
            yield role, ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.put_in()
        letter = self.waiting[self.at]
        self.at += 1
        if letter == "K":
            self.state = KEEP[role[0], self.state]
            yield role, text
        elif letter == "R":
            role, self.state = NEXT[self.state]
            yield role, text


def _merged(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits and the texts they are for, by conversation in one order: c, x, r, edits, figures."""
    figures = [F.lit(None).cast("long").alias(s) for s in STATS]
    texts = rows.where(~F.col("gone")).select("c", "t", "r", _digest().alias("d"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("piece"), "x", F.lit(None).cast("string").alias("edits"), *figures)
    told = edits.select("c", "t", "r", "d", F.lit(0).alias("kind"), "piece", F.lit(None).cast("string").alias("x"), "edits", *STATS)
    both = texts.union(told).repartition("c").sortWithinPartitions("c", *_order(), "kind", "piece")
    return both.select("c", "r", "x", "edits", *STATS)


def repaired(rows: DataFrame) -> DataFrame:
    """c, place, role, text: the rows of every conversation after repair."""
    kind = rows.schema["c"].dataType
    fields = pa.schema([("c", to_arrow_type(kind)), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, place = None, None, 0
        for batch in batches:
            out = []

            def give(made: Iterator[tuple[str, str]], out=out) -> None:
                nonlocal place
                for role, text in made:
                    out.append((key, place, role, text))
                    place += 1

            for c, r, x, letters in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if now is None or key != c:
                    if now is not None:
                        give(now.put_in())
                    now, key, place = _Repaired(), c, 0
                if x is None:
                    now.edits(letters)
                else:
                    give(now.row(r, x))
            yield _batch(out, fields)
        if now is not None:
            yield _batch([(key, place + i, role, text) for i, (role, text) in enumerate(now.put_in())], fields)

    return _merged(rows, staged(_edits(rows))).mapInArrow(run, f"c {kind.simpleString()}, place long, role string, text string")


def report(rows: DataFrame) -> DataFrame:
    """c, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""
    kind = rows.schema["c"].dataType
    fields = pa.schema([("c", to_arrow_type(kind)), *[(s, pa.int64()) for s in STATS], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    class Told:
        def __init__(self, key):
            self.key, self.repaired, self.audit, self.digest, self.first, self.figures = key, _Repaired(), [], hashlib.sha256(), True, (0,) * len(STATS)

        def take(self, made: Iterator[tuple[str, str]]) -> None:
            for role, text in made:
                self.digest.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
                self.first = False

        def row(self) -> tuple:
            self.take(self.repaired.put_in())
            return self.key, *self.figures, "".join(self.audit), self.digest.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out = []
            for c, r, x, letters, *figures in zip(*[col.to_pylist() for col in batch.columns], strict=True):
                if now is None or now.key != c:
                    if now is not None:
                        out.append(now.row())
                    now = Told(c)
                if x is None:
                    now.repaired.edits(letters)
                    now.audit.append(letters)
                    now.figures = figures if figures[0] is not None else now.figures
                else:
                    now.take(now.repaired.row(r, x))
            yield _batch(out, fields)
        if now is not None:
            yield _batch([now.row()], fields)

    schema = f"c {kind.simpleString()}, " + ", ".join(f"{s} long" for s in STATS) + ", audit string, repaired_sha256 string"
    return _merged(rows, staged(_edits(rows))).mapInArrow(run, schema)
