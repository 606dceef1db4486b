"""Secret scans by a recursive decoding worklist.

Each text is scanned for assignments, access keys and hex runs. Then its encoded layers go on a
worklist: percent escapes and Unicode escapes are decoded over the whole layer, base64 runs become
layers of their own, and what they hold is unpacked if it is compressed. A run is read from each of its
first four characters, as it may follow a word and a slash, and both by line and over line ends; bytes
that are not UTF-8 are kept as characters of their own. Compressed data may begin anywhere in a run and
have several members. Every new layer is scanned
and unwrapped in turn until none is new; a layer equal to one of those it came from closes a cycle and
is left. Each layer carries, for every character, the place in the original text that it stands for,
so spans found deep inside are reported where they stand in the document.

Defined results: null text counts as empty; a text without secrets has counts of 0 and empty spans;
rows that repeat get the same result; ``n_layers`` counts layers that are printable, lead to others or
hold a secret. Escapes nested more than ``LEVELS`` deep are decoded to the end in one scan, so time is in
proportion to the text. What unpacks to more than ``MOST_BYTES`` is read in overlapping pieces in bounded
memory; ``n_large`` counts such runs. An archive that holds itself closes a cycle. Texts are read whole
whatever their length; an empty table has an empty result. Columns other than id and text are ignored,
whatever their names; the id must not be called like a result.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import io
import lzma
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import accumulate, chain, pairwise

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offermend.llm.common import schema_of

KINDS = ("assign", "access", "hex")
#: Unpacked bytes that are held at once; more is read in pieces of ``PIECE`` bytes that overlap.
MOST_BYTES, PIECE, OVERLAP = 64 << 20, 8 << 20, 1 << 16
#: Levels of percent or Unicode escapes that are layers of their own.
LEVELS = 8
#: A base64 run; shorter ones cannot hold a secret that the patterns accept.
SHORTEST_BASE64 = 16


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = ("password", "passwd", "secret", "token", "api_?key")
_ASSIGN = re.compile(f"({'|'.join(_either_case(n) for n in _NAMES)})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{32,}")  # maximal runs: the same as dropping shorter ones
_HINTS = ("passw", "secret", "token", "apikey", "api_key")
_IS_HEX = bytes(1 if c in b"0123456789abcdef" else 0 for c in range(256))
_IS_BASE64 = bytes(1 if chr(c).isascii() and (chr(c).isalnum() or c in b"+/-_") else 0 for c in range(256))

_PERCENT = re.compile("(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\x[0-9a-fA-F]{2}")
_BASE64 = re.compile("[A-Za-z0-9+/_-]{%d,}={0,2}" % SHORTEST_BASE64)
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:(?:\r\n|\n|\r)[A-Za-z0-9+/_-]++)++={0,2}")
_PACKED = re.compile(rb"\x1f\x8b|\x78[\x01\x5e\x9c\xda]|BZh|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")

Span = tuple[str, int, int]


def base_spans(text: str, raw: bytes | None = None) -> list[Span]:
    """(kind, start, end) of the three patterns, each from left to right without overlap."""
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    found: list[Span] = []
    low = raw.lower()
    if any(h.encode() in low for h in _HINTS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    if b"\1" * 32 in raw.translate(_IS_HEX):
        found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


class Layer:
    """Text with, per character, where it begins and ends in the document (None: where it stands); ``whole`` is the one place of all unpacked text."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None, above: tuple[bytes, ...] = (), whole: tuple[int, int] | None = None, level: int = 0):
        self.text, self.starts, self.ends, self.whole, self.level = text, starts, ends, whole, level
        self.mark = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        self.above = above

    def place(self, start: int, end: int) -> tuple[int, int]:
        if self.whole is not None:
            return self.whole
        return (start, end) if self.starts is None else (min(self.starts[start:end]), max(self.ends[start:end]))

    def child(self, text: str, spots: list[tuple[int, int]], level: int = 0) -> Layer:
        """``level``: how many escapes in a row were decoded to get there."""
        if self.whole is not None:
            return Layer(text, above=(*self.above, self.mark), whole=self.whole, level=level)
        places = [self.place(a, b) for a, b in spots]
        return Layer(text, [p[0] for p in places], [p[1] for p in places], (*self.above, self.mark), level=level)

    def unpacked(self, text: str, start: int, end: int) -> Layer:
        return Layer(text, above=(*self.above, self.mark), whole=self.place(start, end))


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each match decoded; ``decode`` gives (character, width) pairs or None to leave it."""
    parts, spots, at = [], [], 0
    for m in pattern.finditer(layer.text):
        if (pairs := decode(m[0])) is None:
            continue
        parts.append(layer.text[at:m.start()])
        spots += [(i, i + 1) for i in range(at, m.start())]
        place = m.start()
        for char, width in pairs:
            parts.append(char)
            spots.append((place, place + width))
            place += width
        at = m.end()
    if not parts:
        return None
    parts.append(layer.text[at:])
    spots += [(i, i + 1) for i in range(at, len(layer.text))]
    return layer.child("".join(parts), spots, layer.level + 1)


_HEX_DIGITS = frozenset("0123456789abcdefABCDEF")


def _escape_at_end(out: list) -> tuple[int, str | int] | None:
    """(characters, what they stand for) of an escape that the stack ends with; bytes above 127 stand for themselves as integers."""
    if not (len(out) > 2 and out[-1] in _HEX_DIGITS and out[-2] in _HEX_DIGITS):
        return None

    def digits(n: int) -> str | None:
        tail = out[-n:]
        return "".join(tail) if len(tail) == n and all(c in _HEX_DIGITS for c in tail) else None

    if out[-3] == "%":
        byte = int(out[-2] + out[-1], 16)
        return 3, chr(byte) if byte < 128 else byte
    for head, n in (("x", 2), ("u", 4), ("U", 8)):
        if len(out) > n + 1 and out[-n - 1] == head and out[-n - 2] == "\\" and (found := digits(n)) is not None:
            code = int(found, 16)
            if n == 4 and 0xDC00 <= code < 0xE000 and len(out) > 11 and out[-12:-10] == ["\\", "u"]:
                high = "".join(map(str, out[-10:-6]))
                if all(c in _HEX_DIGITS for c in out[-10:-6]) and 0xD800 <= int(high, 16) < 0xDC00:
                    return 12, chr(0x10000 + ((int(high, 16) & 0x3FF) << 10) + (code & 0x3FF))
            return None if code > 0x10FFFF or 0xD800 <= code < 0xE000 else (n + 2, chr(code))
    return None


def _settled(layer: Layer) -> Layer | None:
    """The layer with all its escapes decoded, nested ones to the end, in one scan over a stack of characters."""
    out: list[str | int] = []
    starts: list[int] = []
    ends: list[int] = []
    changed = False

    def fold(n: int, made: str | int) -> None:
        start, end = min(starts[-n:]), max(ends[-n:])
        del out[-n:], starts[-n:], ends[-n:]
        out.append(made)
        starts.append(start)
        ends.append(end)

    for i, char in enumerate(layer.text):
        out.append(char)
        starts.append(i)
        ends.append(i + 1)
        while (found := _escape_at_end(out)) is not None:
            changed = True
            fold(*found)
            if isinstance(found[1], int):  # perhaps the last byte of a character
                for n in range(2, 5):
                    if len(out) >= n and all(isinstance(b, int) for b in out[-n:]):
                        try:
                            fold(n, bytes(out[-n:]).decode())
                            break
                        except UnicodeDecodeError:
                            pass
    if not changed:
        return None
    return layer.child("".join([chr(c) if isinstance(c, int) else c for c in out]), list(zip(starts, ends, strict=True)), layer.level + 1)


def _percent(run: str) -> list[tuple[str, int]]:
    raw = bytes.fromhex(run.replace("%", ""))
    try:
        return [(c, 3 * len(c.encode())) for c in raw.decode()]
    except UnicodeDecodeError:
        return [(chr(b), 3) for b in raw]


def _unicode(run: str) -> list[tuple[str, int]] | None:
    if len(run) == 12:
        return [(chr(0x10000 + ((int(run[2:6], 16) & 0x3FF) << 10) + (int(run[8:], 16) & 0x3FF)), 12)]
    code = int(run[2:], 16)
    return None if code > 0x10FFFF or 0xD800 <= code < 0xE000 else [(chr(code), len(run))]


def _engine(raw: bytes):
    if raw[:2] == b"\x1f\x8b" or (raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] << 8 | raw[1]) % 31 == 0):
        return zlib.decompressobj(47)
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\0":
        return lzma.LZMADecompressor()
    return None


def _unpacked(raw: bytes) -> tuple[bytes, int | None] | None:
    """What compressed bytes hold, over all members, and the length they take (None: cut short); None if they are not compressed.

    More than the limit is held if over ``MOST_BYTES`` come back.
    """
    out, rest, whole = bytearray(), raw, True
    try:
        while len(out) <= MOST_BYTES:
            if rest[:4] == b"\x28\xb5\x2f\xfd":
                with zstandard.ZstdDecompressor().stream_reader(rest, read_across_frames=False) as reader:
                    out += reader.read(MOST_BYTES + 1 - len(out))
                if len(out) > MOST_BYTES:
                    break
                (engine := zstandard.ZstdDecompressor().decompressobj()).decompress(rest)  # for where the frame ends
            elif (engine := _engine(rest)) is not None:
                out += engine.decompress(rest, MOST_BYTES + 1 - len(out))
            else:
                break
            if not (whole := engine.eof):
                break
            rest = engine.unused_data
    except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError, zstandard.ZstdError):
        pass  # what earlier members held stays
    if len(rest) == len(raw) and not out:
        return None
    return bytes(out), len(raw) - len(rest) if whole else None


class _Chunks(io.RawIOBase):
    """Chunks of bytes as a file."""

    def __init__(self, chunks: Iterator[bytes]):
        super().__init__()
        self.chunks, self.rest = chunks, b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.rest:
            self.rest = next(self.chunks, None)
            if self.rest is None:
                self.rest = b""
                return 0
        n = min(len(into), len(self.rest))
        into[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def _expanded(file: io.BufferedReader) -> Iterator[bytes]:
    """What a file of compressed members holds, up to the first that is broken, in chunks of bounded size."""
    try:
        while True:
            head = file.peek(6)
            if head[:4] == b"\x28\xb5\x2f\xfd":
                reader = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True, closefd=False)
                yield from iter(lambda: reader.read(OVERLAP), b"")
                return
            if (engine := _engine(head)) is None:
                return
            while not engine.eof:
                more = getattr(engine, "unconsumed_tail", b"") or (file.read(OVERLAP) if getattr(engine, "needs_input", True) else b"")
                if not more and getattr(engine, "needs_input", True):
                    return
                yield engine.decompress(more, OVERLAP)
            file = io.BufferedReader(_Chunks(chain([engine.unused_data], iter(lambda f=file: f.read(OVERLAP), b""))), OVERLAP)
    except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError, zstandard.ZstdError):
        return


def _pieces(raw: bytes) -> Iterator[bytes]:
    """What compressed bytes hold, unpacked as often as it is compressed again, in overlapping pieces."""
    file, above = io.BufferedReader(io.BytesIO(raw), OVERLAP), set()
    while (begun := file.peek(OVERLAP)) and (_engine(begun) is not None or begun[:4] == b"\x28\xb5\x2f\xfd") and (some := _unpacked(begun)) and some[0]:
        mark = hashlib.blake2b(begun, digest_size=16).digest()
        if mark in above:
            return
        above.add(mark)
        file = io.BufferedReader(_Chunks(_expanded(file)), OVERLAP)
    kept = b""
    while piece := file.read(PIECE):
        yield kept + piece
        kept = piece[-OVERLAP:]


def _has_base64(raw: bytes) -> bool:
    return b"\1" * SHORTEST_BASE64 in raw.translate(_IS_BASE64, b"\r\n")


def _leads_on(text: str, raw: bytes) -> bool:
    """Whether the text holds a secret or may hold a further layer."""
    return bool(_has_base64(raw) or _PERCENT.search(text) or _UNICODE.search(text) or base_spans(text, raw))


def _printable(text: str) -> bool:
    return bool(text) and all(c.isprintable() or c in "\t\r\n" for c in text)


def _base64_runs(text: str) -> Iterator[tuple[str, Sequence[int], int, bool]]:
    """(characters, where each stands, end of the run, whether to unpack it): wrapped runs, then those of single lines."""
    wrapped = [m for m in _WRAPPED.finditer(text)] if "\n" in text or "\r" in text else []
    for m in wrapped:
        at = [i for i in range(m.start(), m.end()) if text[i] not in "\r\n="]
        if len(at) >= SHORTEST_BASE64:
            yield "".join([text[i] for i in at]), at, m.end(), True
    begun = [m.start() for m in wrapped]
    for m in _BASE64.finditer(text):
        run = m[0].rstrip("=")
        k = bisect_right(begun, m.start()) - 1
        yield run, range(m.start(), m.start() + len(run)), m.end(), k < 0 or wrapped[k].end() <= m.start()


def _runs(layer: Layer, told: Counter) -> Iterator[Layer]:
    """Layers held in base64 runs, one at a time; counts printable ones that lead to nothing, and runs that are read in pieces."""
    if not _has_base64(layer.text.encode("utf-8", "surrogatepass")):
        return
    for run, at, end, unpack in _base64_runs(layer.text):
        run = run.translate(str.maketrans("-_", "+/"))
        for shift in range(4):
            piece = run[shift:]
            piece = piece[:-1] if len(piece) % 4 == 1 else piece
            if len(piece) < SHORTEST_BASE64:
                continue
            raw = base64.b64decode(piece + "=" * (-len(piece) % 4))
            text = raw.decode("utf-8", "surrogateescape")
            if _leads_on(text, raw):
                ends = [0, *accumulate(1 if "\udc80" <= c <= "\udcff" else len(c.encode()) for c in text)]
                spots = [(at[shift + 4 * (a // 3) + a % 3], at[shift + 4 * ((b - 1) // 3) + (b - 1) % 3 + 1] + 1) for a, b in pairwise(ends)]
                yield layer.child(text, spots)
            else:
                told["leaves"] += _printable(text)
            stop = 0
            while unpack and (m := _PACKED.search(raw, stop)) is not None:
                stop = m.start() + 1
                packed = raw[m.start():]
                if (held := _unpacked(packed)) is None:
                    continue
                inner, taken = held
                stop = m.start() + taken if taken else stop
                first = at[shift + 4 * (m.start() // 3) + m.start() % 3]
                last = end if taken is None or stop == len(raw) else at[shift + 4 * ((stop - 1) // 3) + (stop - 1) % 3 + 1] + 1
                above = {hashlib.blake2b(packed[:taken], digest_size=16).digest()}
                while len(inner) <= MOST_BYTES and (more := _unpacked(inner)) is not None:
                    mark = hashlib.blake2b(inner, digest_size=16).digest()
                    if mark in above:  # it holds itself
                        break
                    above.add(mark)
                    packed, inner = inner, more[0]
                large = len(inner) > MOST_BYTES
                told["large"] += large
                for part in _pieces(packed) if large else (inner,):
                    text = part.decode("utf-8", "surrogateescape")
                    if _leads_on(text, part):
                        yield layer.unpacked(text, first, last)
                    else:
                        told["leaves"] += _printable(text)


def _held(layer: Layer, told: Counter) -> Iterator[Layer]:
    """The layers that a layer holds."""
    yield from _runs(layer, told)
    if layer.level < LEVELS:
        made = (_replaced(layer, _PERCENT, _percent), _replaced(layer, _UNICODE, _unicode))
    else:
        made = (_settled(layer),)
    yield from (child for child in made if child is not None)


def scan(text: str) -> tuple[list[Span], set[Span], int, int]:
    """(base spans, all spans, layers read, runs read in pieces). Only the layers on the way to the one at hand are held."""
    base = base_spans(text)
    spans, told = set(base), Counter()
    work = [_held(Layer(text), told)] if "%" in text or "\\" in text or _has_base64(text.encode("utf-8", "surrogatepass")) else []
    while work:
        child = next(work[-1], None)
        if child is None:
            work.pop()
        elif child.mark not in child.above:
            told["layers"] += 1
            spans |= {(kind, *child.place(a, b)) for kind, a, b in base_spans(child.text)}
            work.append(_held(child, told))
    return base, spans, told["layers"] + told["leaves"], told["large"]


def _line(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base, spans (kind:start:end lists in code points), n_layers, n_large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                base, spans, read, large = scan(t or "")
                rows.append((*(sum(s[0] == k for s in base) for k in KINDS), _line(base), _line(spans), read, large))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[id_col, "n_assign", "n_access", "n_hex", "base", "spans", "n_layers", "n_large"])

    schema = schema_of(docs, [id_col]) + ", n_assign long, n_access long, n_hex long, base string, spans string, n_layers long, n_large long"
    return docs.select(F.col(id_col), F.col(text)).mapInArrow(run, schema)
