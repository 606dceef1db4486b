"""Token ids of whole texts by a public tokenizer file, distinct words at a time.

The tokenizer lower-cases, cuts words by a pattern that never crosses white space, and merges within a
word only, so a word has the same ids wherever it stands. A slice of texts is cut at white space and its
stretches are numbered by Arrow; each distinct stretch is cut into words once, each word that the task has
not met goes to the tokenizer's model, and the ids of all texts are gathered from those of the stretches
in one step. A text with any character outside the range for which the two regular expression engines
surely agree is given to the tokenizer as a whole.

What a task remembers is bounded (``REMEMBERED`` words, packed) and ends with the task; only the
tokenizer itself stays with the worker.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The word pattern of the tokenizer file.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: White space, printable ASCII and the composed Latin letters without the two whose case changes length.
PLAIN = re.compile("[\x09-\x0d\x20-\x7e¡-įı-ňŊ-ž]*")
#: Words that a task remembers before it starts anew.
REMEMBERED = 350_000
#: Characters of text that are cut at a time.
SLICE_CHARS = 4_000_000


def _spelled() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for the code points from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(256 + i) for i, b in enumerate(others)}


SPELLED = _spelled()


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Made anew in each task."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.model = self.tokenizer.model
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(SPELLED)
        found = self.model.tokenize(spelled)
        ids = pack(f"<{len(found)}I", *[t.id for t in found])
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[word] = ids
        return ids

    def _stretch(self, stretch: str) -> bytes:
        known = self.known
        if stretch in known:
            return known[stretch]
        return b"".join([known.get(w) or self._word(w) for w in PATTERN.findall(stretch)])

    def _is_plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not any(s in text for s in self.specials)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of plain texts, by their distinct stretches."""
        cut = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
        bounds = cut.offsets.to_numpy()
        numbered = cut.flatten().dictionary_encode()
        parts = [self._stretch(s) for s in numbered.dictionary.to_pylist()]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(parts), "<u4")
        at = numbered.indices.to_numpy()
        n = size[at]
        ends = np.cumsum(n)
        # the k-th id of a stretch stands k places after its first
        places = np.repeat(start[at] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        ids, ends = flat[places], np.r_[0, ends]
        return [ids[ends[a]:ends[b]] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        at = 0
        while at < len(texts):
            stop, chars = at, 0
            while stop < len(texts) and (stop == at or chars + len(texts[stop]) <= SLICE_CHARS):
                chars += len(texts[stop])
                stop += 1
            plain = [self._is_plain(t) for t in texts[at:stop]]
            by_words = iter(self._plain([t for t, p in zip(texts[at:stop], plain, strict=True) if p]))
            for text, p in zip(texts[at:stop], plain, strict=True):
                yield next(by_words) if p else np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
            at = stop
