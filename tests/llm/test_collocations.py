import random
import re
from collections import Counter

import numpy as np
from llm.helpers import docs, rows_of

from offermend.llm import collocations


def brute(rows, support, longest=5, top=2000):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i:i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        marks = []
        for p, a in found.items():
            if any(len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            marks.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(marks)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out, key=repr)


def made(rng, n):
    words = ["the", "The", "of", "new", "york", "city", "hall", "é", "É", "a\x00b", "x-y", "'s"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r", "!", "\x0b", " "]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(["new york city hall"] if rng.random() < 0.1 else words) + rng.choice(ends) for _ in range(rng.randrange(40)))
        rows.append((i, text, rng.choice(["en", "fr", None, "und"])))
    return rows


def test_collocations_equal_brute_force(spark):
    rng = random.Random(4)
    rows = made(rng, 150) + [(500 + i, None, "en") for i in range(3)] + [(600, "", None), (601, " .,", "de"), (602, "new york " * 3000, "en")]
    frame = docs(spark, rows).repartition(6).selectExpr("*", "1 AS total", "'x' AS phrase")
    want = brute(rows, 8)
    assert len(want) > 30
    for block_bytes in (300, 10**9):  # a block for nearly every text (local support 1), and one a task
        assert rows_of(collocations.collocations(frame, support=8, block_bytes=block_bytes)) == want
    assert rows_of(collocations.collocations(frame, support=8, top=3)) == sorted([r for r in want if r[1] <= 3], key=repr)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    rows = made(random.Random(9), 60)
    monkeypatch.setattr(collocations, "LEAST_BITS", 64 * 512)
    monkeypatch.setattr(collocations, "MOST_BITS", 64 * 512)
    assert rows_of(collocations.collocations(docs(spark, rows), support=4)) == brute(rows, 4)


def test_lowered_support_loses_nothing(spark):
    """Phrases that are frequent in all are found in some block, however uneven the blocks."""
    rows = [(i, "rare pair, " * (i % 7) + "other words here " * (3 * i), "en") for i in range(40)]
    want = brute(rows, 100)
    assert any(r[2] == "rare pair" for r in want)
    assert rows_of(collocations.collocations(docs(spark, rows).repartition(9), block_bytes=2000)) == want


def test_phrases_found_by_length(spark, monkeypatch):
    """Blocks whose local support would be 1 do not hand on all their distinct phrases."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["new york city hall", f"w{rng.randrange(10**6)}"]) for _ in range(60)), "en") for i in range(200)]
    frame = docs(spark, rows).repartition(6)
    want = brute(rows, 20)
    assert want and rows_of(collocations.collocations(frame, support=20, block_bytes=500)) == want
    weighed, whole = collocations._weighed(frame, "text", "lang", 500)
    assert 20 * 500 < whole
    monkeypatch.setattr(collocations, "mine", None)  # it would hand on all
    assert rows_of(collocations.collocations(frame, support=20, block_bytes=500)) == want
    bitmap = collocations.bitmap_by_length(weighed, 20, 5, 500)
    frequent = sum(1 for k in range(1, 6) for a in Counter(p for _, t, _ in rows for w in [t.split()] for p in zip(*[w[i:] for i in range(k)], strict=False)).values() if a >= 20)
    assert 0 < np.unpackbits(bitmap).sum() <= frequent


def test_empty_table(spark):
    assert collocations.collocations(docs(spark, [])).count() == 0
