import random
import zlib

import public_tokenizers
from llm.helpers import docs
from tokenizers import Tokenizer

from offermend.llm import packing
from offermend.llm.tokens import Encoder

ODD = ["", "Hello, World's 12 don't ''s !'s", "É́tude ﬁn İI ſs", "tab\tand\x0bmore\x85\xa0x", "<|endoftext|> x", "日本語 mixed ÄÖÜ ß", "a" * 5000, "x1y2 ½ ² ª º", "we'll I'VE"]


def test_ids_equal_the_tokenizer(spark):
    path = public_tokenizers.path(packing.TOKENIZER)
    plain = Tokenizer.from_file(path)
    texts = ODD + [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    want = [b"".join(i.to_bytes(4, "little") for i in plain.encode(t, add_special_tokens=False).ids) for t in texts]
    enc = Encoder(path)
    assert [ids.tobytes() for ids in enc.encode_all(texts)] == want
    assert [ids.tobytes() for t in texts for ids in enc.encode_all([t])] == want


def best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((capacity if fit is None else fit) - n)
    return len(gaps)


def test_plan_needs_as_many_sequences_as_best_fit_in_order_of_size():
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.choice([10, 30, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 150))]
        counts = {n: lengths.count(n) for n in lengths}
        steps = packing.plan(counts, capacity)
        used = {}
        for length, count in counts.items():
            own = [s for s in steps if s[0] == length]
            for rank in range(count):
                _, first, seq, per, offset = [s for s in own if s[1] <= rank][-1]
                used.setdefault(seq + (rank - first) // per, []).append((offset + (rank - first) % per * length, length))
        for parts in used.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= capacity
        assert len(used) == best_fit(lengths, capacity)
        assert all(sum(3 * n > capacity for _, n in parts) <= 2 for parts in used.values())


def test_packing_is_gapless_and_whole(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["of", "and", "zebra", "qx"]) for _ in range(rng.randint(0, 120)))) for i in range(300)] + [(300, None), (301, ""), (None, "x"), (7, "dup"), (7, "dup")] + [(400 + i, "same words here") for i in range(2500)]
    frame = docs(spark, rows)
    packed = packing.pack(frame, capacity=64, with_ids=True)
    got = packed.collect()
    seqs, texts = {}, {}
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        texts.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["ids"]))
    for parts in seqs.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert len(seqs) == best_fit([r["length"] for r in got], 64)
    enc = Encoder(public_tokenizers.path(packing.TOKENIZER))
    for key, text in rows:
        if key not in (7, None):
            assert b"".join(p[2] for p in sorted(texts[key])) == next(enc.encode_all([text or ""])).tobytes() + b"\1\0\0\0"
            assert [p[1] for p in sorted(texts[key])] == [64 * p for p in range(len(texts[key]))]
    full = packing.sequences(packed).collect()
    assert sum(len(r["ids"]) for r in full) == sum(4 * r["length"] for r in got) and len(full) == len(seqs)


def test_a_small_memory_and_narrow_ids_change_nothing(spark, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    path = public_tokenizers.path(packing.TOKENIZER)
    texts = [t or "" for _, t in rows]
    want = [ids.tobytes() for ids in Encoder(path).encode_all(texts)]
    monkeypatch.setattr("offermend.llm.tokens.REMEMBERED", 5)
    monkeypatch.setattr("offermend.llm.tokens.SLICE_CHARS", 300)
    assert [ids.tobytes() for ids in Encoder(path).encode_all(texts)] == want
    full = packing.sequences(packing.pack(docs(spark, rows), with_ids=True, width=2)).collect()
    assert all(len(r["ids"]) == 2 * r["length"] and len(r["doc_ids"]) == r["n_pieces"] for r in full)
    assert sum(r["length"] for r in full) == sum(len(w) // 4 + 1 for w in want)


def test_empty_table(spark):
    assert packing.pack(docs(spark, [])).count() == 0
