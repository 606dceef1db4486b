import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from llm.helpers import docs
from tokenizers import Tokenizer

from offermend.llm import language, packing, simhash


def brute_stage(name, rows, spark, frame):
    """What a stage keeps of (doc_id, text, source) rows, worked out row by row."""
    if name == "language_id":
        names, logs = language.train(frame)
        kept = []
        for r in rows:
            if r["text"] and any(c.isalpha() for c in r["text"]):
                shares, chosen = language.infer([r["text"]], np.exp(logs).T)
                if shares[0].max() >= 0.5:
                    kept.append(r)
        return kept
    if name == "exact_dedup":
        best = {}
        for r in sorted(rows, key=lambda r: (-len(r["text"] or ""), r["doc_id"])):
            best.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", r["text"] or ""), r)
        return list(best.values())
    rows = sorted(rows, key=lambda r: r["doc_id"])
    prints = [simhash.fingerprint(r["text"]) for r in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if group[i] != group[j] and (prints[i] ^ prints[j]).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    return [r for i, r in enumerate(rows) if group[i] == i]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input of each stage and the result of the last."""
    folder = tmp_path_factory.mktemp("stages")
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seen = [frame]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], "/root/testdata/sf0.001").write.parquet(str(folder / name))
        seen.append(spark.read.parquet(str(folder / name)))
    return seen


def test_filtering_stages_equal_brute_force(spark, stages):
    for k in range(3):
        name = corpus_pipeline.STAGES[k][0]
        want = brute_stage(name, stages[k].collect(), spark, stages[k])
        assert Counter(map(tuple, stages[k + 1].collect())) == Counter(map(tuple, want)), name
        assert stages[k + 1].columns == stages[0].columns


def test_mixed_documents_are_near_their_targets(stages):
    size, taken = Counter(), Counter()
    whole = {r["doc_id"]: r for r in stages[3].collect()}
    for r in whole.values():
        size[r["source"]] += len((r["text"] or "").split())
    for r in stages[4].collect():
        taken[r["source"]] += len(r["text"].split())
        assert r["source"] == whole[r["doc_id"]]["source"] and r["n_chars"] == len(r["text"])
        assert Counter(r["text"].split()) <= Counter(whole[r["doc_id"]]["text"].split())
    assert stages[4].columns == stages[0].columns
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) < 0.02 * sum(size.values())
    assert all(taken[s] <= 2 * size[s] for s in size)


def test_packed_pieces_hold_all_tokens(stages):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in stages[4].collect():
        n = len(tok.encode(r["text"], add_special_tokens=False).ids) + 1
        want.update((r["doc_id"], p, p * 4096, min(4096, n - p * 4096)) for p in range(-(-n // 4096)))
    packed = stages[5].collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in packed) == want
    ends = defaultdict(int)
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 4096
    full = {r["sequence_id"]: r for r in packing.sequences(stages[5]).collect()}
    assert {k: r["length"] for k, r in full.items()} == ends
    for r in packed:
        one = full[r["sequence_id"]]
        assert one["ids"][2 * r["offset"]:2 * (r["offset"] + r["length"])] == r["ids"] and r["doc_id"] in one["doc_ids"]
        ids = np.frombuffer(r["ids"], "<u2").astype("<u4")
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"]


def test_odd_documents_pass_every_stage(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "12 !"), (None, "some words here now", None, None), (4, "some words  here now", "en", "s"), (5, "some words  here now", "en", "s"), (5, "some words  here now", "en", "s"), (6, "other " * 30_000, "en", None)]
    for data in (rows, []):
        frame = docs(spark, data).selectExpr("*", "1 AS size", "'k' AS kept", "2 AS fp", "'x' AS score")
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, frame, "")
            assert k == 4 or out.columns == frame.columns, name
            path = str(tmp_path / f"{len(data)}-{name}")
            out.write.parquet(path)
            frame = spark.read.parquet(path)
        assert (frame.count() > 0) == bool(data)
