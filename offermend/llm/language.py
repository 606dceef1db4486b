"""Language identification by multilingual mixture inference.

Each language is a distribution over byte trigrams, counted over all labelled training texts (none
sampled, none cut) and smoothed. A document is a mixture of languages: expectation-maximisation
estimates its proportions from the likelihoods of its trigrams. The language set is selected by
penalised likelihood: starting from all languages, the one with the smallest share is dropped and the
rest fitted again; the set with the best log-likelihood less ``penalty`` per language and half a log
of the trigrams stays. The largest share names the document's language and is its score.

Training tasks add up their own rows and hand on one row per language and slice of the code table, so
what is shuffled is bounded by tasks and languages; the model's size is ``languages x CODES``
numbers. It reaches the tasks in their closure.

Defined results: null text and texts without a letter are ``und`` with score 0; with no training rows
every document is ``und``; a null language is not learned from; rows that repeat get the same result;
an empty table gives no rows. Input columns named ``lang_pred``, ``score`` or ``languages`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offermend.llm.common import LETTER, released, schema_of

UNDETERMINED = "und"
#: Trigram codes; three bytes are hashed to one of so many.
CODES = 1 << 16
#: Numbers in one shuffled row of counts.
SLICE = 1 << 12
#: Languages a model may hold; more in the labels is an error, not a cut.
LANGUAGES = 512
SMOOTHING = 0.2
STEPS = 12
PENALTY = 1.0
#: Trigrams, with repeats, fitted at a time.
TOGETHER = 400_000

#: Letters and bytes of longer characters stay (A-Z in lower case), all else is a blank.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], dtype=np.uint8)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes of all texts end to end, and how many each text has. Runs of blanks count as one."""
    raw = [np.frombuffer(f" {t} ".encode("utf-8", "replace"), np.uint8) for t in texts]
    lengths = np.array([len(r) for r in raw])
    joined = _FOLD[np.concatenate(raw)]
    doc = np.repeat(np.arange(len(raw)), lengths)
    keep = np.ones(len(joined), bool)
    keep[1:] = (joined[1:] != 32) | (joined[:-1] != 32) | (doc[1:] != doc[:-1])
    joined, doc = joined[keep].astype(np.uint32), doc[keep]
    hashed = ((joined[:-2] << 16 | joined[1:-1] << 8 | joined[2:]) * np.uint32(2654435761)) >> np.uint32(16)
    inside = doc[2:] == doc[:-2]
    return hashed[inside].astype(np.int64) & (CODES - 1), np.bincount(doc[2:][inside], minlength=len(raw))


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about TOGETHER bytes; a longer text is a range of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > TOGETHER:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities: languages x CODES)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, rows in batch.groupby("lang"):
                texts = rows["text"].tolist()
                total = sums.setdefault(name, np.zeros(CODES, np.int64))
                for a, b in _blocks(texts):
                    total += np.bincount(codes(texts[a:b])[0], minlength=CODES)
        for name, total in sums.items():
            for part in range(0, CODES, SLICE):
                yield pd.DataFrame({"lang": [name], "part": [part], "counts": [total[part:part + SLICE]]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for name, part, counts in batch.itertuples(index=False):
                key = (name, part)
                sums[key] = sums[key] + counts if key in sums else np.array(counts, np.int64)
        for (name, part), counts in sums.items():
            yield pd.DataFrame({"lang": [name], "part": [part], "counts": [counts]})

    schema = "lang string, part int, counts array<long>"
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    partial = rows.mapInPandas(released(count), schema).repartition("lang", "part")
    found = partial.mapInPandas(add, schema).collect()  # languages x CODES / SLICE rows
    names = sorted({r["lang"] for r in found})
    if len(names) > LANGUAGES:
        raise ValueError(f"{len(names)} languages in the labels; a model holds {LANGUAGES}")
    counts = np.zeros((len(names), CODES))
    for r in found:
        counts[names.index(r["lang"]), r["part"]:r["part"] + SLICE] = r["counts"]
    return names, np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * CODES))


def infer(texts: list[str], model: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """(share of each language, whether it is in the selected set) per text; ``model``: CODES x languages probabilities."""
    code, sizes = codes(texts)
    n, k = len(texts), model.shape[1]
    owner = np.repeat(np.arange(n), sizes)
    pairs, times = np.unique(owner * CODES + code, return_counts=True)
    owner, like, times = pairs // CODES, model[pairs % CODES], times.astype(np.float64)
    starts, has = np.searchsorted(owner, np.arange(n)), sizes > 0
    starts, total = starts[has], np.maximum(sizes, 1)[has].astype(np.float64)
    row = np.cumsum(has)[owner] - 1
    m = len(starts)
    active, best = np.ones((m, k), bool), np.full(m, -np.inf)
    share, chosen = np.full((m, k), 1.0 / k), np.ones((m, k), bool)
    result = share.copy()
    for left in range(k, 0, -1):
        for _ in range(steps if left > 1 else 1):
            weight = like * share[row]
            weight *= (times / weight.sum(axis=1))[:, None]
            share = np.add.reduceat(weight, starts, axis=0) / total[:, None]
        fit = np.add.reduceat(times * np.log((like * share[row]).sum(axis=1)), starts) - left * (penalty + 0.5 * np.log(total))
        better = fit > best
        best[better], result[better], chosen[better] = fit[better], share[better], active[better]
        weakest = np.where(active, share, np.inf).argmin(axis=1)
        active = active.copy()
        active[np.arange(m), weakest] = False
        share = np.where(active, np.maximum(share, 1e-9), 0.0)
        share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
    shares, sets = np.zeros((n, k)), np.zeros((n, k), bool)
    shares[has], sets[has] = result, chosen
    return shares, sets


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", steps: int = STEPS, penalty: float = PENALTY) -> DataFrame:
    """The rows with lang_pred, score and languages (the selected set, by share, comma-joined)."""
    names, logs = model
    table = np.ascontiguousarray(np.exp(logs).T) if names else np.zeros((CODES, 0))
    added = ("lang_pred", "score", "languages")
    columns = [c for c in docs.columns if c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t and names and LETTER.search(t) else "" for t in batch.column(columns.index(text)).to_pylist()]
            named, scores, sets = [], [], []
            for a, b in _blocks(texts):
                shares, chosen = infer(texts[a:b], table, steps, penalty) if names else (np.zeros((b - a, 1)), np.zeros((b - a, 1), bool))
                for t, share, some in zip(texts[a:b], shares, chosen, strict=True):
                    known = t != "" and share.any()
                    order = [i for i in np.argsort(-share, kind="stable") if some[i]] if known else []
                    named.append(names[order[0]] if known else UNDETERMINED)
                    scores.append(float(min(1.0, share[order[0]])) if known else 0.0)
                    sets.append(",".join(names[i] for i in order))
            extra = [pa.array(named, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*columns, *added])

    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(released(run), schema_of(docs, columns) + ", lang_pred string, score double, languages string")


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0
