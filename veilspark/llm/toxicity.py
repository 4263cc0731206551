"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are words, word stems, word pairs and pairs with one word between,
hashed to a fixed table; a feature counts once a document.  Per-coordinate
rates and the L1 term leave a short list of weights, which is what the scoring
tasks get.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from veilspark.llm.common import fitted, mix64, scored, table, trimmed

BITS = 20
THRESHOLD = 0.3
#: Labelled documents that the weights are learned from, at most.
TRAIN_DOCS = 6000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.1
STEMS = (4, 5)
#: Training texts that a feature must stand in.
MIN_DOCS = 3
_MASK = np.uint64((1 << BITS) - 1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: the text it stands in, and its hash, one entry an occurrence.  A text without words has none."""
    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\pL\pN]+", " ")
    split = pc.split_pattern(clean, " ")
    words = split.flatten()
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))[real]
    coded = words.filter(pa.array(real)).dictionary_encode()
    vocabulary = coded.dictionary.to_pylist()
    code = coded.indices.to_numpy(zero_copy_only=False)
    digest = xxhash.xxh64_intdigest
    word = np.array([digest(w, 1) for w in vocabulary], np.uint64)[code]
    kinds = [(doc, word)]
    for k in STEMS:
        long = np.array([len(w) > k for w in vocabulary], bool)[code]
        stem = np.array([digest(w[:k], 1 + k) for w in vocabulary], np.uint64)[code]
        kinds.append((doc[long], stem[long]))
    for gap in (1, 2):
        same = doc[gap:] == doc[:-gap]
        kinds.append((doc[gap:][same], mix64(word[:-gap] * _ODD[gap - 1] + word[gap:])[same]))
    return [(d, (h & _MASK).astype(np.int64)) for d, h in kinds]


def train(texts: pa.Array, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Features with a weight, their weights, and the bias.  One class or no rows give the bias alone."""
    if not len(y) or y.min() == y.max():
        return np.zeros(0, np.int64), np.zeros(0), -4.0 if not len(y) or not y[0] else 4.0
    examples, seen = [], np.zeros(1 << BITS, np.int32)
    for at in range(0, len(y), 256):
        part = texts.slice(at, 256)
        once = np.unique(np.concatenate([(d << BITS) + h for d, h in features(part)]))
        starts = np.searchsorted(once, np.arange(len(part) + 1) << BITS)
        once = (once & ((1 << BITS) - 1)).astype(np.int32)
        seen += np.bincount(once, minlength=1 << BITS).astype(np.int32)
        examples += [once[a:b].copy() for a, b in zip(starts, starts[1:], strict=False)]
    common = seen >= MIN_DOCS  # what a text or two have only teaches those texts
    examples = [e[common[e]] for e in examples]
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias = float(np.log(y.mean() / (1 - y.mean())))

    def weights(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for idx, label in zip(examples, y, strict=True):
            zi, ni = z[idx], n[idx]
            w = weights(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30))) - label
            more = ni + g * g
            z[idx] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[idx] = more
            bias -= 0.01 * g
    w = weights(z, n)
    kept = np.flatnonzero(w)
    return kept, w[kept], bias


def scorer(kept: np.ndarray, values: np.ndarray, bias: float):
    def score(texts: pa.Array) -> np.ndarray:
        dense = _dense(kept, values)
        pairs = np.unique(np.concatenate([((d << BITS) + h)[dense[h] != 0] for d, h in features(texts)]))
        margin = bias + np.bincount(pairs >> BITS, dense[pairs & ((1 << BITS) - 1)], len(texts))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))

    return score


_TABLES: dict[int, np.ndarray] = {}


def _dense(kept: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The weights as a table, made once a worker."""
    key = xxhash.xxh64_intdigest(kept.tobytes() + values.tobytes())
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = np.zeros(1 << BITS)
        _TABLES[key][kept] = values
    return _TABLES[key]


def learn(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS):
    """A scoring function learned from at most ``train_docs`` labelled texts."""
    return scorer(*fitted(docs, labels, "toxic", train_docs, train))


def classify(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (columns ``doc_id, text``).

    A null text is scored as an empty one: by the bias.  Repeated rows each get a row, whole texts of any length are
    scored, a null doc_id is not held out, columns beside the two are not read, and an empty table gives no rows.
    Without labels of both classes the score is that of the bias alone.
    """
    return scored(docs, learn(docs, labels, train_docs), THRESHOLD)


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows scored at the threshold or above; the scoring tasks pass the others on, without a join.

    All columns stay as they are, whatever their names; null texts are scored as empty ones, repeated rows one by one.
    """
    score, at = learn(docs, labels), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = pc.fill_null(part.column(at).cast(pa.string()), "")
                yield part.filter(pa.array(score(texts) < threshold))

    return docs.mapInArrow(trimmed(run), docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
