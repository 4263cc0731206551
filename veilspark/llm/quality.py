"""Quality by attention-based multiple-instance learning.

A document is a bag of passages.  Every passage of the whole text is encoded;
a gated attention layer weighs the encodings; the weighted sum is classified.
Only document labels are needed: the attention learns which passages matter.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from veilspark.llm.common import fitted, scored, table

#: Words of a passage.
PASSAGE = 64
THRESHOLD = 0.7
#: Labelled documents that the network learns from, at most.
TRAIN_DOCS = 6000
HIDDEN, GATE = 16, 8
EPOCHS, BATCH, RATE = 30, 64, 0.01

# Character classes: lower, upper, digit, blank, sentence mark, symbol, other.
_CLASSES = 7
_CLASS = np.full(0x250, 6, np.int64)
for _c in range(0x250):
    _s = chr(_c)
    _CLASS[_c] = 0 if _s.islower() else 1 if _s.isupper() else 2 if _s.isdigit() else 3 if _s == " " else 4 if _s in ".,;:'\"-()?" else 5 if 32 < _c < 127 else 6
N_FEATURES = _CLASSES + 9


def passages(text: str) -> np.ndarray:
    """One row of features for each passage of a text; a text without words is one empty passage."""
    words = text.split()
    if not words:
        return np.zeros((1, N_FEATURES))
    n = len(words)
    starts = np.arange(0, n, PASSAGE)
    if len(starts) > 1 and n - starts[-1] < PASSAGE // 4:
        starts = starts[:-1]  # a short rest joins the passage before it
    sizes = np.diff(np.append(starts, n))
    lengths = np.fromiter(map(len, words), np.int64, n)
    chars = np.frombuffer(" ".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _CLASS[np.minimum(chars, 0x24F)]
    begins = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    at = begins[starts]
    spans = np.diff(np.append(at, len(chars)))
    of = np.repeat(np.arange(len(starts)), spans)
    counts = np.bincount(of * _CLASSES + kind, minlength=len(starts) * _CLASSES).reshape(-1, _CLASSES) / spans[:, None]
    mean = np.add.reduceat(lengths, starts) / sizes
    spread = np.sqrt(np.maximum(0, np.add.reduceat(lengths * lengths, starts) / sizes - mean * mean))
    again = np.fromiter(map(eq, words, ["", *words]), bool, n)
    last = kind[begins + lengths - 1]
    ratio = lambda x: np.add.reduceat(x.astype(np.int64), starts) / sizes
    unique = np.array([len(set(words[a : a + s])) for a, s in zip(starts.tolist(), sizes.tolist(), strict=True)]) / sizes
    run = np.concatenate(([False], (chars[1:] == chars[:-1]) & (kind[1:] == 5)))
    runs = np.add.reduceat(run.astype(np.int64), at) / spans
    rest = np.stack([unique, ratio(again), mean / 10, spread / 10, ratio(lengths == 1), ratio(last == 5), np.log1p(sizes) / 5, runs, np.full(len(starts), np.log1p(n) / 10)], 1)
    return np.concatenate([counts, rest], 1)


def _bags(texts) -> tuple[np.ndarray, np.ndarray]:
    rows = [passages(t) for t in texts]
    return np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))


class Network:
    """Encoder ``tanh(xE)``, gated attention ``tanh(hV) * sigmoid(hU) . w``, logistic head; all in numpy."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        w, first, sizes = self.w, starts[:-1], np.diff(starts)
        h = np.tanh((x - w["mean"]) / w["scale"] @ w["E"] + w["e"])
        v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        a = (v * u) @ w["w"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, first), sizes))
        a /= np.repeat(np.add.reduceat(a, first), sizes)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"], -30, 30)))
        return {"h": h, "v": v, "u": u, "a": a, "z": z, "p": p}

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f, sizes = self.w, self.forward(x, starts), np.diff(starts)
        d = (f["p"] - y) / len(y)
        g = {"c": f["z"].T @ d, "b": d.sum(keepdims=True)}
        dz = np.repeat(d[:, None] * w["c"], sizes, axis=0)
        da = (dz * f["h"]).sum(1)
        mean = np.repeat(np.add.reduceat(f["a"] * da, starts[:-1]), sizes)
        ds = f["a"] * (da - mean)
        g["w"] = (f["v"] * f["u"]).T @ ds
        dv, du = ds[:, None] * w["w"] * f["u"] * (1 - f["v"] ** 2), ds[:, None] * w["w"] * f["v"] * f["u"] * (1 - f["u"])
        g["V"], g["U"] = f["h"].T @ dv, f["h"].T @ du
        dh = (f["a"][:, None] * dz + dv @ w["V"].T + du @ w["U"].T) * (1 - f["h"] ** 2)
        g["E"], g["e"] = ((x - w["mean"]) / w["scale"]).T @ dh, dh.sum(0)
        return g


def train(texts: list[str], y: np.ndarray, seed: int = 3) -> Network:
    """Adam on shuffled batches of bags; one class or no rows give a constant network."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[0])
    w = {"E": draw(N_FEATURES, HIDDEN), "e": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "c": draw(HIDDEN), "b": np.zeros(1), "mean": np.zeros(N_FEATURES), "scale": np.ones(N_FEATURES)}
    net = Network(w)
    if not len(y) or y.min() == y.max():
        w["c"][:], w["b"][:] = 0, 4.0 if not len(y) or y[0] else -4.0
        return net
    x, starts = _bags(texts)
    w["mean"], w["scale"] = x.mean(0), x.std(0) + 1e-3
    learned = [k for k in w if k not in ("mean", "scale")]
    m, s, step = {k: np.zeros_like(w[k]) for k in learned}, {k: np.zeros_like(w[k]) for k in learned}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            pick = order[at : at + BATCH]
            rows = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in pick])
            bag = np.concatenate(([0], np.cumsum(starts[pick + 1] - starts[pick])))
            g, step = net.gradients(x[rows], bag, y[pick]), step + 1
            for k in learned:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                w[k] -= RATE * (1 - epoch / EPOCHS) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return net


def _weights(texts: pa.Array, y: np.ndarray) -> dict[str, np.ndarray]:
    return train(texts.to_pylist(), y).w


def scorer(weights: dict[str, np.ndarray]):
    def score(texts: pa.Array) -> np.ndarray:
        return Network(weights).forward(*_bags(texts.to_pylist()))["p"]

    return score


def classify(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (columns ``doc_id, text``).

    Learns from at most ``train_docs`` labelled texts.  A null text is scored as
    an empty one, which is one passage without words.  Repeated rows each get a
    row, every passage of a text of any length counts, a null doc_id is not held
    out, columns beside the two are not read, and an empty table gives no rows.
    Without labels of both classes all scores are equal.
    """
    return scored(docs, scorer(fitted(docs, labels, "quality", train_docs, _weights)), THRESHOLD)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
