"""Quality: Bradley-Terry ranking of documents by preference pairs.

Each pair (better, worse) of the training sample contributes logistic loss on the difference of the two feature vectors; the learned weights give each document a score. The score is then cut at a quantile of the training scores: the one that separates the labels best. `score` maps that cut to `cut_at`, so that "score >= cut_at" is the quantile rule.

Features describe the form of a text (kinds of characters, repetition of words, word pairs and lines, lengths), each also as one-hot bins at training quantiles, so that the linear score can bend. Every whole text is read once, without a shuffle.

Edge cases: null and empty texts have all features 0 and a score like any other; without both labels in training every score is 0.5. Repeated rows get equal scores.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import adam, sigmoid, sub_batches, texts_of

#: ASCII marks whose share of a text is a feature each.
_MARKS = b"#$%&*!|=/<>{}@_.,:;\"'-()[]\\~^+?"
NAMES = ("log_bytes", "upper", "lower", "digit", "space", "newline", "high", "control", *(f"mark_{chr(c)}" for c in _MARKS), "words", "word_len", "distinct_words", "top_word", "twice", "distinct_pairs", "lines", "distinct_lines", "line_len", "longest_word", "marked_words", "compressed")


def features(text: bytes) -> list[float]:
    n = len(text)
    if not n:
        return [0.0] * len(NAMES)
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    w, pairs = max(1, len(words)), list(zip(words, words[1:], strict=False))
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    ends = sum(1 for x in words if not (x[-1] >= 128 or 97 <= (x[-1] | 32) <= 122 or x[-1:] in b".,"))
    return [
        np.log1p(n), *(float(c[a:b].sum()) / n for a, b in ((65, 91), (97, 123), (48, 58))), c[32] / n, c[10] / n, c[128:].sum() / n, (c[:32].sum() - c[9] - c[10] - c[13]) / n,
        *(c[m] / n for m in _MARKS),
        np.log1p(w), n / w, len(counts) / w, max(counts.values(), default=0) / w, sum(a == b for a, b in pairs) / w, len(set(pairs)) / w,
        np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), max(map(len, words), default=0), ends / w,
        len(zlib.compress(text, 1)) / n,
    ]


def _feature_rows(batches):
    for b in sub_batches(batches):
        x = [features(t) for t in texts_of(b)]
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])


def expand(model: dict, x: np.ndarray) -> np.ndarray:
    """Standardised features and their one-hot bins."""
    z = np.clip((x - model["mean"]) / model["std"], -4, 4)
    bins = [(x[:, [j]] > e[None, :]).astype(float) for j, e in enumerate(model["edges"]) if len(e)]
    return np.hstack([z, *bins])


def fit(labelled: DataFrame, cap: int = 6000, n_pairs: int = 40_000, n_bins: int = 8, l2: float = 1e-4, steps: int = 300, cut_at: float = 0.3, seed: int = 7) -> dict:
    """Learns from (text, label 0/1), a sample that the caller bounds, by `n_pairs` random pairs of a row of label 1 and one of label 0."""
    rows = labelled.filter(F.col("label").isin(0, 1)).select("text", F.col("label").cast("int").alias("label"), "doc_id").orderBy("doc_id").select("text", "label").mapInArrow(_feature_rows, "label int, x array<double>").collect()
    y = np.array([r["label"] for r in rows], int)
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(NAMES))
    order = np.lexsort([*x.T, y])  # the same order whatever the partitions were
    x, y = x[order], y[order]
    if not len(y) or y.min() == y.max():
        return {"w": None}
    model = {"mean": x.mean(0), "std": x.std(0) + 1e-9, "edges": [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) for j in range(x.shape[1])], "cut_at": cut_at}
    f, rng = expand(model, x), np.random.default_rng(seed)
    good, bad = rng.choice(np.flatnonzero(y == 1), n_pairs), rng.choice(np.flatnonzero(y == 0), n_pairs)
    diff = (f[good] - f[bad]).astype(np.float32)
    model["w"] = adam(lambda w: -(diff.T @ sigmoid(-(diff @ w.astype(np.float32)))) / n_pairs + l2 * w, np.zeros(f.shape[1]), steps, 0.05)
    s = f @ model["w"]
    # The quantile of training scores that separates the labels best, and a slope for the scores on either side of it.
    ranked = np.argsort(s, kind="stable")
    right = np.concatenate([[0], np.cumsum(y[ranked] == 0)]) + np.concatenate([np.cumsum((y[ranked] == 1)[::-1])[::-1], [0]])
    k = int(np.argmax(right))
    model["quantile"] = k / len(s)
    model["cut"] = float(s[ranked[0]] - 1 if k == 0 else s[ranked[-1]] + 1 if k == len(s) else (s[ranked[k - 1]] + s[ranked[k]]) / 2)
    shift = np.log(cut_at / (1 - cut_at))
    model["slope"] = max(np.geomspace(0.1, 10, 41), key=lambda a: float(np.mean(np.log(np.where(y == 1, sigmoid(a * (s - model["cut"]) + shift), 1 - sigmoid(a * (s - model["cut"]) + shift)) + 1e-12))))
    return model


def raw_scores(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores in 0..1; the cut's score is model["cut_at"]."""
    if model["w"] is None:
        return np.full(len(x), 0.5)
    c = model["cut_at"]
    return sigmoid(model["slope"] * (expand(model, x) @ model["w"] - model["cut"]) + np.log(c / (1 - c)))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and the score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in sub_batches(batches):
            x = np.array([features(t) for t in texts_of(b)], float).reshape(b.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(raw_scores(m, x), 9))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs (all columns) whose score isn't under the cut."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), model.get("cut_at", 0.0)

    def run(batches):
        m = shared.value
        for b in sub_batches(batches):
            x = np.array([features(t) for t in texts_of(b)], float).reshape(b.num_rows, len(NAMES))
            yield b.filter(pa.array(raw_scores(m, x) >= at))

    return docs.mapInArrow(run, docs.schema)
