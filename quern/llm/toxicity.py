"""Toxicity: a linear classifier of words and word beginnings, regularised by counterfactual pairs.

In each labelled training text that names a group, the group's term is swapped for every other term of its kind and language, and taken out; the squared change of the linear score is penalised. A group's mere mention so carries (almost) no weight, even where labels are skewed against it. Where no training text names a group there is nothing to swap, and the fit is plain logistic regression (README.md says for which data). `gap` measures what is left on sentences that aren't in training.

The training sample is bounded (`cap` rows of each label); scoring reads every whole text in one pass without a shuffle. The model is a dictionary of at most `max_features` words, so its broadcast is bounded.

Edge cases: null and empty texts score as the model's intercept says; without labelled rows (or with one class only) every score is the label's rate in training, 0 if there is none. Equal texts have equal scores; repeated rows have one result each; a null id is scored like any other and never trains. Very long texts are scored whole, a word set at a time. Words with equal chi-square are taken in order. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import adam, alpha_words, sigmoid, stratified, sub_batches, texts_of

#: Terms that name a group of people, by kind and language; those of a line are swapped for each other.
KINDS = tuple(
    tuple(line.split())
    for line in """
women men girls boys
woman man girl boy
christians muslims jews hindus buddhists atheists
christian muslim jewish hindu buddhist atheist
black white asian african european american mexican chinese indian arab turkish
gay lesbian straight bisexual transgender
immigrants refugees foreigners
immigrant refugee foreigner
disabled deaf blind
elderly teenagers
frauen männer
christen muslime juden
schwarze ausländer flüchtlinge
femmes hommes
chrétiens musulmans juifs
noirs étrangers
mujeres hombres
cristianos musulmanes judíos
negros extranjeros
""".strip().split("\n")
)
IDENTITY_TERMS = tuple(t for kind in KINDS for t in kind)

RESULT = "doc_id long, score double"


#: Lengths (bytes) of the word beginnings that are features beside whole words, so that a stem is known by whatever ending.
STEMS = (3, 4, 5, 6, 7)


def features_of(words: set[bytes], terms=frozenset()) -> set[bytes]:
    """Distinct words and their beginnings, marked by `*`. Identity terms have no beginnings: a swap changes all that they are."""
    out = set(words)
    for k in STEMS:
        out.update([w[:k] + b"*" for w in words if len(w) >= k and w not in terms])
    return out


def features(text: bytes, terms=frozenset()) -> set[bytes]:
    return features_of(set(alpha_words(text)), terms)


def swapped(words: set[bytes], others: dict[bytes, tuple[bytes, ...]]) -> list[set[bytes]]:
    """The words of a text with each of its identity terms swapped for every other of its kind, and taken out."""
    out = []
    for term in sorted(words & others.keys()):
        rest = words - {term}
        out += [rest, *(rest | {t} for t in others[term])]
    return out


def _words(terms: frozenset[bytes]):
    def run(batches):
        for b in sub_batches(batches):
            labels, words = [], []
            for y, t in zip(b.column(1).to_pylist(), texts_of(b), strict=True):
                seen = features(t, terms)
                words.extend(seen)
                labels.extend([y] * len(seen))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(labels, pa.int32())], names=["word", "label"])

    return run


def _indices(vocab: dict[bytes, int], others: dict[bytes, tuple[bytes, ...]]):
    """Per text: label, the vocabulary's words in it, and the same of each text that a swap makes of it (their sizes, and their words end to end)."""
    plain = frozenset(others)

    def numbers(words: set[bytes]) -> np.ndarray:
        return np.array(sorted(vocab[w] for w in features_of(words, plain) if w in vocab), np.int32)

    def run(batches):
        for b in sub_batches(batches):
            idx, sizes, swaps = [], [], []
            for t in texts_of(b):
                words = set(alpha_words(t))
                idx.append(numbers(words).tobytes())
                made = [numbers(x) for x in swapped(words, others)]
                sizes.append(np.array([len(x) for x in made], np.int32).tobytes())
                swaps.append(b"".join(x.tobytes() for x in made))
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(x, pa.binary()) for x in (idx, sizes, swaps))], names=["label", "idx", "sizes", "swaps"])

    return run


class Swaps:
    """The penalty of all swaps: the mean over training texts of the mean squared change of the linear score (the logit) that swaps of the text make. The score after the logistic function is flat where it is near 0 or 1, and would hide the change there."""

    def __init__(self, cols: np.ndarray, owner: np.ndarray, n: int, sizes: list[np.ndarray], swaps: list[np.ndarray]):
        self.cols, self.owner, self.n = cols, owner, n
        count = np.array([len(x) for x in sizes], np.int64)
        self.text = np.repeat(np.arange(n), count)
        self.share = np.repeat(1.0 / np.maximum(count, 1), count) / max(1, n)
        flat = np.concatenate([np.zeros(0, np.int32), *sizes])
        self.swap_cols, self.swap_owner = np.concatenate([np.zeros(0, np.int32), *swaps]), np.repeat(np.arange(len(flat)), flat)

    def value_and_grad(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """w: weights of words, and the bias last."""
        d = len(w) - 1
        change = np.bincount(self.owner, w[self.cols], self.n)[self.text] - np.bincount(self.swap_owner, w[self.swap_cols], len(self.text))
        on_text, on_swap = np.bincount(self.text, 2 * self.share * change, self.n), -2 * self.share * change
        g = np.empty(d + 1)
        g[:d] = np.bincount(self.cols, on_text[self.owner], d) + np.bincount(self.swap_cols, on_swap[self.swap_owner], d)
        g[d] = 0.0  # the bias is in both
        return float((self.share * change**2).sum()), g


def fit(labelled: DataFrame, cap: int = 6000, max_features: int = 4096, l2: float = 3e-4, counterfactual: float = 1.0, steps: int = 400, kinds=KINDS) -> dict:
    """Learns from labelled (doc_id, text, label 0/1), about `cap` rows of each label at most.

    Words are chosen by chi-square of presence against the label; identity terms that occur are always among them."""
    others = {t.encode(): tuple(x.encode() for x in kind if x != t) for kind in kinds for t in kind}
    labelled = labelled.filter(F.col("label").isin(0, 1)).select("text", F.col("label").cast("int").alias("label"), "doc_id")
    stats = (
        labelled.select("text", "label").mapInArrow(_words(frozenset(others)), "word binary, label int")
        .groupBy("word").agg(F.sum(F.col("label").cast("long")).alias("a"), F.count("*").alias("n"))
    )
    n_pos, n_all = (labelled.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first())
    if not n_all or n_pos in (0, n_all):
        rate = float(n_pos) / n_all if n_all else 0.0
        return {"weights": {}, "terms": frozenset(), "bias": float(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9)))}
    a, n, p = F.col("a"), F.col("n"), n_pos / n_all
    chi = (a - n * p) * (a - n * p) / (n * p * (1 - p))
    top = stats.filter(n >= 3).select("word", chi.alias("chi")).orderBy(F.desc("chi"), "word").limit(max_features).collect()
    words = list(dict.fromkeys([bytes(r["word"]) for r in top if r["chi"] > 10.0] + list(others)))
    vocab = {w: k for k, w in enumerate(words)}
    rows = labelled.select("text", "label").mapInArrow(_indices(vocab, others), "label int, idx binary, sizes binary, swaps binary").collect()
    y = np.array([r["label"] for r in rows], float)
    lens = np.array([len(r["idx"]) // 4 for r in rows])
    cols, owner = np.frombuffer(b"".join(r["idx"] for r in rows), np.int32), np.repeat(np.arange(len(rows)), lens)
    ints = lambda name: [np.frombuffer(r[name], np.int32) for r in rows]
    swaps, d = Swaps(cols, owner, len(rows), ints("sizes"), ints("swaps")), len(words)

    def grad(w):
        z = np.bincount(owner, w[cols], len(rows)) + w[d]
        r = (sigmoid(z) - y) / len(rows)
        g = np.empty(d + 1)
        g[:d], g[d] = np.bincount(cols, r[owner], d), r.sum()
        g[:d] += l2 * w[:d]
        if counterfactual and len(swaps.text):
            g += counterfactual * swaps.value_and_grad(w)[1]
        return g

    w0 = np.zeros(d + 1)
    w0[d] = np.log(p / (1 - p))
    w = adam(grad, w0, steps, 0.15)
    return {"weights": {x: float(w[k]) for x, k in vocab.items() if abs(w[k]) > 1e-6}, "bias": float(w[d]), "terms": frozenset(others)}


def score_text(model: dict, text: bytes) -> float:
    get = model["weights"].get
    # sorted: the sum's order, and so its last digits, are the same on every machine
    return float(sigmoid(model["bias"] + sum(sorted(x for x in map(get, features(text, model["terms"])) if x is not None))))


#: Sentences that no training text is, in which a group's name stands for {}.
TEMPLATES = ("the {} met in town today", "my neighbours are {} and we had dinner", "a film about {} won the prize", "many {} work at the hospital", "she wrote a book on {} history")


def gap(model: dict, templates=TEMPLATES, kinds=KINDS) -> float:
    """The mean difference between the largest and the least score that the terms of a kind give to a sentence."""
    spans = []
    for template in templates:
        for kind in kinds:
            s = [score_text(model, template.format(t).encode()) for t in kind]
            spans.append(max(s) - min(s))
    return float(np.mean(spans))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and the score, 0 to 1, of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in sub_batches(batches):
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([score_text(m, t) for t in texts_of(b)], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, cap: int, folds: int, held: int, seed: str) -> DataFrame:
    """(doc_id, text, label) of about `cap` rows at most of each label, none from the held-out fold. Labels are sampled before they meet the texts, so the side that is broadcast has 2 * cap rows at most."""
    from .common import fold

    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & (fold("doc_id", folds) != held) & F.col("doc_id").isNotNull())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(stratified(known, "label", "doc_id", cap, seed)), "doc_id")
