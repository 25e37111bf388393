"""Language identification in two levels.

First the language's family is predicted; then one-versus-one linear support vector machines separate the family's languages, each pair by a machine of its own, and the votes (ties: the sum of margins) decide. All machines are trained here on hashed byte n-grams of lower-cased text.

Families come from FAMILIES; a language that isn't in it joins the family whose mean profile is nearest to its own, if the cosine is high enough, else it is a family of its own.

The sample is bounded (`cap` rows a language); every whole text is read once, without a shuffle.

Edge cases: a text that is null or has no letter is `und` with score 0. Without training rows every text is `und`; with one language, that one is predicted. Ties go to the language that sorts first.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import adam, sigmoid, sub_batches

#: Families of languages by code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz".split(),
    "indo-aryan": "hi mr ne bn ur gu pa".split(),
}

DIMS = 4096
_LETTER = regex.compile(r"\p{L}")
_CLEAN = bytes(32 if c < 97 or 123 <= c < 128 else c for c in range(256))
UND = "und"


def profile(text: str) -> np.ndarray:
    """Unit vector of the square roots of hashed counts of 2-, 3- and 4-grams of bytes; runs of non-letters are one space."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "ignore").translate(_CLEAN).split()) + b" "
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    out = np.zeros(DIMS)
    h = a
    for k in (2, 3, 4):
        if len(a) < k:
            break
        h = h[: len(a) - k + 1] * np.uint32(0x9E3779B1) + a[k - 1 :] + np.uint32(k)
        g = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        out += np.bincount(g >> np.uint32(20), minlength=DIMS)
    out = np.sqrt(out)
    return out / max(1e-12, float(np.linalg.norm(out)))


def _profiles(batches):
    for b in sub_batches(batches):
        texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
        keep = [(x, y) for x, y in zip(texts, langs, strict=True) if x and _LETTER.search(x)]
        yield pa.RecordBatch.from_arrays([pa.array([y for _, y in keep], pa.string()), pa.array([profile(x).astype(np.float32).tobytes() for x, _ in keep], pa.binary())], names=["lang", "p"])


def _svm(x: np.ndarray, sign: np.ndarray, l2: float = 1e-4, steps: int = 200) -> np.ndarray:
    """Squared-hinge linear machine, weights and bias; the two sides weigh the same."""
    n_pos = max(1, int((sign > 0).sum()))
    share = np.where(sign > 0, 0.5 / n_pos, 0.5 / max(1, len(sign) - n_pos))

    def grad(w):
        slack = np.maximum(0.0, 1.0 - sign * (x @ w[:-1] + w[-1]))
        r = (-2.0 * share * sign * slack).astype(np.float32)
        return np.append(r @ x + l2 * w[:-1], r.sum())

    return adam(lambda w: grad(w), np.zeros(x.shape[1] + 1), steps, 0.1).astype(np.float64)


def fit(rows: DataFrame, cap: int = 800, families: dict[str, list[str]] = FAMILIES, near: float = 0.8) -> dict:
    """Learns from (text, lang), a sample that the caller bounds to about `cap` rows of each language."""
    got = rows.filter(F.col("lang").isNotNull()).select("text", "lang").mapInArrow(_profiles, "lang string, p binary").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["p"])))
    langs = sorted({r["lang"] for r in got})
    if not langs:
        return {"families": {}}
    x = np.stack([np.frombuffer(r["p"], np.float32) for r in got])
    y = np.array([langs.index(r["lang"]) for r in got])
    del got
    means = {g: x[y == k].mean(0) for k, g in enumerate(langs)}
    known = {g: f for f, names in families.items() for g in names}
    groups: dict[str, list[str]] = {}
    for g in langs:
        if g in known:
            groups.setdefault(known[g], []).append(g)
    cosine = lambda a, b: float(a @ b / max(1e-12, np.linalg.norm(a) * np.linalg.norm(b)))
    for g in (g for g in langs if g not in known):
        best = max(((cosine(means[g], means[m]), f) for f, ms in groups.items() for m in ms), default=(0.0, ""))
        groups.setdefault(best[1] if best[0] >= near else f"own-{g}", []).append(g)
    names = sorted(groups)
    of = np.array([names.index(next(f for f in names if g in groups[f])) for g in langs])[y]
    model = {"names": names, "families": groups, "family": [_svm(x, np.where(of == k, 1.0, -1.0)) for k in range(len(names))] if len(names) > 1 else None, "pairs": {}}
    for f in names:
        for a, b in combinations(sorted(groups[f]), 2):
            ka, kb = langs.index(a), langs.index(b)
            m = (y == ka) | (y == kb)
            model["pairs"][(a, b)] = _svm(x[m], np.where(y[m] == ka, 1.0, -1.0))
    return model


def predict(model: dict, text: str | None) -> tuple[str, float]:
    """The language and a score: the family's share times the weakest of the winner's duels, each as a logistic function of the margin."""
    if not text or not model["families"] or not _LETTER.search(text):
        return UND, 0.0
    p = profile(text)
    side = lambda w: float(p @ w[:-1] + w[-1])
    family, score = model["names"][0], 1.0
    if model["family"] is not None:
        margins = [side(w) for w in model["family"]]
        k = int(np.argmax(margins))
        family, score = model["names"][k], float(sigmoid(3.0 * margins[k]))
    members = sorted(model["families"][family])
    if len(members) == 1:
        return members[0], score
    wins, total, worst = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0), dict.fromkeys(members, 9e9)
    for a, b in combinations(members, 2):
        m = side(model["pairs"][(a, b)])
        wins[a if m >= 0 else b] += 1
        for g, v in ((a, m), (b, -m)):
            total[g] += v
            worst[g] = min(worst[g], v)
    best = min(members, key=lambda g: (-wins[g], -total[g], g))
    return best, score * float(sigmoid(3.0 * worst[best]))


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in sub_batches(batches):
            got = [predict(m, t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g for g, _ in got], pa.string()), pa.array([round(s, 9) for _, s in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
