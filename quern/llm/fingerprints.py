"""Document fingerprints by locally consistent parsing.

A text's code points are the names of level 0. On each level, runs of one name are folded into one name; deterministic coin tossing (the lowest bit in which a name differs from its left neighbour, and that bit's value) shrinks the alphabet to six labels in a few rounds; strict local minima of the labels start phrases; a phrase's name, a hash of its members, goes up a level. A cut depends on a few names to its left and one to its right, so equal substrings are parsed alike inside, wherever they stand.

The fingerprint keeps, in bins, the least phrase names: 64 bins for levels 2 to 4 and 16 for level 1, 16 bits each, as hexadecimal digits. `likeness` is the share of agreeing bins, by levels 2 to 4 where either text has enough such phrases.

Edge cases: null is empty; an empty text's fingerprint is all zeros; two empty texts have likeness 1, one empty text and another 0. The parse of a chunk of texts is vectorised over all of them, and phrases never cross texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS, LOW_BINS, LEVELS, ENOUGH = 64, 16, 4, 12


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing: neighbours that differ get labels that differ."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[first] = ~x[first]
    d = x ^ left
    low = d & (~d + np.uint64(1))
    at = np.frexp(low.astype(np.float64))[1].astype(np.uint64) - np.uint64(1)  # a power of two is exact
    return (at << np.uint64(1)) | ((x >> at) & np.uint64(1))


def _level(x: np.ndarray, first: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of the next level. first: places where texts begin."""
    start = np.ones(len(x), bool)
    start[1:] = x[1:] != x[:-1]
    start[first] = True
    at = np.flatnonzero(start)
    if len(at) < len(x):
        runs = np.diff(np.append(at, len(x)))
        y = x[at]
        x = np.where(runs > 1, _mix(y + _mix(runs.astype(np.uint64))), y)
        first = np.searchsorted(at, first)
        # two folded runs never get one name side by side, but for a collision of hashes; the toss would then cut there
    label = x
    for _ in range(4):
        label = _toss(label, first)
    cut = np.ones(len(x), bool)
    right = np.append(label[1:], np.uint64(99))
    right[first[1:] - 1] = 99
    cut[1:] = (label[1:] < label[:-1]) & (label[1:] < right[1:])
    cut[first] = True
    at = np.flatnonzero(cut)
    place = np.arange(len(x)) - np.repeat(at, np.diff(np.append(at, len(x))))
    names = _mix(np.add.reduceat(_mix(x + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), at) + np.uint64(level))
    return names, np.searchsorted(at, first)


def sketches(texts: list[str]) -> np.ndarray:
    """A row of LOW_BINS + BINS 16-bit numbers for each text; 0 is an empty bin."""
    best = np.full((len(texts), LOW_BINS + BINS), np.iinfo(np.uint64).max, np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        x = _mix(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
        first = (np.cumsum(sizes) - sizes)[full]
        flat = best.reshape(-1)
        for level in range(1, LEVELS + 1):
            x, first = _level(x, first, level)
            owner = np.repeat(full, np.diff(np.append(first, len(x))))
            h = _mix(x)
            bins = (h >> np.uint64(60)) if level == 1 else (h >> np.uint64(58)) + np.uint64(LOW_BINS)
            np.minimum.at(flat, owner * (LOW_BINS + BINS) + bins.astype(np.int64), h & np.uint64((1 << 58) - 1))
    return np.where(best == np.iinfo(np.uint64).max, 0, 1 + _mix(best) % np.uint64(65535)).astype(np.uint16)


def to_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: agreeing bins among those that either text fills. Dice's measure, so that two thirds in common give about two thirds."""
    used = (a > 0) | (b > 0)
    if not used.any():
        return 1.0
    if used[LOW_BINS:].sum() >= ENOUGH:
        a, b, used = a[LOW_BINS:], b[LOW_BINS:], used[LOW_BINS:]
    j = float(((a == b) & used).sum() / used.sum())
    return round(2 * j / (1 + j), 9)


def likeness_of_texts(a: str, b: str) -> float:
    """As `likeness`, of two fingerprints."""
    x, y = (np.frombuffer(bytes.fromhex(s), ">u2").astype(np.uint16) for s in (a, b))
    return likeness(x, y)


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and the fingerprint of every whole text, in one pass."""
    from .common import sub_batches

    def run(batches):
        for b in sub_batches(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([to_text(s) for s in sketches(texts)])], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


_LEAST = -(1 << 63)


def with_successors(docs: DataFrame) -> DataFrame:
    """Rows (part, guest, doc_id, text) such that, sorted by these within a part (doc_id descending), each row that is no guest is followed by the next document in descending doc_id, the last of all by the first.

    Ranges of doc_id make parts; a part's guest is the first document after its last one. Texts are shuffled once. What comes to the driver is a number for each part. A null doc_id counts as the least; repeated ids are sorted by text."""
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))
    ids = docs.select(key.alias("k"))
    got = ids.agg(F.percentile_approx("k", F.array(*[F.lit(i / n) for i in range(1, n)]) if n > 1 else F.array(F.lit(0.5)), 10_000)).first()[0]
    bounds = np.unique(np.array(got or [], np.int64))

    def part_of(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, b.column(0).to_numpy(zero_copy_only=False), "right").astype(np.int32)), b.column(0)], names=["part", "k"])

    tops = sorted((r["part"], r["top"]) for r in ids.mapInArrow(part_of, "part int, k long").groupBy("part").agg(F.max("k").alias("top")).collect())
    guests: dict[int, list[int]] = {}
    for (part, _), (_, top) in zip(tops, [tops[-1], *tops[:-1]] if tops else [], strict=True):
        guests.setdefault(top, []).append(part)

    def deal(batches):
        for b in batches:
            k = b.column(0).to_numpy(zero_copy_only=False)
            own = pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, k, "right").astype(np.int32)), pa.array(np.zeros(len(k), bool)), b.column(0), b.column(1)], names=["part", "guest", "k", "text"])
            yield own
            for i in np.flatnonzero(np.isin(k, list(guests))).tolist():
                for part in guests[int(k[i])]:
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([True]), *(c.slice(i, 1) for c in b.columns)], names=["part", "guest", "k", "text"])

    dealt = docs.select(key.alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(deal, "part int, guest boolean, k long, text string")
    return dealt.repartitionByRange(n, "part").sortWithinPartitions("part", "guest", F.desc("k"), "text")


def against_edited(docs: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """Each document's fingerprint, that of an edited copy (its last third replaced by the start of the next document), and likenesses."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def finish(pairs):
        ids, texts, nexts = zip(*pairs, strict=True)
        edited = []
        for t, u in zip(texts, nexts, strict=True):
            k = len(t) // 3
            edited.append(t[: len(t) - k] + u[:k] if k else t)
        n = len(texts)
        # a text's successor is mostly the next text of the chunk
        other = [u if i + 1 == n or texts[i + 1] is not u else None for i, u in enumerate(nexts)]
        extra = [u for u in other if u is not None]
        s = sketches([*texts, *edited, *extra])
        after, k = [], 2 * n
        for i, u in enumerate(other):
            after.append(s[i + 1] if u is None else s[k])
            k += u is not None
        return pa.RecordBatch.from_arrays([
            pa.array([None if d == _LEAST else d for d in ids], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]),
            pa.array([to_text(x) for x in s[:n]]), pa.array([to_text(x) for x in s[n : 2 * n]]), pa.array([likeness(a, b) for a, b in zip(s[:n], s[n : 2 * n], strict=True)]), pa.array([likeness(a, b) for a, b in zip(s[:n], after, strict=True)]),
        ], names=names)

    def run(batches):
        last, pairs, size = None, [], 0
        for b in batches:
            for part, guest, k, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if last is not None and last[0] == part and not last[1]:
                    pairs.append((last[2], last[3], text))
                    size += len(last[3])
                    if size >= chunk:
                        yield finish(pairs)
                        pairs, size = [], 0
                last = (part, guest, k, text)
        if pairs:
            yield finish(pairs)

    return with_successors(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
