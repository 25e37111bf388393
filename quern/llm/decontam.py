"""Benchmark decontamination: document windows against a hash set of benchmark n-grams.

A window is `size` consecutive words of an item; an item of fewer words, but not none, is one window. The windows are broadcast, with their words, where their number is within `max_windows`; larger benchmarks are cut into parts of about that size by a hash of the item, and each part is scanned for in turn, so the broadcast stays bounded and no window is dropped: the documents are written once with a row number, each part's pass reads their texts and writes only numbers and hits of rows that have any, and the hits of all parts are joined to the rows. A scan hashes every run of known words, looks the hashes up, and verifies hits word by word.

Results per document: its hit words, from which spans or whole documents are removed. No shuffle of texts.

Edge cases: null has no words; an item or a document without words meets nothing; repeated items are all counted; repeated rows, and rows with one id or a null one, are documents of their own; with an empty benchmark nothing is hit, and an empty table gives an empty result. A very long text is scanned in one piece, by itself, in memory that is a small multiple of it. Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, alnum_words, fresh, sub_batches, texts_of

SIZE = 10
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20


def item_windows(text: str | None, size: int = SIZE) -> list[tuple[bytes, ...]]:
    w = alnum_words((text or "").encode())
    return list(dict.fromkeys(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))) if w else []


class Index:
    """Windows by their words' numbers, and a bitmap of their hashes."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[str]]):
        self.vocab: dict[bytes, int] = {}
        for w in windows:
            for x in w:
                self.vocab.setdefault(x, len(self.vocab))
        self.items = {tuple(self.vocab[x] for x in w): names for w, names in windows.items()}
        self.by_size: dict[int, np.ndarray] = {}
        for w in self.items:
            seen = self.by_size.setdefault(len(w), np.zeros(1 << _BITS, bool))
            seen[int(self._hash(np.array(w, np.int64), len(w))[0] >> np.uint64(64 - _BITS))] = True

    @staticmethod
    def _hash(ids: np.ndarray, size: int) -> np.ndarray:
        n, h = len(ids) - size + 1, np.zeros(max(0, len(ids) - size + 1), np.uint64)
        for j in range(size):
            h = h * _MULT + ids[j : j + n].astype(np.uint64) + np.uint64(1)
        return h ^ (h << np.uint64(29))

    def scan(self, ids: np.ndarray, hit: np.ndarray, found: list[tuple[int, tuple[int, ...]]]) -> None:
        """ids: the words' numbers, -1 for one that no window has. Marks hit words; found gets each occurrence's place and window."""
        known = np.concatenate([[0], np.cumsum(ids < 0)])
        for size, seen in self.by_size.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(known[size:] == known[:-size])
            if not len(at):
                continue
            h = np.zeros(len(at), np.uint64)
            for j in range(size):
                h = h * _MULT + ids[at + j].astype(np.uint64) + np.uint64(1)
            h ^= h << np.uint64(29)
            for k in at[seen[h >> np.uint64(64 - _BITS)]].tolist():
                w = tuple(ids[k : k + size].tolist())
                if w in self.items:
                    hit[k : k + size] = True
                    found.append((k, w))


def _scanned(index: Index, b: pa.RecordBatch) -> tuple[np.ndarray, list[list[int]], list[list[str]]]:
    """Per row of the batch: the number of words, the places of hit words, and the items met."""
    get, words = index.vocab.get, [alnum_words(t) for t in texts_of(b)]
    ids: list[int] = []
    starts = []
    for w in words:
        starts.append(len(ids))
        ids.extend(get(x, -1) for x in w)
        ids.append(-1)  # no window crosses documents
    hit, found = np.zeros(len(ids), bool), []
    index.scan(np.array(ids, np.int64), hit, found)
    items: list[set[str]] = [set() for _ in words]
    for d, (_, w) in zip((np.searchsorted(starts, [k for k, _ in found], "right") - 1).tolist(), found, strict=True):
        items[d].update(index.items[w])
    n = np.array([len(w) for w in words], np.int64)
    hits = [np.flatnonzero(hit[s : s + k]).tolist() for s, k in zip(starts, n.tolist(), strict=True)]
    return n, hits, [sorted(x) for x in items]


def _parts(items: DataFrame, size: int, max_windows: int):
    """Broadcasts of the windows of each part in turn; mostly there is one."""
    counted = items.select(F.sum(F.greatest(F.lit(1), F.length("text") / 2))).first()[0] or 0  # no more windows than half the characters
    parts = max(1, int(-(-counted // max_windows)))
    for k in range(parts):
        windows: dict[tuple[bytes, ...], list[str]] = {}
        for r in items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k).toLocalIterator():
            for w in item_windows(r["text"], size):
                windows.setdefault(w, []).append(r["item"] or "")
        yield parts, items.sparkSession.sparkContext.broadcast(Index(windows))


def _run(docs: DataFrame, benchmark: DataFrame, size: int, max_windows: int, last, schema) -> DataFrame:
    """Scans with each part of the benchmark; `last` makes the result's batch of a batch and what was found in it."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    names, found, scratch, base = docs.columns, [], None, None
    row, hits, met = (fresh(f"__quern_{x}", names) for x in ("row", "hits", "items"))
    for k, (parts, shared) in enumerate(_parts(items, size, max_windows)):
        if parts == 1:

            def run(batches, shared=shared):
                index = shared.value
                for b in sub_batches(batches):
                    yield last(b, *_scanned(index, b))

            return docs.mapInArrow(run, schema)
        if base is None:
            scratch = Scratch(docs.sparkSession, "decontam")
            base = scratch.save(docs.withColumn(row, F.monotonically_increasing_id()), "base")

        def part(batches, shared=shared):
            index = shared.value
            for b in sub_batches(batches):
                _, places, names_met = _scanned(index, b)
                some = [i for i, x in enumerate(places) if x]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some, pa.int64())), pa.array([places[i] for i in some], pa.list_(pa.int64())), pa.array([names_met[i] for i in some], pa.list_(pa.string()))], names=["row", "hits", "items"])

        found.append(scratch.save(base.select(F.col(row).alias("row"), "text").mapInArrow(part, "row long, hits array<long>, items array<string>"), f"part{k}"))
        shared.unpersist()
    every = functools.reduce(DataFrame.unionByName, found)
    merged = every.groupBy("row").agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(n) for c, n in (("hits", hits), ("items", met)))).withColumnRenamed("row", row)

    def done(batches):
        for b in sub_batches(batches):
            n = np.array([len(alnum_words(t)) for t in texts_of(b)], np.int64)
            places, names_met = ([x or [] for x in b.column(b.schema.get_field_index(c)).to_pylist()] for c in (hits, met))
            yield last(b.select(names), n, places, names_met)

    return base.join(scratch.save(merged, "merged"), row, "left").select(*(F.col(f"`{c}`") for c in [*names, hits, met])).mapInArrow(done, schema)


def scan(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, max_windows: int = 500_000) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (names of the items with occurring windows, sorted), hits (places of hit words)."""

    def last(b, n, hits, met):
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array([len(h) for h in hits], pa.int64()), pa.array(met, pa.list_(pa.string())), pa.array(hits, pa.list_(pa.int64()))], names=["doc_id", "n_words", "n_hit", "items", "hits"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _run(texts, benchmark, size, max_windows, last, "doc_id long, n_words long, n_hit long, items array<string>, hits array<long>")


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text: str | None, hits: list[int]) -> str | None:
    """The text without the runs of hit words; the marks and spaces between two hit words of a run go with them."""
    if not text or not hits:
        return text
    raw, spans = text.encode(), [m.span() for m in _WORD.finditer(text.encode())]
    out, at, gone = [], 0, set(hits)
    for k in hits:
        out.append(raw[at : spans[k][0]] if k - 1 not in gone else b"")
        at = spans[k][1]
    return b"".join([*out, raw[at:]]).decode()


def clean(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, max_windows: int = 500_000, drop_over: float = 0.5) -> DataFrame:
    """The documents without their hit spans; a document goes if more than `drop_over` of its words are hit. Columns stay as they are."""

    def last(b, n, hits, met):
        at = b.schema.get_field_index("text")
        texts = [cut(t, h) if h else t for t, h in zip(b.column(at).to_pylist(), hits, strict=True)]
        keep = pa.array([len(h) <= drop_over * k for h, k in zip(hits, n.tolist(), strict=True)], pa.bool_())
        return b.set_column(at, "text", pa.array(texts, b.schema.field(at).type)).filter(keep)

    return _run(docs, benchmark, size, max_windows, last, docs.schema)
