"""Packing token ids into sequences along a space-filling curve, so that neighbours in a sequence are alike.

1. Texts are tokenised once. The ids of a document, hashed into BUCKETS signed buckets (each counted as log(1 + n), the vector scaled to length 1), are projected to AXES dimensions by a fixed random matrix. Ids and projections are written down.
2. Each axis' mean and spread over all documents turn a projection into a place between 0 and 1 (the normal distribution's), so that documents spread over the cube whatever the corpus is; its cell of 2^BITS a side has a Hilbert key.
3. Rows are range-sorted by (key, doc_id, row number): documents with one key, copies for example, are split over partitions like any others.
4. In each range partition the documents' ids are laid end to end and cut every `size` ids, so no sequence has padding. What is left at the end of a partition, less than one sequence, is cut into sequences whose lengths are the powers of two that it is the sum of, largest first; these need no padding either. Only the number of sequences of each partition comes to the driver, to number them without gaps.

A task holds one sequence's pieces and a batch of ids; no table of ids is kept besides the first. The number of partitions only moves the places of the short sequences.

Edge cases: a null or empty text is its end id alone; repeated rows are packed as often as they come, and null ids too (they sort first); ties of the key are ordered by id, then by where the row was written; a text over `size` ids is cut into many pieces in one pass; an empty table has no pieces. Only doc_id and text are read, so other columns may have any name. A corpus whose documents all have one projection lies in one cell, in the order of ids.
"""

from __future__ import annotations

import zlib
from math import erf

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sub_batches, texts_of
from .token_store import encoder

SIZE = 2048
BUCKETS, AXES, BITS = 1024, 4, 12
#: Documents that are projected at once; their numbers and ids fit 32 bits.
TOGETHER = 256
#: Ids that are laid out at once, in bytes.
IDS_BYTES = 1 << 22
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_ids = np.arange(1 << 16, dtype=np.uint64)
_hash = (_ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
_hash = (_hash ^ (_hash >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
_bucket = ((_hash >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)
_sign = 1 - 2 * ((_hash >> np.uint64(39)) & np.uint64(1)).astype(np.int8)
_matrix = np.random.default_rng(13).normal(size=(BUCKETS, AXES))


def project(docs: list[np.ndarray]) -> np.ndarray:
    """The places of documents (arrays of ids) on the axes; zeros for one whose buckets cancel out.

    So many documents at once are counted by one sort of (document, id)."""
    out = np.zeros((len(docs), AXES))
    for k in range(0, len(docs), TOGETHER):
        some = docs[k : k + TOGETHER]
        pairs = np.concatenate(some).astype(np.uint32) | np.repeat(np.arange(len(some), dtype=np.uint32) << np.uint32(16), [len(x) for x in some])
        pairs.sort()
        first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)])
        ids, owner = pairs[first] & np.uint32(0xFFFF), (pairs[first] >> np.uint32(16)).astype(np.int64)
        weights = _sign[ids] * np.log1p(np.diff(np.append(first, len(pairs))))
        sums = np.bincount(owner * BUCKETS + _bucket[ids], weights=weights, minlength=len(some) * BUCKETS).reshape(-1, BUCKETS)
        for j, v in enumerate(sums, k):
            length = np.sqrt(v @ v)
            if length:
                out[j] = (v / length) @ _matrix
    return out


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys (rows, axes) -> places along the Hilbert curve through a cube of 2^bits cells a side: keys that follow one another are neighbouring cells.

    From the coarsest bit to the finest, each axis whose bit is set mirrors the first axis' finer bits, one whose bit isn't set exchanges them with the first axis'; then the axes' bits, read across, are a Gray code of the key."""
    x, axes = cells.astype(np.int64).copy(), cells.shape[1]
    for b in range(bits - 1, 0, -1):
        finer = (1 << b) - 1
        for a in range(axes):
            up = (x[:, a] >> b & 1).astype(bool)
            x[up, 0] ^= finer
            swap = np.where(up, 0, (x[:, 0] ^ x[:, a]) & finer)
            x[:, 0] ^= swap
            x[:, a] ^= swap
    key, parity = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for a in range(axes):
            parity ^= x[:, a] >> b & 1  # the Gray code undone: each bit is the parity of all before it
            key = key << 1 | parity
    return key


def _tokenised(vocabulary: str, end_id: int):
    """doc_id, text -> doc_id, ids, the number of the row of the table that is written, and its projection."""
    end = np.array([end_id], "<u2").tobytes()

    def run(batches):
        encode, row = encoder(vocabulary).batch, TaskContext.get().partitionId() << 40
        for b in sub_batches(batches):
            ids = encode(texts_of(b), end)
            at = project([np.frombuffer(x, np.uint16) for x in ids])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(np.arange(row, row + b.num_rows)), *(pa.array(at[:, k]) for k in range(AXES))], names=["doc_id", "ids", "row", *(f"a{k}" for k in range(AXES))])
            row += b.num_rows

    return run


def _key(centre: np.ndarray, spread: np.ndarray):
    @F.pandas_udf("long")
    def key(*axes: pd.Series) -> pd.Series:
        z = (np.stack([a.to_numpy() for a in axes], 1) - centre) / spread / np.sqrt(2)
        cells = np.array([[(1 + erf(v)) / 2 * (1 << BITS) for v in r] for r in z.tolist()]).reshape(-1, AXES)
        return pd.Series(hilbert_key(np.clip(cells.astype(np.int64), 0, (1 << BITS) - 1)))

    return key


class Layout:
    """Pieces of documents that are laid end to end. Numbers of sequences start at 0."""

    def __init__(self, size: int, with_ids: bool):
        self.size, self.with_ids, self.sequence, self.used = size, with_ids, 0, 0
        self.open: list[tuple] = []  # pieces of the sequence that isn't full: doc_id, start, ids, doc_tokens

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[tuple]:
        """The pieces of all sequences that the document fills."""
        out, at, n = [], 0, len(ids)
        while at < n:
            take = min(n - at, self.size - self.used)
            self.open.append((doc_id, at, ids[at : at + take], n))
            self.used += take
            at += take
            if self.used == self.size:
                out += self._close()
        return out

    def _close(self) -> list[tuple]:
        out, offset = [], 0
        for doc_id, start, ids, n in self.open:
            out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, self.sequence, offset, ids.tolist() if self.with_ids else None))
            offset += len(ids)
        self.sequence, self.used, self.open = self.sequence + 1, 0, []
        return out

    def rest(self) -> list[tuple]:
        """The pieces of what isn't a full sequence, in sequences of powers of two."""
        left, lengths = self.open, [1 << b for b in range(self.used.bit_length() - 1, -1, -1) if self.used >> b & 1]
        out, k, at = [], 0, 0
        for length in lengths:
            self.open, room = [], length
            while room:
                doc_id, start, ids, n = left[k]
                take = min(room, len(ids) - at)
                self.open.append((doc_id, start + at, ids[at : at + take], n))
                room, at = room - take, at + take
                if at == len(ids):
                    k, at = k + 1, 0
            out += self._close()
        return out


def _laid_out(size: int, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "in_part", "offset", "ids"]
    types = [pa.int64()] * 7 + [pa.list_(pa.int32())]

    def batch(part: int, pieces: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*pieces, strict=True), types, strict=True)][: 8 if with_ids else 7]
        return pa.RecordBatch.from_arrays([pa.array([part] * len(pieces), pa.int32()), *columns], names=["part", *names[: len(columns)]])

    def run(batches):
        part, layout, out, held = TaskContext.get().partitionId(), Layout(size, with_ids), [], 0
        for b in batches:
            for doc_id, ids in zip(b.column(0), b.column(1), strict=True):
                ids = np.frombuffer(ids.as_py(), np.uint16)
                out += layout.add(doc_id.as_py(), ids)
                held += 2 * len(ids)
                if held > IDS_BYTES and out:
                    yield batch(part, out)
                    out, held = [], 0
        out += layout.rest()
        if out:
            yield batch(part, out)

    return run


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, start (ids of its document before it), length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if wanted."""
    scratch = Scratch(docs.sparkSession, "packing")
    axes = [f"a{k}" for k in range(AXES)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = scratch.save(texts.mapInArrow(_tokenised(vocabulary, end_id), "doc_id long, ids binary, row long, " + ", ".join(f"{a} double" for a in axes)), "tokens")
    found = tokens.agg(*(F.avg(a) for a in axes), *(F.stddev_pop(a) for a in axes)).first()
    centre, spread = (np.array([x or 0.0 for x in found[k : k + AXES]]) for k in (0, AXES))
    keyed = tokens.select(_key(centre, np.where(spread > 1e-9, spread, 1.0))(*axes).alias("key"), "doc_id", "ids", "row")
    order = [F.col("key"), F.col("doc_id").asc_nulls_first(), F.col("row")]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
    laid = "part int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, in_part long, offset long" + ", ids array<int>" * with_ids
    pieces = scratch.save(ranged.mapInArrow(_laid_out(size, with_ids), laid), "pieces")
    scratch.free("tokens")
    base, first = 0, {}
    for r in sorted(pieces.groupBy("part").agg((F.max("in_part") + 1).alias("n")).collect()):  # a row for each range partition
        first[r["part"]] = base
        base += r["n"]
    if not first:
        return docs.sparkSession.createDataFrame([], PIECES + ", ids array<int>" * with_ids)
    firsts = docs.sparkSession.createDataFrame(list(first.items()), "part int, first long")
    out = pieces.join(F.broadcast(firsts), "part").withColumn("sequence_id", F.col("first") + F.col("in_part"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))


def sequences(pieces: DataFrame) -> DataFrame:
    """Pieces with their ids -> sequence_id and the ids of the whole sequence."""
    parts = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
