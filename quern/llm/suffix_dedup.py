"""Removal of byte strings that occur in an earlier document, by blockwise sorting of sampled suffixes.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id. All suffixes of 100 TB can't be shuffled, so, as in difference-cover construction, a sample of the suffixes is sorted and decides about the others:

* The cover sample. In each window of `length` bytes the least of the window's K-byte names (the leftmost at ties) is an anchor. Equal windows have equal anchors at equal offsets: for any two equal windows one shift leads both into the sample. That is what a difference cover is for; a cover of fixed residues needs about three times as many places here. The windows with one anchor form a context, a string of length + W - 1 bytes at most.
* Blockwise sorting. The anchors' names fall into buckets; a bucket's suffixes come together and are sorted, one bucket at a time: by the anchor's name, then the context's, then the document. In a context that an earlier document has, all windows are covered. What is left are long ties, anchors that documents share in different contexts.
* Ties. For these, ranks are computed for each distance from the anchor, to the left and to the right (the rank of a string is refined byte by byte from that of the string one shorter). Two windows are equal if their ranks on both sides are, so no string is compared as such, and the memory is that of one bucket's block.

Copies within a task are settled there (only the least document's anchor is sent), so a passage that a third of all documents share costs a bucket one entry for each task. A tied anchor with more than HOT contexts isn't sorted in one task: its windows are named by 128-bit hashes, whose least documents are pre-aggregated.

Edge cases: null is empty; texts under `length` bytes keep everything; repeated rows of one doc_id are one document each, and cover nothing of each other. A null doc_id counts as the least id.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sub_batches, texts_of

LENGTH, K = 50, 20
W = LENGTH - K + 1
HOT = 5_000
#: Names of such anchors that may be broadcast; beyond, the joins are by shuffle.
BROADCAST_NAMES = 1_000_000
#: Contexts of a block of tied anchors.
BLOCK = 50_000
#: Bytes of text to a bucket; its entries are about as many bytes at most.
BUCKET_BYTES = 32 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LEAST = -(1 << 63)


def _mix(x):
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    k = 1
    while k < n:
        step = np.uint64(pow(base, k, 1 << 64))
        out[k : 2 * k] = out[: min(k, n - k)] * step
        k *= 2
    return out


_cache: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_cache.get("up", ())) < n:
        size = max(n, 1 << 21)
        _cache["up"], _cache["down"] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _cache["up"], _cache["down"]


class Anchors:
    """The contexts of some texts, laid end to end. doc: the text's number; first, last: the first and last window start; at: the anchor, all as places in `raw`; name, context: hashes."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        n = len(self.raw)
        empty = np.zeros(0, np.int64)
        self.doc = self.first = self.last = self.at = empty
        self.name = self.context = empty.view(np.uint64)
        if n < LENGTH:
            return
        up, down = _power_tables(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[self.raw] * up[:n], out=total[1:])
        name = _mix((total[K:] - total[:-K]) * down[: n - K + 1])
        # Least name of each window; the low bits hold the place, so that the leftmost wins and can be read off.
        bits = np.uint64(max(1, int(n).bit_length()))
        low = (name >> bits << bits) | np.arange(len(name), dtype=np.uint64)
        width, span = 1, low
        while width * 2 <= W:
            span = np.minimum(span[:-width], span[width:])
            width *= 2
        if width < W:
            span = np.minimum(span[: len(low) - W + 1], span[W - width :][: len(low) - W + 1])
        at = (span & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
        window_doc = np.repeat(np.arange(len(texts)), self.sizes)[: len(at)]
        inside = np.arange(len(at)) + LENGTH <= (self.starts + self.sizes)[window_doc]
        change = np.ones(len(at), bool)
        change[1:] = (at[1:] != at[:-1]) | (window_doc[1:] != window_doc[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(change)
        last = np.append(first[1:], len(at)) - 1
        keep = inside[first]
        self.first, self.last = first[keep], last[keep]
        self.at, self.doc = at[self.first], window_doc[self.first]
        self.name = name[self.at]
        end = self.last + LENGTH
        shape = (self.at - self.first).astype(np.uint64) * np.uint64(1 << 20) + (self.last - self.first).astype(np.uint64)
        self.context = _mix((total[end] - total[self.first]) * down[self.first] + _mix(shape)) >> np.uint64(8)


def _thin(x: np.ndarray, n: int) -> bytes:
    """The low n bytes of each number."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(data) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8).reshape(-1, n)
    return out.view(np.uint64).ravel()


def _blob(name: np.ndarray, context: np.ndarray, ids: np.ndarray) -> bytes:
    """6 bytes of each name (the bucket holds more of it), 7 of each context, and the ids by differences; ids are mostly in order."""
    return len(name).to_bytes(4, "little") + _thin(name, 6) + _thin(context, 7) + zlib.compress(np.diff(ids, prepend=np.int64(0)).tobytes(), 1)


def _pack(ids: np.ndarray, a: Anchors, take: np.ndarray, bucket: np.ndarray):
    """A row for each bucket that has entries."""
    order = take[np.argsort(bucket[take], kind="stable")]
    b = bucket[order]
    cuts = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else []
    blobs = [_blob(a.name[o], a.context[o], ids[a.doc[o]]) for o in (order[s:e] for s, e in zip(cuts, [*cuts[1:], len(b)], strict=True))]
    return pa.RecordBatch.from_arrays([pa.array(b[cuts].astype(np.int64) if len(b) else np.zeros(0, np.int64)), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def _unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, contexts and ids."""
    sizes = [int.from_bytes(b[:4], "little") for b in blobs]
    names = _wide(b"".join(b[4 : 4 + 6 * n] for b, n in zip(blobs, sizes, strict=True)), 6)
    contexts = _wide(b"".join(b[4 + 6 * n : 4 + 13 * n] for b, n in zip(blobs, sizes, strict=True)), 7)
    return names, contexts, np.concatenate([np.cumsum(np.frombuffer(zlib.decompress(b[4 + 13 * n :]), np.int64)) for b, n in zip(blobs, sizes, strict=True)])


def _squeezed(batches):
    """Texts as they are shuffled: compressed, each by itself."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for b in sub_batches(batches):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pack(t) for t in texts_of(b)], pa.binary())], names=["id", "z"])


def _opened(batches):
    """Batches with the texts as they were in the place of `z`, in bounded pieces."""
    unpack = zstandard.ZstdDecompressor().decompress
    for b in sub_batches(batches, "z", 1 << 18):
        texts = pa.array([unpack(z) for z in b.column(1).to_pylist()], pa.binary())
        yield from sub_batches(iter([pa.RecordBatch.from_arrays([b.column(0), texts, *b.columns[2:]], names=["id", "text", *b.schema.names[2:]])]))


def _ids(b: pa.RecordBatch) -> np.ndarray:
    return b.column(0).to_numpy(zero_copy_only=False)


def _sample(n_buckets: int):
    """Per chunk: its anchors by bucket, a context once with the least document, and the contexts of the chunk's later documents, which are covered (a negative bucket)."""

    def run(batches):
        for b in sub_batches(batches, limit=1 << 21):
            ids, a = _ids(b), Anchors(texts_of(b))
            if not len(a.at):
                continue
            order = np.lexsort((ids[a.doc], a.context, a.name))
            n, c, d = a.name[order], a.context[order], ids[a.doc[order]]
            new = np.append(True, (n[1:] != n[:-1]) | (c[1:] != c[:-1]))
            least = d[np.flatnonzero(new)][np.cumsum(new) - 1]
            done = d > least
            done[1:] &= new[1:] | (d[1:] != d[:-1])  # once for each document
            done = order[done]
            if len(done):  # a bucket of its own: nothing is left to decide there
                done = np.sort(done)
                own = -1 - int(_mix(ids[a.doc[done[:1]]].view(np.uint64))[0] >> np.uint64(2))
                yield pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.array([_blob(a.name[done], a.context[done], ids[a.doc[done]])], pa.binary())], names=["bucket", "blob"])
            yield _pack(ids, a, np.sort(order[new]), (a.name >> np.uint64(40)) % np.uint64(n_buckets))

    return run


_DECIDED = "id long, context long, tie boolean"


def _decide(table: pa.Table) -> pa.Table:
    """One bucket: the contexts that an earlier document has, and those that are tied. Negative buckets were decided where they were made."""
    n, c, d = _unpack(table.column("blob").to_pylist())
    if table.column("bucket")[0].as_py() < 0:
        return pa.table([pa.array(d), pa.array(c.view(np.int64)), pa.array(np.zeros(len(d), bool))], names=["id", "context", "tie"])
    order = np.lexsort((d, c, n))
    n, c, d = n[order], c[order], d[order]
    new_name = np.append(True, n[1:] != n[:-1])[: len(n)]
    new = new_name | np.append(True, c[1:] != c[:-1])[: len(n)]
    least = d[np.flatnonzero(new)][np.cumsum(new) - 1]
    covered = d > least
    # A name is tied if more than one context and more than one document have it.
    at = np.flatnonzero(new_name)
    tied = (np.add.reduceat(new.astype(np.int64), at) > 1) & (np.minimum.reduceat(d, at) < np.maximum.reduceat(d, at))
    tied = tied[np.cumsum(new_name) - 1] & new
    keep = np.flatnonzero(covered | tied)
    return pa.table([pa.array(d[keep]), pa.array(c[keep].view(np.int64)), pa.array(tied[keep] & ~covered[keep])], names=["id", "context", "tie"])


def _contexts(batches):
    """The asked-for contexts of texts, each once for a text."""
    for b in _opened(batches):
        ids, a, asked = _ids(b), Anchors(texts_of(b)), b.column(2).to_pylist()
        seen: set[tuple[int, int]] = set()
        wanted, rows = [set(x) for x in asked], []
        for r, key in enumerate(zip(a.doc.tolist(), a.context.view(np.int64).tolist(), strict=True)):
            if key[1] in wanted[key[0]] and key not in seen:
                seen.add(key)
                rows.append(r)
        rows, raw = np.array(rows, np.int64), a.raw.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(a.name[rows].view(np.int64)), pa.array(ids[a.doc[rows]]), pa.array(a.context[rows].view(np.int64)), pa.array((a.at[rows] - a.first[rows]).astype(np.int32)), pa.array((a.last[rows] - a.first[rows] + 1).astype(np.int32)), pa.array([raw[a.first[r] : a.last[r] + LENGTH] for r in rows.tolist()], pa.binary())], names=["name", "id", "context", "shift", "n", "s"])


_CONTEXT = "name long, id long, context long, shift int, n int, s binary"


def _dense(*keys: np.ndarray) -> np.ndarray:
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def resolve(names: np.ndarray, ids: np.ndarray, shift: np.ndarray, n: np.ndarray, strings: list[bytes]) -> np.ndarray:
    """For each context the windows (bits from the first) that a context with the same anchor in an earlier document has.

    The rank of what stands at a distance j left or right of the anchor is that for j - 1, refined by one byte."""
    m, reach = len(strings), LENGTH - K
    sizes = np.array([len(s) for s in strings], np.int64)
    base = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(strings), np.uint8)
    at = lambda p, ok: np.where(ok, raw[np.clip(base + p, 0, len(raw) - 1)], 256).astype(np.int64)
    left = [_dense(names)]
    right = [left[0]]
    for j in range(1, reach + 1):
        left.append(_dense(left[-1], at(shift - j, shift >= j)))
        p = shift + K + j - 1
        right.append(_dense(right[-1], at(p, p < sizes)))
    out = np.zeros(m, np.int64)
    for o in range(reach + 1):  # the anchor stands at offset o of the window
        w = shift - o
        rows = np.flatnonzero((w >= 0) & (w < n))
        if not len(rows):
            continue
        x, y, d = left[o][rows], right[reach - o][rows], ids[rows]
        order = np.lexsort((d, y, x))
        new = np.ones(len(order), bool)
        new[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
        least = d[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        hit = rows[order[d[order] > least]]
        out[hit] |= np.int64(1) << w[hit]
    return out


def _ties(batches):
    """Sorted by name: blocks of whole names, resolved one after the other."""
    held: list[pa.RecordBatch] = []

    def flush(t: pa.Table):
        c = {k: t.column(k).to_numpy() for k in ("name", "id", "context", "shift", "n")}
        bits = resolve(c["name"], c["id"], c["shift"].astype(np.int64), c["n"].astype(np.int64), t.column("s").to_pylist())
        k = np.flatnonzero(bits)
        return pa.RecordBatch.from_arrays([pa.array(c["id"][k]), pa.array(c["context"][k]), pa.array(bits[k])], names=["id", "context", "bits"])

    size = 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= BLOCK:
            t = pa.Table.from_batches(held)
            names = t.column("name").to_numpy()
            cut = int(np.searchsorted(names, names[-1]))
            if cut:
                yield flush(t.slice(0, cut))
            held, size = t.slice(cut).to_batches(), len(names) - cut
    if size:
        yield flush(pa.Table.from_batches(held))


def _windows(batches):
    """Every window of contexts by a 128-bit hash."""
    for b in batches:
        ids, contexts, hashes, offsets = [], [], [], []
        for i, c, n, s in zip(*(b.column(k).to_pylist() for k in ("id", "context", "n", "s")), strict=True):
            for w in range(n):
                ids.append(i), contexts.append(c), offsets.append(w), hashes.append(hashlib.blake2b(s[w : w + LENGTH], digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(ids, pa.int64()), pa.array(contexts, pa.int64()), pa.array(offsets, pa.int32())], names=["w", "id", "context", "o"])


_ALL = -1


def _cut(with_text: bool):
    """Takes out what is covered: a decision about a context holds wherever the text has it."""

    def run(batches):
        for b in _opened(batches):
            texts, full, part = texts_of(b), b.column(2).to_pylist(), b.column(3).to_pylist()
            rows = [i for i in range(b.num_rows) if full[i] or part[i]]
            gone: dict[int, np.ndarray] = {}
            if rows:
                a = Anchors([texts[i] for i in rows])
                step = np.zeros(len(a.raw) + 1, np.int32)
                bits = [dict.fromkeys(full[i] or (), _ALL) | {x["context"]: x["bits"] for x in part[i] or () if x["context"] not in (full[i] or ())} for i in rows]
                for d, c, f, e in zip(a.doc.tolist(), a.context.view(np.int64).tolist(), a.first.tolist(), a.last.tolist(), strict=True):
                    k = bits[d].get(c, 0)
                    if k == _ALL:
                        step[f] += 1
                        step[e + LENGTH] -= 1
                    elif k:
                        for w in range(e - f + 1):
                            if k >> w & 1:
                                step[f + w] += 1
                                step[f + w + LENGTH] -= 1
                covered = np.cumsum(step[:-1]) > 0
                gone = {i: covered[s : s + n] for i, s, n in zip(rows, a.starts.tolist(), a.sizes.tolist(), strict=True)}
            removed, spans, kept = [], [], []
            for i, t in enumerate(texts):
                g = gone.get(i)
                removed.append(0 if g is None else int(g.sum()))
                spans.append(0 if g is None else int((np.diff(np.append(0, g.astype(np.int8))) == 1).sum()))
                kept.append(t if g is None else np.frombuffer(t, np.uint8)[~g].tobytes())
            ids = [None if d == _LEAST else d for d in b.column(0).to_pylist()]
            cols = [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                cols.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes, if wanted)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    squeezed = texts.mapInArrow(_squeezed, "id long, z binary")
    entries = texts.mapInArrow(_sample(n_buckets), "bucket long, blob binary")
    decided = scratch.save(entries.groupBy("bucket").applyInArrow(_decide, _DECIDED), "decided")
    asked = decided.filter("tie").groupBy("id").agg(F.collect_set("context").alias("asked"))
    contexts = scratch.save(squeezed.join(asked, "id").mapInArrow(_contexts, _CONTEXT), "contexts")
    hot = scratch.save(contexts.groupBy("name").count().filter(F.col("count") > HOT).select("name"), "hot")
    n_hot = hot.count()
    named = F.broadcast(hot) if n_hot <= BROADCAST_NAMES else hot
    parts = contexts.join(named, "name", "left_anti").select("name", "id", "context", "shift", "n", "s").repartition("name").sortWithinPartitions("name").mapInArrow(_ties, "id long, context long, bits long")
    if n_hot:
        windows = scratch.save(contexts.join(named, "name", "left_semi").select("name", "id", "context", "shift", "n", "s").mapInArrow(_windows, "w binary, id long, context long, o int"), "windows")
        # written before it meets the windows, so that adaptive execution can split a window that very many documents have
        least = scratch.save(windows.groupBy("w").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").drop("most"), "least")
        found = windows.join(least, "w").filter(F.col("id") > F.col("least")).groupBy("id", "context").agg(F.bit_or(F.expr("shiftleft(1L, o)")).alias("bits"))
        parts = parts.unionByName(found)
    parts = scratch.save(parts, "parts")
    scratch.free("contexts", "windows", "least", "hot")
    full = decided.filter("not tie").select("id", "context", F.lit(None).cast("long").alias("bits"))
    by_doc = full.unionByName(parts).groupBy("id").agg(F.collect_set(F.when(F.col("bits").isNull(), F.col("context"))).alias("full"), F.collect_list(F.when(F.col("bits").isNotNull(), F.struct("context", "bits"))).alias("part"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return squeezed.join(by_doc, "id", "left").select("id", "z", "full", "part").mapInArrow(_cut(with_text), out)

