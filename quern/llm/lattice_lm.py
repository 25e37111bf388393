"""Language-model scores by subword lattices.

A word's lattice has every piece of an existing vocabulary that matches somewhere in it (a space mark and then the word, as bytes; single bytes fill gaps). The pieces' scores weight all paths, and the forward recursion in log space sums them: S(word) is the word's marginal probability over all segmentations. The file's scores start the weights; two rounds of expected counts over all distinct training words (forward and backward; each word once, since S is for words that are seldom or new) fit them to the corpus. The vocabulary itself isn't changed.

A token is a word or a document's end. With N training tokens, c(w) of them w:

    P(end) = c(end) / N
    P(w)   = a * c(w) / N + (1 - a) * (1 - P(end)) * S(w),     1 - a = singletons / words   (bounded to 1e-4 .. 1)

so known words have their own arc beside the pieces, and the mass of unseen words is what Good and Turing say. The sum over all texts is at most 1.

Counting: texts are split once. A task numbers the distinct words of a chunk of texts (about CHUNK bytes) and writes the chunk as its words, each with its training count, and its documents as numbers. A word so is a row for each chunk, not for each document: the rows are counted by word, the distinct words are scored, and the scores go back to their chunks, where the documents' numbers are looked up in an array. The most frequent word has one row for each chunk, so no key is hot.

How much comes from where: a known word's probability is mostly its count (with the fitted share `a`), an unseen word's is the lattice alone; README.md has measured shares.

Edge cases: null is empty: one token, the end. Repeated rows are repeated training text and are scored each; null ids are rows like others. Without training rows P(end) is 1/2 and S keeps the file's weights. Words of any length are scored whole. An empty table gives an empty result. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, space_words, sub_batches, texts_of

MARK = "▁"
#: Bytes of text whose words are numbered together.
CHUNK = 16 << 20
#: Words (and their bytes) that a worker scores at once.
BLOCK_WORDS, BLOCK_BYTES = 1 << 17, 4 << 20
#: Words over this length (bytes) are summed one by one, with the same result.
LONG = 160
#: Bytes of such a word whose arcs are held at once.
STEP = 4096
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BITS = np.uint64(46)


def _pow(base: int, n: int) -> np.ndarray:
    return np.array([pow(base, k, 1 << 64) for k in range(n)], np.uint64)


_UP, _DOWN = _pow(_BASE, STEP + LONG + 8), _pow(_INVERSE, STEP + LONG + 8)


def _mix(x):
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _log_sum(x: list[float]) -> float:
    top = max(x, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum([math.exp(y - top) for y in x]))


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes, and their first log weights: the file's scores rank the pieces, and the weights fall with the rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    score: dict[bytes, float] = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            continue
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            continue
        score[p.encode()] = float(sp.get_score(i))
    least = min(score.values(), default=0.0)
    for b in range(256):
        score.setdefault(bytes([b]), least)
    pieces = sorted(score, key=lambda p: (-score[p], p))
    w = 1.0 / (10.0 + np.arange(len(pieces)))
    return pieces, np.log(w / w.sum())


class Lattice:
    """Marginals over all segmentations, for many words at once."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.pieces, self.logp = pieces, np.asarray(logp)
        self.index = {p: k for k, p in enumerate(pieces)}
        self.longest = max(map(len, pieces))
        self.sizes = sorted({len(p) for p in pieces})
        sizes, h = np.array([len(p) for p in pieces]), np.zeros(len(pieces), np.uint64)
        for size in self.sizes:
            k = np.flatnonzero(sizes == size)
            m = np.frombuffer(b"".join(pieces[i] for i in k.tolist()), np.uint8).reshape(-1, size)
            h[k] = _mix((_BYTE[m] * _UP[:size]).sum(1, dtype=np.uint64))
        if len(np.unique(h)) != len(h):
            raise ValueError("two pieces with one hash")
        self.order = np.argsort(h).astype(np.int32)
        self.hash = h[self.order]
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(h >> _BITS).astype(np.int64)] = True

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose hash is a piece's, and the pieces. Most rows end at the small table."""
        rows = np.flatnonzero(self.maybe[(h >> _BITS).astype(np.int64)])
        g = h[rows]
        k = np.minimum(np.searchsorted(self.hash, g), len(self.hash) - 1)
        ok = self.hash[k] == g
        return rows[ok], self.order[k[ok]]

    def _arcs(self, m: np.ndarray):
        """For a matrix of words of one length: arcs (start, end, rows, pieces) by end, and the forward log sums [place, word]. No piece starts inside the mark."""
        n, size = m.shape
        total = np.zeros((size + 1, n), np.uint64)
        np.cumsum(np.ascontiguousarray(_BYTE[m].T) * _UP[:size, None], axis=0, out=total[1:])
        alpha, arcs = np.full((size + 1, n), -np.inf), []
        alpha[0] = 0.0
        for e in range(1, size + 1):
            for k in self.sizes:
                s = e - k
                if s < 0:
                    break
                if s in (1, 2) and e > 3:
                    continue
                rows, p = self._find(_mix((total[e] - total[s]) * _DOWN[s]))
                if len(rows):
                    arcs.append((s, e, rows, p))
                    alpha[e, rows] = np.logaddexp(alpha[e, rows], alpha[s, rows] + self.logp[p])
        return arcs, alpha

    def one(self, word: bytes) -> float:
        """The same for one word of any length."""
        w = MARK.encode() + word
        alpha, get, logp = [0.0], self.index.get, self.logp
        for e in range(1, len(w) + 1):
            t = [alpha[e - k] + logp[p] for k in self.sizes if k <= e and (p := get(w[e - k : e])) is not None]
            top = max(t)
            alpha.append(top + float(np.log(sum(np.exp(np.array(t) - top)))))
        return alpha[-1]

    def _by_size(self, words: list[bytes]):
        marked = [MARK.encode() + w for w in words]
        sizes = np.array([len(w) for w in marked])
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            for k in range(0, len(rows), 4096):
                yield size, rows[k : k + 4096], marked

    def log_marginals(self, words: list[bytes]) -> np.ndarray:
        out = np.empty(len(words))
        for size, rows, marked in self._by_size(words):
            if size > LONG:
                out[rows] = [self.one(words[r]) for r in rows.tolist()]
            else:
                out[rows] = self._arcs(np.frombuffer(b"".join(marked[r] for r in rows.tolist()), np.uint8).reshape(len(rows), size))[1][-1]
        return out

    def _forward(self, w: bytes, a: int, b: int, before: np.ndarray):
        """Of one marked word: arcs (starts, ends, pieces) that end in (a, b], by end, and the forward log sums of the places from `longest` before a (or 0) to b. before: those up to a."""
        low, found = max(0, a - self.longest), []
        total = np.zeros(b - low + 1, np.uint64)
        np.cumsum(_BYTE[np.frombuffer(w, np.uint8, b - low, low)] * _UP[: b - low], out=total[1:])
        for k in self.sizes:
            s = np.arange(max(0, a + 1 - k), b - k + 1)
            if len(s):
                rows, p = self._find(_mix((total[s + k - low] - total[s - low]) * _DOWN[s - low]))
                found.append((s[rows], s[rows] + k, p))
        s, e, p = (np.concatenate(x) for x in zip(*found, strict=True))
        k = np.flatnonzero(((s != 1) & (s != 2)) | (e <= 3))
        k = k[np.argsort(e[k], kind="stable")]
        s, e, p = s[k], e[k], p[k]
        alpha, starts, logs = before.tolist(), (s - low).tolist(), self.logp[p].tolist()
        cuts = np.searchsorted(e, np.arange(a + 1, b + 2)).tolist()
        for i, j in itertools.pairwise(cuts):
            alpha.append(_log_sum([alpha[starts[x]] + logs[x] for x in range(i, j)]))
        return (s, e, p), np.array(alpha)

    def _expect_long(self, w: bytes, count: float, into: np.ndarray) -> None:
        """Adds one marked word's expected counts. Forward sums are kept at the steps' starts only and are found again on the way back."""
        steps, befores, alpha = range(0, len(w), STEP), [], np.zeros(1)
        for a in steps:
            befores.append(alpha[-(self.longest + 1) :])
            alpha = self._forward(w, a, min(len(w), a + STEP), befores[-1])[1]
        all_, after = alpha[-1], {len(w): [0.0]}
        for a, before in zip(reversed(steps), reversed(befores), strict=True):
            b, low = min(len(w), a + STEP), max(0, a - self.longest)
            (s, e, p), alpha = self._forward(w, a, b, before)
            starts, logs, beta = s.tolist(), self.logp[p].tolist(), np.empty(b - a)
            cuts = np.searchsorted(e, np.arange(a + 1, b + 2)).tolist()
            for at in range(b, a, -1):
                x = beta[at - a - 1] = _log_sum(after.pop(at, []))
                for k in range(cuts[at - a - 1], cuts[at - a]):
                    after.setdefault(starts[k], []).append(x + logs[k])
            into += np.bincount(p, np.exp(alpha[s - low] + self.logp[p] + beta[e - a - 1] - all_) * count, len(into))

    def expect(self, words: list[bytes], counts: np.ndarray, into: np.ndarray) -> None:
        """Adds the pieces' expected counts."""
        for size, rows, marked in self._by_size(words):
            if size > LONG:
                for r in rows.tolist():
                    self._expect_long(marked[r], float(counts[r]), into)
                continue
            arcs, alpha = self._arcs(np.frombuffer(b"".join(marked[r] for r in rows.tolist()), np.uint8).reshape(len(rows), size))
            beta = np.full((size + 1, len(rows)), -np.inf)
            beta[-1] = 0.0
            c = counts[rows]
            for s, e, r, p in sorted(arcs, key=lambda x: -x[0]):
                x = self.logp[p] + beta[e, r]
                beta[s, r] = np.logaddexp(beta[s, r], x)
                into += np.bincount(p, np.exp(alpha[s, r] + x - alpha[-1, r]) * c[r], len(into))


_built: dict[bytes, Lattice] = {}


def _lattice(pieces: list[bytes], logp: np.ndarray) -> Lattice:
    """The worker's lattice; it is built anew only when the weights are others."""
    key = logp.tobytes()
    if key not in _built:
        _built.clear()
        _built[key] = Lattice(pieces, logp)
    return _built[key]


_CHUNK_ROWS = "chunk long, local int, w binary, c long, docs binary"


def _pack_docs(ids: list[int | None], numbers: list[np.ndarray]) -> bytes:
    n = len(ids)
    null = np.array([i is None for i in ids], np.uint8)
    return b"".join([n.to_bytes(8, "little"), np.array([i or 0 for i in ids], "<i8").tobytes(), null.tobytes(), np.array([len(x) for x in numbers], "<i8").tobytes(), *(x.tobytes() for x in numbers)])


def _unpack_docs(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, numbers of words, and the words' numbers."""
    n = int.from_bytes(data[:8], "little")
    ids, null = np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, np.uint8, n, 8 + 8 * n)
    return [None if x else i for i, x in zip(ids.tolist(), null.tolist(), strict=True)], np.frombuffer(data, "<i8", n, 8 + 9 * n), np.frombuffer(data, "<u4", -1, 8 + 17 * n)


def _chunks(chunk_bytes: int):
    """Per chunk a row for each distinct word (its number, its count in training rows) and one for all documents."""

    def run(batches):
        part, k = TaskContext.get().partitionId() << 32, 0
        local: defaultdict = defaultdict()
        local.default_factory = local.__len__
        ids, numbers, learnt, size = [], [], [], 0

        def flush():
            n = len(local)
            c = np.bincount(np.concatenate([np.zeros(0, np.uint32), *(x for x, learn in zip(numbers, learnt, strict=True) if learn)]), minlength=n)
            words = list(local)
            for s in range(0, n, 1 << 16):
                m = min(n, s + (1 << 16)) - s
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, part + k)), pa.array(np.arange(s, s + m, dtype=np.int32)), pa.array(words[s : s + m], pa.binary()), pa.array(c[s : s + m].astype(np.int64)), pa.nulls(m, pa.binary())], names=["chunk", "local", "w", "c", "docs"])
            yield pa.RecordBatch.from_arrays([pa.array([part + k]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([_pack_docs(ids, numbers)], pa.binary())], names=["chunk", "local", "w", "c", "docs"])

        for b in sub_batches(batches):
            for i, learn, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b), strict=True):
                ids.append(i), learnt.append(learn)
                numbers.append(np.array([local[w] for w in space_words(t)], "<u4"))
                size += len(t)
                if size >= chunk_bytes:
                    yield from flush()
                    local.clear(), ids.clear(), numbers.clear(), learnt.clear()
                    size, k = 0, k + 1
        if ids:
            yield from flush()

    return run


def _blocks(batches):
    """Tables of many rows with words in the first column, bounded by number and bytes."""
    held, rows, size = [], 0, 0
    for b in batches:
        held.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
        if rows >= BLOCK_WORDS or size >= BLOCK_BYTES:
            yield pa.Table.from_batches(held)
            held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _expected(shared):
    def run(batches):
        lattice = _lattice(*shared.value)
        into = np.zeros(len(lattice.pieces))
        for t in _blocks(batches):
            lattice.expect(t.column(0).to_pylist(), np.ones(t.num_rows), into)
        at = np.flatnonzero(into)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(into[at])], names=["piece", "x"])

    return run


def _scored(shared, n_all: int, end: float, own: float):
    def run(batches):
        lattice = _lattice(*shared.value)
        for t in _blocks(batches):
            c = t.column(1).to_numpy().astype(float)
            lp = token_log10(c, lattice.log_marginals(t.column(0).to_pylist()), n_all, end, own)
            yield from t.append_column("lp", pa.array(lp)).to_batches()

    return run


def token_log10(c: np.ndarray, log_s: np.ndarray, n_all: int, end: float, own: float) -> np.ndarray:
    with np.errstate(divide="ignore"):
        counted = np.log(own * c / n_all) if n_all else np.full(len(c), -np.inf)
        return np.logaddexp(counted, np.log((1 - own) * (1 - end)) + log_s) / np.log(10)


def _summed(ends: tuple[float, float, int]):
    """Per chunk: its documents' sums over their words."""

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        order = np.argsort(words.column("local").to_numpy())
        c, lp = (words.column(x).to_numpy()[order] for x in ("c", "lp"))
        out = []
        for data in docs.column("docs").to_pylist():
            ids, n, numbers = _unpack_docs(data)
            of = np.repeat(np.arange(len(n)), n)
            total = lambda x: np.bincount(of, x[numbers], len(n))
            out.append(pa.table([pa.array(ids, pa.int64()), pa.array(n + 1), pa.array(total((c > 0).astype(float)).astype(np.int64) + ends[2]), pa.array(total(np.log10(c + 1.0)) + ends[0]), pa.array(total(lp) + ends[1])], names=["doc_id", "n_tokens", "n_known", "logs", "score"]))
        return pa.concat_tables(out)

    return run


def score(docs: DataFrame, learn, model_file: str, rounds: int = 2, chunk_bytes: int = CHUNK) -> DataFrame:
    """Per document: doc_id, n_tokens, n_known, train_tokens, base_score, score. learn: a boolean column of docs, true for training rows."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lattice")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col("text").cast("string").alias("text"))
    chunks = scratch.save(rows.mapInArrow(_chunks(chunk_bytes), _CHUNK_ROWS), "chunks")
    words = chunks.filter("local is not null").select("chunk", "local", "w", "c")
    counts = scratch.save(words.groupBy("w").agg(F.sum("c").alias("c")), "counts")
    n_words, distinct, once = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), F.coalesce(F.sum(F.when(F.col("c") == 1, 1)), F.lit(0))).first()
    n_ends = rows.filter("learn").count()
    n_all, v = n_words + n_ends, distinct + (n_ends > 0)
    end, own = (n_ends / n_all if n_all else 0.5), (1 - min(1.0, max(1e-4, once / n_words)) if n_words else 0.0)
    pieces, logp = vocabulary(model_file)
    for _ in range(rounds if n_words else 0):
        got = counts.filter("c > 0").select("w").mapInArrow(_expected(spark.sparkContext.broadcast((pieces, logp))), "piece int, x double").groupBy("piece").agg(F.sum("x").alias("x")).collect()
        x = np.full(len(pieces), 0.01)
        for r in got:  # a row for each piece at most
            x[r["piece"]] += r["x"]
        logp = np.log(x / (x.sum() + n_ends))
    model = spark.sparkContext.broadcast((pieces, logp))
    scored = counts.mapInArrow(_scored(model, n_all, end, own), "w binary, c long, lp double")
    back = words.select("chunk", "local", "w").join(scored, "w").select("chunk", "local", "c", "lp")
    ends = (float(np.log10(n_ends + 1)), float(np.log10(end)) if n_ends or not n_all else float(np.log10(0.5)), int(n_ends > 0))
    held = chunks.filter("docs is not null").select(F.col("chunk").alias("of"), "docs")
    out = held.groupBy("of").cogroup(back.groupBy("chunk")).applyInArrow(_summed(ends), "doc_id long, n_tokens long, n_known long, logs double, score double")
    base = F.col("logs") - F.col("n_tokens") * float(np.log10(n_all + v + 1))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(int(n_all)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
