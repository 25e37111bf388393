"""Alignment of two tokenizers' ids: which tokens of a byte-level vocabulary (A) and of a piece vocabulary (B) stand for the same bytes of a text.

1. Each text, with a space before it, is encoded by both. Ends of tokens are running sums of their sizes in bytes; ends that both have (`intersect1d`) cut the text into groups, `searchsorted` gives every token its group, and every A token its first and last B token; `repeat` writes out all pairs of tokens whose bytes overlap (links). All of it runs on the arrays of many texts at once. Per document, the distinct id pairs and how often each is linked are written down.
2. How many documents hold a pair linked is counted over the corpus: summed up in each task, then in two shuffles, by pair and salt and by pair, so that a pair that nearly every document has is spread over tasks. A pair is best if no other pair of its A id is in more documents.
3. The pairs in most documents, LIMIT at most, are broadcast (which these are is found by counting, and only moves work); a document's sums over them are looked up where its pairs lie. Pairs beyond, being those in few documents, are joined by a shuffle.

Neither tokenizer's tokens reach over a space that follows something else, so runs between spaces are encoded once and remembered (the memory is bounded), and very long texts are cut at such places and handled piece by piece. A text without such places is one piece.

Edge cases: a text that is null or empty, or that a tokenizer doesn't give back byte for byte (B writes U+2581 for a space), has no tokens: zeros and ''. Special tokens' strings in a text are plain text. Repeated rows, and rows with one id or null ids, are documents of their own and counted as such. Ties for the best pair are all best. An empty table gives an empty result. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sub_batches, texts_of
from .token_store import Encoder, byte_letters

#: Bytes of text in one piece of a long text.
PIECE = 1 << 20
#: Pairs that may be broadcast (13 bytes each); beyond, the join is by shuffle.
LIMIT = 1_500_000
#: Parts of a pair's sum.
SALTS = 16
#: Pairs that a task sums up at once.
AT_ONCE = 4_000_000
KEEP = 300_000
_SPACE = "▁"
_CUT = re.compile(rb"[0-9A-Za-z](?= )")
_UNITS = re.compile(rb" +[^ ]*")
ROWS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
OUT = "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"


class Plain(Encoder):
    """The encoder of a byte-level vocabulary for which special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self._added, self._library = {}, None

    def one(self, text: bytes) -> bytes:
        return array("H", self._by_pattern(text.decode())).tobytes()


def byte_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    from tokenizers import Tokenizer

    back = {c: b for b, c in byte_letters().items()}
    vocab = Tokenizer.from_file(path).get_vocab()
    out = [b""] * (max(vocab.values()) + 1)
    for t, i in vocab.items():
        out[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
    return out


class Pieces:
    """Ids by a piece vocabulary, unit by unit: spaces and what follows up to the next space."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self._model, self._known = SentencePieceProcessor(model_file=path), {}
        n, piece = self._model.get_piece_size(), self._model.id_to_piece
        if n > 1 << 16 or any(_SPACE in piece(i).lstrip(_SPACE) for i in range(n)):
            raise ValueError("ids must fit 16 bits, and no piece may have a space after something else")
        self.tokens = [bytes([int(piece(i)[3:5], 16)]) if self._model.is_byte(i) else piece(i).replace(_SPACE, " ").encode() for i in range(n)]
        self._space = array("H", [self._model.piece_to_id(_SPACE)]).tobytes()

    def batch(self, texts: list[bytes]) -> list[bytes]:
        """The ids of texts that begin with the space that the vocabulary's library adds itself, as 16-bit numbers."""
        if len(self._known) > KEEP:
            self._known = {}
        units = [t[1:].split(b" ") if b"  " not in t else [u[1:] for u in _UNITS.findall(t)] for t in texts]
        known = self._known
        new = list({u for us in units for u in us if u not in known})
        for u, ids in zip(new, self._model.encode([u.decode(errors="replace") for u in new], num_threads=1), strict=True):
            known[u] = array("H", ids).tobytes() if u else self._space
        out = [b"".join([known[u] for u in us]) for us in units]
        for u in new:
            if len(u) > 100:
                del known[u]
        return out


class Aligned:
    """The arrays of texts that were aligned together. Texts begin with a space; `sound` says which of them both tokenizers give back."""

    def __init__(self, texts: list[bytes], a: list[bytes], b: list[bytes], tokens_a: list[bytes], tokens_b: list[bytes], sizes_a: np.ndarray, sizes_b: np.ndarray):
        self.sound = np.ones(len(texts), bool)
        raw_a, raw_b = (b"".join(x) for x in (a, b))
        whole = b"".join(texts)
        if not all(self._same(texts, whole, x, raw, t, s) for x, raw, t, s in ((a, raw_a, tokens_a, sizes_a), (b, raw_b, tokens_b, sizes_b))):
            for k, t in enumerate(texts):
                self.sound[k] = all(b"".join([tokens[i] for i in np.frombuffer(x[k], np.uint16).tolist()]) == t for x, tokens in ((a, tokens_a), (b, tokens_b)))
            keep = np.flatnonzero(self.sound).tolist()
            texts, raw_a, raw_b = [texts[k] for k in keep], b"".join(a[k] for k in keep), b"".join(b[k] for k in keep)
        self.a, self.b = (np.frombuffer(x, np.uint16).astype(np.int64) for x in (raw_a, raw_b))
        size_a = sizes_a[self.a]
        ends_a, ends_b = np.cumsum(size_a), np.cumsum(sizes_b[self.b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        self.last_a, self.last_b = cuts[self.group_a] == ends_a, cuts[self.group_b] == ends_b
        first, last = np.searchsorted(ends_b, ends_a - size_a, "right"), np.searchsorted(ends_b, ends_a)
        n = last - first + 1
        at = np.repeat(np.arange(len(self.a)), n)
        self.codes = self.a[at] << 16 | self.b[np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
        # How many of each lie in the texts up to each one's end.
        text_ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
        self.up_to_a, self.up_to_b, self.up_to_group = (np.searchsorted(x, text_ends, "right") for x in (ends_a, ends_b, cuts))
        self.up_to_link = np.append(0, np.cumsum(n))[self.up_to_a]

    @staticmethod
    def _same(texts, whole, ids, raw, tokens, sizes) -> bool:
        n = np.frombuffer(raw, np.uint16)
        ends = np.append(0, np.cumsum(sizes[n]))[np.cumsum([len(x) // 2 for x in ids])] if ids else np.zeros(0, np.int64)
        return np.array_equal(ends, np.cumsum([len(t) for t in texts])) and b"".join([tokens[i] for i in n.tolist()]) == whole

    def written(self) -> np.ndarray:
        """Per token in the order in which groups are written (a1,a2|b1;): its id, with a vocabulary and a mark after it as higher bits."""
        in_a, in_b = np.bincount(self.group_a), np.bincount(self.group_b)
        out = np.empty(len(self.a) + len(self.b), np.int64)
        if len(out):
            out[np.arange(len(self.a)) + (np.cumsum(in_b) - in_b)[self.group_a]] = self.a + (self.last_a.astype(np.int64) << 16)
            out[np.arange(len(self.b)) + np.cumsum(in_a)[self.group_b]] = self.b + ((self.last_b + np.int64(2)) << 16)
        return out


class Aligner:
    def __init__(self, vocabulary: str, model: str):
        self._a, self._b = Plain(vocabulary), Pieces(model)
        self._tokens_a, self._tokens_b = byte_tokens(vocabulary), self._b.tokens
        self._sizes_a, self._sizes_b = (np.array([len(t) for t in x], np.int64) for x in (self._tokens_a, self._tokens_b))
        n = max(len(self._tokens_a), len(self._tokens_b))
        self._numbers = [b"%d%s" % (i, mark) if i < n else b"" for mark in (b",", b"|", b",", b";") for i in range(1 << 16)]

    def align(self, texts: list[bytes]) -> Aligned:
        return Aligned(texts, self._a.batch(texts), self._b.batch(texts), self._tokens_a, self._tokens_b, self._sizes_a, self._sizes_b)

    def pieces(self, text: bytes) -> list[bytes]:
        """The text with a space before it, cut where no token can reach over."""
        text, out, at = b" " + text, [], 0
        while len(text) - at > PIECE and (m := _CUT.search(text, at + PIECE)):
            out.append(text[at : m.end()])
            at = m.end()
        return [*out, text[at:]]

    def documents(self, texts: list[bytes]):
        """For each text: (n_a, n_b, n_groups, n_links, digest of the groups, distinct pairs, how often each is linked). Texts that are large together come piece by piece."""
        found: list[list] = [[np.zeros(4, np.int64), hashlib.sha256(), [], b"", len(t) > 0] for t in texts]
        queue = [(k, p) for k, t in enumerate(texts) if t for p in self.pieces(t)]
        at = 0
        while at < len(queue):
            stop, held = at, 0
            while stop < len(queue) and (stop == at or held + len(queue[stop][1]) <= 2 * PIECE):
                held += len(queue[stop][1])
                stop += 1
            self._add(queue[at:stop], found)
            at = stop
        none, empty = np.zeros(4, np.int64), np.zeros(0, np.int64)
        for n, digest, pairs, open_, sound in found:
            if not sound:
                yield none, "", empty, empty
                continue
            digest.update(open_[:-1])
            if len(pairs) == 1:
                yield n, digest.hexdigest(), *pairs[0]
            else:
                codes, back = np.unique(np.concatenate([c for c, _ in pairs]), return_inverse=True)
                yield n, digest.hexdigest(), codes, np.bincount(back, np.concatenate([t for _, t in pairs])).astype(np.int64)

    def _add(self, pieces: list[tuple[int, bytes]], found: list[list]) -> None:
        got = self.align([p for _, p in pieces])
        for (k, _), sound in zip(pieces, got.sound.tolist(), strict=True):
            found[k][4] &= sound
        owners = [k for (k, _), sound in zip(pieces, got.sound.tolist(), strict=True) if sound]
        ups = np.stack([got.up_to_a, got.up_to_b, got.up_to_group, got.up_to_link], 1)
        counts = np.diff(ups, axis=0, prepend=np.zeros((1, 4), np.int64))
        marks, numbers = got.written().tolist(), self._numbers
        owner = np.repeat(np.arange(len(owners)), counts[:, 3])
        codes, times = np.unique(owner << 32 | got.codes, return_counts=True)
        bounds = np.searchsorted(codes >> 32, np.arange(len(owners) + 1)).tolist()
        codes &= 0xFFFFFFFF
        at = 0
        for j, k in enumerate(owners):
            doc, to = found[k], at + int(counts[j, 0] + counts[j, 1])
            doc[1].update(doc[3])  # the last piece's closing mark isn't a part of the digest
            doc[0] += counts[j]
            doc[2].append((codes[bounds[j] : bounds[j + 1]], times[bounds[j] : bounds[j + 1]]))
            doc[3] = b"".join([numbers[i] for i in marks[at:to]])
            at = to


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(vocabulary: str, model: str) -> Aligner:
    if (vocabulary, model) not in _aligners:
        _aligners.clear()
        _aligners[vocabulary, model] = Aligner(vocabulary, model)
    return _aligners[vocabulary, model]


def _documents(vocabulary: str, model: str):
    def run(batches):
        own, row = aligner(vocabulary, model), TaskContext.get().partitionId() << 40
        for b in sub_batches(batches):
            rows = list(own.documents(texts_of(b)))
            n = np.array([r[0] for r in rows], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(rows))), b.column(0), *(pa.array(n[:, k]) for k in range(4)), pa.array([r[1] for r in rows]), *(pa.array([r[k].astype("<u4").tobytes() for r in rows], pa.binary()) for k in (2, 3))],
                names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )
            row += len(rows)

    return run


def _summed(batches):
    """pairs -> (code, salt, n): how many of the task's documents hold each pair."""
    salt = TaskContext.get().partitionId() % SALTS
    held, n = [], 0

    def flush():
        codes, times = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(np.full(len(codes), salt, np.int32)), pa.array(times.astype(np.int64))], names=["code", "salt", "n"])

    for b in batches:
        for x in b.column(0):
            held.append(np.frombuffer(x.as_buffer(), "<u4"))
            n += len(held[-1])
            if n > AT_ONCE:
                yield flush()
                held, n = [], 0
    if held:
        yield flush()


def _count(found: DataFrame, scratch: Scratch) -> DataFrame:
    """The written documents -> (code, n, best) of every pair, written."""
    sums = found.select("pairs").mapInArrow(_summed, "code long, salt int, n long")
    counts = scratch.save(sums.groupBy("code", "salt").agg(F.sum("n").alias("n")).groupBy("code").agg(F.sum("n").alias("n")), "counts")
    a = F.shiftrightunsigned("code", 16)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # a row for each id of A, 65,536 at most
    best = counts.withColumn("a", a).join(F.broadcast(most), "a").select("code", "n", (F.col("n") == F.col("most")).alias("best"))
    return scratch.save(best, "best")


def _looked_up(shared):
    """Documents' sums over the broadcast pairs."""

    def run(batches):
        codes, n, best = shared.value
        for b in batches:
            pairs, times = (_flat(b.column(b.schema.get_field_index(c))) for c in ("pairs", "times"))
            at, hit = _find(codes, pairs)
            weight = np.where(hit, times, 0)
            bounds = np.append(0, np.cumsum([len(x.as_buffer()) // 4 for x in b.column(b.schema.get_field_index("pairs"))]))
            total = lambda v: pa.array(np.diff(np.append(0, np.cumsum(v))[bounds]))  # noqa: E731, B023
            sums = [total(weight * (best[at] if len(codes) else 0)), total(weight * (n[at] if len(codes) else 0))]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in ("row", *OUT[:5])), *sums, b.column(b.schema.get_field_index("groups_sha256"))], names=["row", *OUT])

    return run


def _left(shared):
    """(row, code, times) of the pairs that aren't broadcast."""

    def run(batches):
        codes = shared.value[0]
        for b in batches:
            pairs, times = _flat(b.column(1)), _flat(b.column(2))
            _, hit = _find(codes, pairs)
            rows = np.repeat(b.column(0).to_numpy(), [len(x.as_buffer()) // 4 for x in b.column(1)])
            yield pa.RecordBatch.from_arrays([pa.array(rows[~hit]), pa.array(pairs[~hit]), pa.array(times[~hit])], names=["row", "code", "times"])

    return run


def _flat(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").astype(np.int64)


def _find(codes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted codes among the sorted ones, and whether they are there."""
    at = np.minimum(np.searchsorted(codes, wanted), max(0, len(codes) - 1))
    return at, codes[at] == wanted if len(codes) else np.zeros(len(wanted), bool)


def _aligned(docs: DataFrame, vocabulary: str, model: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = scratch.save(texts.mapInArrow(_documents(vocabulary, model), ROWS), "documents")
    return found, _count(found, scratch)


def pair_counts(docs: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """A map between the vocabularies: a row for each linked pair of ids: a, b, n (documents that hold it linked), best (no other pair of a is in more)."""
    _, counts = _aligned(docs, vocabulary, model, Scratch(docs.sparkSession, "alignment"))
    return counts.select(F.shiftrightunsigned("code", 16).cast("int").alias("a"), F.col("code").bitwiseAND(0xFFFF).cast("int").alias("b"), "n", "best")


def align(docs: DataFrame, vocabulary: str, model: str, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    scratch = Scratch(docs.sparkSession, "alignment")
    found, counts = _aligned(docs, vocabulary, model, scratch)
    total, least = counts.count(), 0
    while counts.filter(F.col("n") > least).count() > limit:
        least = max(1, 2 * least)
    often = counts.filter(F.col("n") > least).toPandas().sort_values("code")
    shared = docs.sparkSession.sparkContext.broadcast((often["code"].to_numpy(np.int64), often["n"].to_numpy(np.int64), often["best"].to_numpy(bool)))
    out = found.mapInArrow(_looked_up(shared), "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    if len(often) < total:
        rare = scratch.save(found.select("row", "pairs", "times").mapInArrow(_left(shared), "row long, code long, times long"), "rare")
        more = rare.join(counts.filter(F.col("n") <= least), "code").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
        out = out.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return out.select(*OUT)
