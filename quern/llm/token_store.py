"""Token ids in a compressed file format: static range asymmetric numeral systems.

One frequency table, counted over all documents, is shared by all blocks and stored beside them. A block holds whole documents, about `block_tokens` ids (a longer document is a block of its own), and can be decoded alone: its ids are dealt out to interleaved lanes, each with a 64-bit state and 32-bit words of output; checkpoints (all states and the place in the words) let a reader start in its middle; a CRC-32 guards the ids. Blocks are rows of a Parquet folder, so writing them is as safe against lost executors as any table, in any store that Spark writes to.

Layout of a store: `freqs` (token, freq; the sum is 2^SCALE), `blocks` (part, block, start_in_part, n_tokens, payload). Blocks are in ascending doc_id order by (part, block).

Edge cases: null texts are empty and have the end id alone; repeated rows are stored as often as they come, side by side; an empty table makes an empty store.
"""

from __future__ import annotations

import re
import struct
import sys
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, sub_batches, texts_of

SCALE = 20
LANES = 1024
BLOCK_TOKENS = 1 << 18
#: Steps of all lanes between checkpoints.
CHECKPOINT_STEPS = 128
_LOW = np.uint64(1 << 31)
#: Fixed value: the splits of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for Latin-1 texts without control characters from 1C to 1F, where Python's own engine is faster.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
_LATIN = re.compile(rf" ?[{_L}]+| ?[{_N}]+|\s+(?!\S)|'(?:s|t|re|ve|m|ll|d)| ?[^\s{_L}{_N}]+|\s+").findall
_OUTSIDE = re.compile("[^\x00-\x1b\x20-\xff]").search
_HEAD = struct.Struct("<4sIIIIIII")
_MAGIC = b"QRA1"


# --- tokens -----------------------------------------------------------------


def byte_letters() -> dict[int, str]:
    """The letters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, the others for code points from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Runs:
    """Ids of runs by their bytes: a hash table in arrays, so that all runs of many texts are looked up at once.

    A run's key is the run itself, in three numbers (up to SHORT bytes; its length, and whether a text begins with it, in the last one's top byte), so equal keys are equal runs. A value is (place in the pool of ids) << 32 | (number of ids), or ODD."""

    SHORT, SLOTS, MOST, ODD, NONE = 23, 1 << 20, 600_000, -1, -2

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.forget()
        self.pool, self.used = np.empty(1 << 20, np.uint16), 0

    def forget(self) -> None:
        """Empties the table; values that were given before stay good."""
        self.keys, self.values, self.filled = np.zeros((3, self.SLOTS), np.uint64), np.full(self.SLOTS, self.NONE), 0
        self.longer: dict[tuple, int] = {}

    def add(self, ids: list[int], sizes: list[int]) -> np.ndarray:
        """The values of new runs, whose ids stand one after the other."""
        n, k = len(ids), np.array(sizes, np.int64)
        if self.used + n > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(max(n, len(self.pool)), np.uint16)])
        self.pool[self.used : self.used + n] = ids
        out = (self.used + np.cumsum(k) - k) << 32 | k
        self.used += n
        return out

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        h = (keys[0] ^ (keys[1] * np.uint64(0x9E3779B97F4A7C15)) ^ (keys[2] * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0xD6E8FEB86659FD93)
        return ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(44)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values, NONE for keys that aren't in the table. Linear probing: every round looks up those that have met another key."""
        at = self.slot(keys)
        out = self.values[at]
        rows = np.flatnonzero((out != self.NONE) & (self.keys[:, at] != keys).any(0))
        while len(rows):
            at[rows] = (at[rows] + 1) % self.SLOTS
            out[rows] = self.values[at[rows]]
            rows = rows[(out[rows] != self.NONE) & (self.keys[:, at[rows]] != keys[:, rows]).any(0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Puts in distinct keys that aren't there."""
        at, rows = self.slot(keys), np.arange(keys.shape[1])
        while len(rows):
            free = rows[self.values[at[rows]] == self.NONE]
            self.values[at[free]] = free  # one of those that want a slot gets it
            got = free[self.values[at[free]] == free]
            self.keys[:, at[got]], self.values[at[got]] = keys[:, got], values[got]
            left = np.ones(len(at), bool)
            left[got] = False
            rows = rows[left[rows]]
            at[rows] = (at[rows] + 1) % self.SLOTS
        self.filled += keys.shape[1]


#: Kinds of bytes: letters, digits, other marks, white space; 0 for those that only the pattern can judge.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[[c for c in range(128) if not chr(c).isalnum() and not 9 <= c <= 13 and c not in b" '"]] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_TAIL = np.array([(1 << 8 * k) - 1 if k < 8 else (1 << 64) - 1 for k in range(9)], np.uint64)


class Encoder:
    """Ids of texts (UTF-8), as bytes of little-endian 16-bit numbers.

    The file's added tokens are cut out first, the longest at a place. Byte-level BPE then splits what is between them by its pattern and encodes each piece apart. No piece reaches over a space that stands before something else than white space, so whole runs between such spaces are remembered, and the pattern and the library's model run only on runs that are new. The memory is bounded: it is dropped when it is full. If an added token has rules of its own (whitespace beside it, whole words, normalised text), texts that hold one are left to the library."""

    def __init__(self, path: str, keep: int = 200_000):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        self._letters, self._model, self._runs = byte_letters(), t.model, _Runs()
        self._pieces, self._keep = {}, keep
        self._split = regex.compile(PATTERN).findall
        added = t.get_added_tokens_decoder()
        self._added = {x.content.encode(): array("H", [i]).tobytes() for i, x in added.items()}
        self._cut = re.compile(b"(" + b"|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + b")").split
        ruled = any(x.lstrip or x.rstrip or x.single_word or x.normalized for x in added.values())
        self._library = t if ruled else None
        if t.get_vocab_size() > 1 << 16 or sys.byteorder != "little":
            raise ValueError("ids must fit 16 bits, on a little-endian machine")

    def _piece(self, piece: str) -> list[int]:
        got = self._pieces.get(piece)
        if got is None:
            got = [x.id for x in self._model.tokenize(piece.encode().decode("latin-1").translate(self._letters))]
            if len(self._pieces) >= self._keep:
                self._pieces.clear()
            if len(piece) < 100:
                self._pieces[piece] = got
        return got

    def _by_pattern(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self._piece, (self._split if _OUTSIDE(text) else _LATIN)(text))))

    def one(self, text: bytes) -> bytes:
        """The ids of one text by the pattern; for texts with added tokens, or with white space beside a space."""
        if self._library is not None and any(x in text for x in self._added):
            return array("H", self._library.encode(text.decode(), add_special_tokens=False).ids).tobytes()
        return b"".join([self._added[x] if k % 2 else array("H", self._by_pattern(x.decode())).tobytes() for k, x in enumerate(self._cut(text))])

    def _new(self, units: list[bytes], lead: list[bool], plain: list[bool]) -> np.ndarray:
        """Encodes units (with a space before them where `lead` says so) and gives their values. Plain ones are pieces of one kind of byte."""
        got, letters, tokenize = [], self._letters, self._model.tokenize
        space = letters[32]
        for u, first, one in zip(units, lead, plain, strict=True):
            if one:
                x = u.decode("latin-1")
                if not x.isalnum() or not x.isascii():
                    x = x.translate(letters)
                got.append([t.id for t in tokenize(space + x if first else x)])
            else:
                x = u.decode()
                got.append(None if first and x[0].isspace() else self._by_pattern(" " + x if first else x))
        out = self._runs.add([x for y in got if y for x in y], [len(y or ()) for y in got])
        out[[k for k, y in enumerate(got) if y is None]] = _Runs.ODD
        return out

    def _values(self, raw: np.ndarray, joined: bytes, start: np.ndarray, size: np.ndarray, lead: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """Values of units, given by places in the bytes."""
        if self._runs.filled > _Runs.MOST:  # a slice has 2^18 units at most, so the table is never full
            self._runs.forget()
        runs, eight = self._runs, np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
        short = size <= _Runs.SHORT
        s, n = start[short], size[short]
        keys = np.empty((3, len(s)), np.uint64)
        keys[0] = eight[s] & _TAIL[np.minimum(n, 8)]
        keys[1:] = 0
        for k in (1, 2):
            rows = np.flatnonzero(n > 8 * k)
            keys[k, rows] = eight[s[rows] + 8 * k] & _TAIL[np.minimum(n[rows] - 8 * k, 8)]
        keys[2] |= (n | (lead[short].astype(np.int64) << 7)).astype(np.uint64) << np.uint64(56)
        found = runs.find(keys)
        new = np.flatnonzero(found == _Runs.NONE)
        if len(new):
            order = new[np.lexsort(keys[:, new])]
            change = np.ones(len(order), bool)
            change[1:] = (keys[:, order[1:]] != keys[:, order[:-1]]).any(0)
            once = order[change]
            got = self._new([joined[a:b] for a, b in zip(s[once].tolist(), (s + n)[once].tolist(), strict=True)], lead[short][once].tolist(), plain[short][once].tolist())
            runs.put(keys[:, once], got)
            found[order] = got[np.cumsum(change) - 1]
        out = np.empty(len(start), np.int64)
        out[short] = found
        rows = np.flatnonzero(~short)
        if len(rows):
            units = list(zip((joined[a:b] for a, b in zip(start[rows].tolist(), (start + size)[rows].tolist(), strict=True)), lead[rows].tolist(), plain[rows].tolist(), strict=True))
            fresh = list({u for u in units if u not in runs.longer})
            runs.longer.update(zip(fresh, self._new(*map(list, zip(*fresh, strict=True))).tolist() if fresh else (), strict=True))
            out[rows] = [runs.longer[u] for u in units]
            for u in fresh:
                if len(u[0]) >= 100:
                    del runs.longer[u]
        return out

    def batch(self, texts: list[bytes], end: bytes = b"") -> list[bytes]:
        """The ids of each text, and `end`."""
        runs = self._runs
        if runs.filled > _Runs.MOST // 3 * 2 or len(runs.longer) > self._keep or runs.used > 8 * _Runs.MOST:
            runs.clear()
        joined = b" " + b" ".join(texts) + b" "
        raw = np.frombuffer(joined + bytes(32), np.uint8)
        body = raw[: len(joined)]
        spaces = np.flatnonzero(body == 32)
        run, length = spaces[:-1] + 1, np.diff(spaces) - 1
        text_at = np.cumsum([1, *(len(t) + 1 for t in texts[:-1])])
        at = np.searchsorted(run, text_at)
        lead = np.ones(len(run), bool)
        lead[at] = False
        # Runs of known bytes, without white space beside white space, are cut where the kind of byte changes; others are left to the pattern.
        kind = _KIND[body]
        latin = np.flatnonzero(body[:-1] == 0xC3)
        ok = latin[(body[latin + 1] != 0x97) & (body[latin + 1] != 0xB7)]
        kind[ok] = kind[ok + 1] = 1
        hard = kind == 0
        hard[1:] |= (kind[1:] == 4) & (kind[:-1] == 4)
        blurred = np.zeros(len(run), bool)
        blurred[np.searchsorted(spaces, np.flatnonzero(hard)) - 1] = True
        cut = np.zeros(len(joined), bool)
        cut[1:] = kind[1:] != kind[:-1]
        if blurred.any():
            step = np.zeros(len(joined) + 1, np.int8)
            step[run[blurred]] += 1
            step[(run + length)[blurred]] -= 1
            cut &= np.cumsum(step[:-1], dtype=np.int8) == 0
        cut[spaces] = False
        cut[run[length > 0]] = True
        start = np.flatnonzero(cut)
        owner = np.searchsorted(spaces, start) - 1
        size = np.minimum(np.append(start[1:], len(joined)), (run + length)[owner]) - start
        begins = start == run[owner]
        odd_run = lead & ((length == 0) | ((kind[run] == 4) & ~blurred))
        value = np.concatenate([np.zeros(0, np.int64), *(self._values(raw, joined, start[k : k + (1 << 18)], size[k : k + (1 << 18)], (begins & lead[owner])[k : k + (1 << 18)], ~blurred[owner[k : k + (1 << 18)]]) for k in range(0, len(start), 1 << 18))])
        count = np.where(value < 0, 0, value & 0xFFFFFFFF)
        ends = np.append(0, np.cumsum(count))
        ids = runs.pool[np.repeat((value >> 32) - ends[:-1], count) + np.arange(ends[-1])].tobytes()
        cuts = np.append(ends[np.searchsorted(start, text_at)], ends[-1]).tolist()
        odd_run[owner[value < 0]] = True
        odd = np.logical_or.reduceat(odd_run, at).tolist()
        special = [any(x in t for x in self._added) for t in texts] if any(x in joined for x in self._added) else odd
        return [(self.one(t) if o or s else ids[2 * a : 2 * b]) + end for t, o, s, a, b in zip(texts, odd, special, cuts[:-1], cuts[1:], strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenize(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """doc_id and ids (16-bit little-endian numbers) of every whole text, with the end id."""
    end = array("H", [end_id]).tobytes()

    def run(batches):
        encode = encoder(vocabulary).batch
        for b in sub_batches(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(encode(texts_of(b), end), pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


# --- the coder --------------------------------------------------------------


def scale_counts(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2^scale, at least 1 for each symbol that occurs; largest remainders first, the smaller symbol at ties."""
    counts = np.asarray(counts, np.float64)
    total, room = counts.sum(), 1 << scale
    if not total:
        return np.zeros(len(counts), np.int64)
    used = counts > 0
    exact = counts * ((room - used.sum()) / total)
    f = np.where(used, 1 + np.floor(exact), 0).astype(np.int64)
    left = room - int(f.sum())
    order = np.lexsort([np.arange(len(counts)), -(exact - np.floor(exact)), ~used])
    f[order[:left]] += 1
    return f


class Coder:
    def __init__(self, freqs: np.ndarray, scale: int = SCALE):
        self.scale = np.uint64(scale)
        self.f = freqs.astype(np.uint64)
        self.c = (np.cumsum(freqs) - freqs).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freqs), dtype=np.uint16), freqs)

    def encode(self, ids: np.ndarray, lanes: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """The words in reading order, and (words before it, states) of each checkpoint; the first is the start."""
        steps = -(-len(ids) // lanes)
        f, c, x = self.f[ids], self.c[ids], np.full(lanes, _LOW)
        limit = f << (np.uint64(63) - self.scale)
        out: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        n_out = 0
        for s in range(steps - 1, -1, -1):
            a, b = s * lanes, min(len(ids), (s + 1) * lanes)
            y, fs = x[: b - a], f[a:b]
            over = y >= limit[a:b]
            if over.any():
                w = y[over]
                out.append(w.astype(np.uint32))
                n_out += len(w)
                y = np.where(over, y >> np.uint64(32), y)
            q = y // fs
            x[: b - a] = (q << self.scale) + (y - q * fs) + c[a:b]
            if s % CHECKPOINT_STEPS == 0:
                marks.append((n_out, x.copy()))
        words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
        return words, [(n_out - k, x) for k, x in reversed(marks)]

    def decode(self, words: np.ndarray, at: int, states: np.ndarray, n: int) -> np.ndarray:
        """n ids from a checkpoint on."""
        lanes, x, mask = len(states), states.copy(), np.uint64((1 << int(self.scale)) - 1)
        out = np.empty(n, np.uint16)
        wide = words.astype(np.uint64)
        for a in range(0, n, lanes):
            b = min(n, a + lanes)
            y = x[: b - a]
            slot = y & mask
            s = self.symbol[slot]
            out[a:b] = s
            y = self.f[s] * (y >> self.scale) + slot - self.c[s]
            low = np.flatnonzero(y < _LOW)
            if at + len(low) > len(wide):
                raise ValueError("a block ends too soon; its checksum can't match")
            y[low] = (y[low] << np.uint64(32)) | wide[at : at + len(low)]
            at += len(low)
            x[: b - a] = y
        return out

    def pack(self, docs: list[tuple[int | None, bytes]]) -> bytes:
        """A block: its head, documents, checkpoints and words."""
        raw = b"".join(x for _, x in docs)
        ids = np.frombuffer(raw, np.uint16)
        lanes = max(1, min(LANES, 1 << max(0, (len(ids) // 32).bit_length() - 1)))
        words, marks = self.encode(ids, lanes)
        index = zlib.compress(np.array([[-(1 << 63) if d is None else d, len(x) // 2] for d, x in docs], np.int64).tobytes())
        states = b"".join(struct.pack("<I", k) + x.astype("<u8").tobytes() for k, x in marks)
        return _HEAD.pack(_MAGIC, len(docs), len(ids), lanes, len(marks), len(index), len(words), zlib.crc32(raw)) + index + states + words.astype("<u4").tobytes()

    def unpack(self, payload: bytes, segment: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(doc_id, number of ids) rows, and the ids; or the ids of one segment, from its checkpoint to the next."""
        magic, n_docs, n, lanes, n_marks, n_index, n_words, crc = _HEAD.unpack_from(payload)
        if magic != _MAGIC:
            raise ValueError("not a block")
        at = _HEAD.size
        index = np.frombuffer(zlib.decompress(payload[at : at + n_index]), np.int64).reshape(n_docs, 2)
        at += n_index
        marks = [(struct.unpack_from("<I", payload, at + k * (4 + 8 * lanes))[0], np.frombuffer(payload, "<u8", lanes, at + k * (4 + 8 * lanes) + 4).astype(np.uint64)) for k in range(n_marks)]
        words = np.frombuffer(payload, "<u4", n_words, at + n_marks * (4 + 8 * lanes))
        if segment is not None:
            a = segment * CHECKPOINT_STEPS * lanes
            return index, self.decode(words, *marks[segment], min(n - a, CHECKPOINT_STEPS * lanes))
        ids = self.decode(words, *marks[0], n) if n else np.zeros(0, np.uint16)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError("a block's checksum doesn't match its ids")
        return index, ids


# --- the store --------------------------------------------------------------


def _counts(batches):
    total = np.zeros(1 << 16, np.int64)
    for b in batches:
        column = b.column(0)
        for k in range(0, b.num_rows, 1024):
            total += np.bincount(np.frombuffer(b"".join(column.slice(k, 1024).to_pylist()), np.uint16), minlength=1 << 16)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["token", "n"])


def write(tokens: DataFrame, path: str) -> None:
    """Writes (doc_id, ids), a table that was written before, as a store in `path`. One shuffle, of the ids, by ranges of doc_id."""
    spark = tokens.sparkSession
    found = tokens.select("ids").mapInArrow(_counts, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 << 16, np.int64)  # a row for each id of the vocabulary at most
    for r in found:
        counts[r["token"]] = r["n"]
    freqs = scale_counts(counts)
    spark.createDataFrame([(int(t), int(freqs[t])) for t in np.flatnonzero(freqs)], "token int, freq int").coalesce(1).write.mode("overwrite").parquet(f"{path}/freqs")
    shared = spark.sparkContext.broadcast(freqs)

    def run(batches):
        coder, part = Coder(shared.value), TaskContext.get().partitionId()
        docs, held, block, start = [], 0, 0, 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([held], pa.int64()), pa.array([coder.pack(docs)], pa.binary())], names=["part", "block", "start_in_part", "n_tokens", "payload"])

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if docs and held + len(x) // 2 > BLOCK_TOKENS:
                    yield flush()
                    docs, block, start, held = [], block + 1, start + held, 0
                docs.append((d, x))
                held += len(x) // 2
        if docs:
            yield flush()

    ordered = tokens.select("doc_id", "ids").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    ordered.mapInArrow(run, "part int, block int, start_in_part long, n_tokens long, payload binary").write.option("compression", "none").mode("overwrite").parquet(f"{path}/blocks")


def load_coder(spark: SparkSession, path: str) -> Coder:
    freqs = np.zeros(1 << 16, np.int64)
    for r in spark.read.parquet(f"{path}/freqs").collect():
        freqs[r["token"]] = r["freq"]
    return Coder(freqs)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decodes all blocks in parallel: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and the ids if wanted."""
    blocks = spark.read.schema("part int, block int, start_in_part long, n_tokens long, payload binary").parquet(f"{path}/blocks")
    base, rows = 0, []
    for r in sorted(blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):  # a row for each part that was written
        rows.append((r["part"], base))
        base += r["n"]
    shared = spark.sparkContext.broadcast((load_coder(spark, path).f.astype(np.int64), dict(rows)))

    def run(batches):
        freqs, bases = shared.value
        coder = Coder(freqs)
        for batch in batches:
            for part, first, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                index, ids = coder.unpack(payload)
                ends = np.cumsum(index[:, 1])
                starts = ends - index[:, 1]
                wide = [ids[a:b].astype("<u4").tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array([None if d == -(1 << 63) else d for d in index[:, 0].tolist()], pa.int64()), pa.array(starts + bases[part] + first), pa.array(index[:, 1]), pa.array([zlib.crc32(x) for x in wide], pa.int64())]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in wide], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return blocks.select("part", "start_in_part", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def store(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2) -> None:
    """Tokenises the documents (once: the ids are written down between the count and the coding) and writes the store."""
    scratch = Scratch(docs.sparkSession, "tokens")
    write(scratch.save(tokenize(docs, vocabulary, end_id), "ids"), path)
    scratch.free("ids")
