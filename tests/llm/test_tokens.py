"""Alignment of two tokenizers, and packing, against brute-force versions."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from quern.llm import alignment, packing, queries

from .conftest import SF

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a", "b", "Z", " ", "  ", "\n", "\t", "é", "▁", " ", "中", "文", "1", "23", "'s", "<|endoftext|>", "</s>", "<0x41>", "!", ".", " ", " the ", "\x00", "​", "😀", "ﬁ", "́"]


@pytest.fixture(scope="module")
def libraries():
    plain, special = Tokenizer.from_file(A), Tokenizer.from_file(A)
    plain.encode_special_tokens = True
    return plain, special, SentencePieceProcessor(model_file=B), alignment.byte_tokens(A), alignment.Pieces(B).tokens


def one(text, libraries):
    """(n_a, n_b, n_groups, n_links, digest, {(a, b): times}) by plain loops."""
    plain, _, pieces, bytes_a, bytes_b = libraries
    none = (0, 0, 0, 0, "", {})
    if not text:
        return none
    whole, a, b = (" " + text).encode(), plain.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
    if b"".join(bytes_a[i] for i in a) != whole or b"".join(bytes_b[i] for i in b) != whole:
        return none
    spans = []
    for ids, tokens in ((a, bytes_a), (b, bytes_b)):
        ends = list(itertools.accumulate(len(tokens[i]) for i in ids))
        spans.append(list(zip([0, *ends], ends, ids)))  # noqa: B905
    cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    groups = ["|".join(",".join(str(i) for s, _, i in side if low <= s < high) for side in spans) for low, high in zip([0, *cuts], cuts)]  # noqa: B905
    links = Counter((i, j) for s, e, i in spans[0] for u, v, j in spans[1] if s < v and u < e)
    return len(a), len(b), len(cuts), sum(links.values()), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def brute_alignment(texts, libraries):
    rows = [one(t, libraries) for t in texts]
    counts, most = Counter(p for r in rows for p in r[5]), defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return [(*r[:4], sum(t for p, t in r[5].items() if counts[p] == most[p[0]]), sum(t * counts[p] for p, t in r[5].items()), r[4]) for r in rows]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_alignment_of_odd_texts(libraries, monkeypatch):
    texts = odd_texts(1500)
    for size in (1 << 20, 5):
        monkeypatch.setattr(alignment, "PIECE", size)
        for t, (n, digest, codes, times) in zip(texts, alignment.Aligner(A, B).documents([t.encode() for t in texts]), strict=True):
            assert (*n.tolist(), digest, {(int(c) >> 16, int(c) & 0xFFFF): int(k) for c, k in zip(codes, times, strict=True)}) == one(t, libraries), repr(t)


@pytest.mark.parametrize("limit", [alignment.LIMIT, 40, 0])
def test_alignment_is_brute_force(spark, libraries, limit):
    texts = odd_texts(200, 3) + ["the cat sat on the mat, and the cat sat.", "the cat sat on the mat, and the cat sat.", "Ein Satz über Äpfel.", None, "", "x" * 5000, "1 2 3 " * 300]
    rows = [(k, t) for k, t in enumerate(texts)]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), A, B, limit).collect()
    assert sorted(map(tuple, got)) == [(k, *w) for k, w in enumerate(brute_alignment(texts, libraries))]


def test_alignment_query(spark, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in docs if len(r["text"] or "") < 4000]
    got = {r["doc_id"]: r for r in queries.queries()["op12_alignment"](spark, SF).collect()}
    assert len(got) == len(docs)
    for r in short:
        n_a, n_b, n_groups, n_links, digest, _ = one(r["text"], libraries)
        w = got[r["doc_id"]]
        assert (w["n_a"], w["n_b"], w["n_groups"], w["n_links"], w["groups_sha256"]) == (n_a, n_b, n_groups, n_links, digest)
    sub = spark.createDataFrame([tuple(r) for r in short[:60]], "doc_id long, text string")
    want = brute_alignment([r["text"] for r in short[:60]], libraries)
    assert sorted(map(tuple, alignment.align(sub, A, B).collect())) == sorted((r["doc_id"], *w) for r, w in zip(short[:60], want, strict=True))


def test_alignment_odd_rows(spark, odd, odd_rows, nothing, libraries):
    want = sorted(((r[1] is not None, r[1] or 0, *w) for r, w in zip(odd_rows, brute_alignment([r[2] if len(r[2] or "") < 20_000 else None for r in odd_rows], libraries), strict=True) if len(r[2] or "") < 20_000))
    short = odd.filter("length(text) < 20000 or text is null").withColumnsRenamed({"rep": "row", "part": "pairs", "h": "code"})
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, *tuple(r)[1:]) for r in alignment.align(short, A, B).collect()) == want
    all_ = alignment.align(odd, A, B)
    assert all_.count() == len(odd_rows) and all_.filter("n_a > 0 and (n_groups = 0 or n_links < n_a or n_best > n_links or count_sum < n_links)").count() == 0
    assert alignment.align(nothing, A, B).count() == 0


def test_pair_counts(spark, libraries):
    texts = ["the cat", "the cat", "the dog the dog", None]
    got = {(r["a"], r["b"]): (r["n"], r["best"]) for r in alignment.pair_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), A, B).collect()}
    counts = Counter(p for t in texts for p in one(t, libraries)[5])
    most = {a: max(n for (x, _), n in counts.items() if x == a) for a, _ in counts}
    assert got == {p: (n, n == most[p[0]]) for p, n in counts.items()}


# --- packing ----------------------------------------------------------------


def test_hilbert_curve_visits_every_cell_by_neighbours():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        keys = packing.hilbert_key(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0))
        assert (steps.sum(1) == 1).all()


def ids_of(text, libraries):
    return [*libraries[1].encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def fits(rows, docs, libraries, size=2048):
    """docs: a list of (doc_id, text). Every id lies in one piece, sequences are gapless, and only powers of two are short."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    want = {d: ids_of(t, libraries) for d, t in docs}
    assert by_doc.keys() == want.keys()
    for d, ids in want.items():
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0 and r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == size or at < size and at & (at - 1) == 0


def test_packing_query(spark, real, libraries):
    fits(queries.queries()["op13_packing"](spark, SF).collect(), list(real.items()), libraries)


@pytest.mark.parametrize("size", [2048, 16, 1])
def test_packing_sizes(spark, libraries, size):
    docs = [(k, t) for k, t in enumerate(odd_texts(80, 5))] + [(900, "word " * 3000), (901, None), (902, ""), (-(1 << 63), "least")]
    fits(packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), A, size).collect(), docs, libraries, size)


def test_packing_odd_rows(odd, odd_rows, nothing, libraries):
    got = packing.pack(odd.withColumnsRenamed({"rep": "row", "part": "key", "h": "a0", "id": "ids"}), A).collect()
    assert sum(r["length"] for r in got) == sum(len(ids_of(r[2], libraries)) for r in odd_rows)
    assert sum(r["length"] for r in got if r["doc_id"] is None) == len(ids_of(odd_rows[-1][2], libraries))
    empty = packing.pack(nothing, A)
    assert empty.count() == 0 and empty.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_copies_are_split_over_partitions(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same text again and again").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else partitions as small as these become one
    try:
        got = packing.pack(docs, A, 64)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.agg(F.sum("length")).first()[0] == 3000 * 7 and got.select("doc_id").distinct().count() == 3000
    lengths = got.groupBy("sequence_id").agg(F.sum("length").alias("n")).groupBy("n").count().collect()
    assert sum(r["count"] for r in lengths if r["n"] < 64) > 1  # more than one partition had a rest


def test_projection_by_plain_loops(monkeypatch):
    """Documents of no, few and many ids, more than are projected at once; the work follows the ids, not the vocabulary."""
    rng, counted, log1p = np.random.default_rng(5), [], np.log1p
    docs = [rng.integers(0, 1 << 16 if k % 2 else 50, k % 7 * 400).astype(np.uint16) for k in range(packing.TOGETHER + 40)]
    want = np.zeros((len(docs), packing.AXES))
    for k, ids in enumerate(docs):
        v = np.zeros(packing.BUCKETS)
        for i, n in zip(*np.unique(ids, return_counts=True), strict=True):
            v[packing._bucket[i]] += packing._sign[i] * log1p(n)
        if v.any():
            want[k] = v / np.sqrt(v @ v) @ packing._matrix
    monkeypatch.setattr(np, "log1p", lambda n: counted.append(np.size(n)) or log1p(n))
    assert np.allclose(packing.project(docs), want, rtol=0, atol=1e-12)
    assert sum(counted) <= sum(map(len, docs))
    assert packing.project([]).shape == (0, packing.AXES)


def test_neighbours_are_alike(spark):
    """Two kinds of text, dealt out in turn: along the curve a sequence holds mostly one kind."""
    rng = random.Random(2)
    kinds = ["river stone water fish boat shore wave sand".split(), "tax court law judge bill vote state act".split()]
    docs = [(k, " ".join(rng.choices(kinds[k % 2], k=40))) for k in range(600)]
    got = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), A, 512)
    own = got.groupBy("sequence_id").agg(F.sum(F.when(F.col("doc_id") % 2 == 0, F.col("length")).otherwise(0)).alias("even"), F.sum("length").alias("n")).collect()
    assert sum(max(r["even"], r["n"] - r["even"]) for r in own) > 0.9 * sum(r["n"] for r in own)


def test_sequences_hold_the_ids(spark, libraries):
    docs = [(1, "one text"), (2, "another text " * 50)]
    pieces = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), A, 32, with_ids=True)
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(pieces).collect()}
    for r in pieces.collect():
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"] and crc(r["ids"]) == r["ids_crc32"]
    assert sum(map(len, whole.values())) == sum(len(ids_of(t, libraries)) for _, t in docs)
