"""Suffixes, near-duplicates, language model, tokens, fingerprints, benchmark: against brute force."""

import collections
import hashlib
import itertools
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import decontam, fingerprints, lattice_lm, near_dedup, suffix_dedup, token_store
from quern.llm.common import Scratch, fold
from quern.llm.components import components

from .conftest import SF, lower

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _repeats(rows, length=50):
    """Brute force over (id, text); a null id is the least."""
    key = lambda d: (d is not None, d or 0)
    least, out = {}, []
    for d, t in rows:
        x = (t or "").encode()
        for i in range(len(x) - length + 1):
            w = x[i : i + length]
            if w not in least or key(d) < key(least[w]):
                least[w] = d
    for d, t in rows:
        x = (t or "").encode()
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if key(least[x[i : i + length]]) < key(d):
                gone[i : i + length] = True
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((d, len(x), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_repeats_of_odd_rows(odd, odd_rows, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    assert _rows(suffix_dedup.dedup(odd)) == _repeats([(r[1], r[2]) for r in odd_rows])


def test_repeats_of_the_table(spark, real, nothing):
    assert _rows(suffix_dedup.dedup(spark.read.parquet(f"{SF}/documents.parquet"))) == _repeats(real.items())
    assert suffix_dedup.dedup(nothing).count() == 0


def test_repeats_in_small_alphabets(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "".join(rng.choice(list("ab"), 300)) + "abab" * 30 + "".join(rng.choice(list("ab"), i % 7))) for i in range(30)]
    assert _rows(suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == _repeats(rows)


def _set(t, size=5):
    w = lower(t).split()
    return frozenset([tuple(w)] if 0 < len(w) < size else [tuple(w[i : i + size]) for i in range(len(w) - size + 1)])


def _least(ids):
    """A null id is the least."""
    return None if None in ids else min(ids)


def _linked(rows, percent=80):
    """Brute force over rows (doc_id, text), which may repeat: (doc_id, n_shingles, component_id, kept) of each, and the components as lists of row numbers."""
    sets = [_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    parts = collections.defaultdict(list)
    for k in range(len(rows)):
        parts[find(k)].append(k)
    least = {r: _least([rows[k][0] for k in v]) for r, v in parts.items()}
    return sorted(((d, len(sets[k]), least[find(k)], d == least[find(k)]) for k, (d, _) in enumerate(rows)), key=repr), list(parts.values())


@pytest.mark.parametrize("percent", [80, 85])
def test_near_copies_of_the_table(spark, real, nothing, percent):
    assert _rows(near_dedup.groups(spark.read.parquet(f"{SF}/documents.parquet"), percent)) == _linked(list(real.items()), percent)[0]
    assert near_dedup.groups(nothing).count() == 0 and near_dedup.one_of_each(nothing).columns == nothing.columns


def _edited(n=120, words=150, most=9):
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in rng.integers(0, 5000, words)]
    rows = []
    for i in range(n):
        w = list(base)
        for k in rng.choice(words, i % most, replace=False):
            w[k] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("few", [256, near_dedup.FEW, 3])
def test_near_copies_by_edits(spark, monkeypatch, few):
    """With `few` at 3 nearly all pairs beyond the hubs' are found by the rarest shingles."""
    monkeypatch.setattr(near_dedup, "FEW", few)
    monkeypatch.setattr(near_dedup, "OUTSIDERS", min(few, near_dedup.OUTSIDERS))
    rows = _edited()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 85):
        assert _rows(near_dedup.groups(df, percent)) == _linked(rows, percent)[0]


def test_near_copies_with_repeated_and_null_ids(spark):
    rows = [(None if i % 11 == 0 else i % 13, t) for i, t in _edited(60)]
    rows += [(5, "quite another text that has more than five words"), (5, "quite another text that has more than five words"), (7, None), (7, ""), (None, "quite another text that has more than five words"), (None, "   ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, parts = _linked(rows)
    assert _rows(near_dedup.groups(df)) == want
    once = near_dedup.one_of_each(df)
    got = collections.Counter(tuple(r) for r in once.collect())
    left = 0
    for part in parts:
        own = [rows[k] for k in part]
        if not _set(own[0][1]):
            assert all(got[r] for r in own)
            left += len(own)
            continue
        left += 1
        assert sum(got[r] for r in set(own)) == 1 and {d for d, t in set(own) if got[d, t]} == {_least([d for d, _ in own])}
    assert once.columns == df.columns and sum(got.values()) == left


def test_near_copies_of_odd_rows(odd, odd_rows):
    want, _ = _linked([(r[1], r[2]) for r in odd_rows])
    assert _rows(near_dedup.groups(odd)) == want
    assert near_dedup.one_of_each(odd).columns == odd.columns
    named = odd.withColumnsRenamed({"extra": "__quern_row", "part": "class", "h": "digest", "rep": "kept"})
    assert near_dedup.one_of_each(named).columns == named.columns and near_dedup.one_of_each(named).count() == near_dedup.one_of_each(odd).count()


@pytest.fixture
def steps(monkeypatch):
    """What a run of near_dedup writes, by name, and how many rows its joins of buckets have."""
    saved, save = {}, Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name, **o: saved.setdefault(name, save(self, df, name, **o)))
    monkeypatch.setattr(Scratch, "free", lambda self, *names: None)

    def joined(name):
        if f"{name}-open" not in saved:
            return 0
        sizes = saved[f"{name}-open"].groupBy("bucket").agg(F.count("*").alias("all"), F.count_if(~F.col("inside")).alias("outside"))
        return sizes.agg(F.sum(F.col("all") * F.col("outside"))).first()[0] or 0

    return saved, joined, lambda name: saved[name].agg(F.sum(F.size("buckets"))).first()[0]


def test_templates_make_no_square(spark, steps):
    """2,000 texts that share half of their shingles: all are in one another's buckets, none is linked, and few pairs are looked at."""
    saved, joined, rows_of = steps
    frame = " ".join(f"frame{k}" for k in range(100))
    rows = [(i, frame + " " + " ".join(f"own{i}x{k}" for k in range(70))) for i in range(2000)]
    got = near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.filter("kept").count() == 2000
    most = saved["buckets"].groupBy("bucket").count().agg(F.max("count")).first()[0]
    many = saved["many"].count()
    assert most > 500 and many > 1000
    assert rows_of("rare") <= 34 * many  # of 166 shingles each, 34 may be among the rarest
    assert saved["near-open"].count() < 40 * 2000 and joined("near") < 64 * 2000 and joined("rare") < 2000 and "wide" not in saved


def test_a_pair_is_made_in_one_of_its_buckets(spark, steps, monkeypatch):
    """Texts just under the threshold share many bands and rare shingles; each pair is made once, and none is lost."""
    monkeypatch.setattr(near_dedup, "FEW", 16)
    monkeypatch.setattr(near_dedup, "OUTSIDERS", 0)
    saved, joined, _ = steps
    frame = [f"frame{k}" for k in range(160)]
    rows = [(i, " ".join(frame + [f"own{i}x{k}" for k in range(22)])) for i in range(60)] + [(100 + i, " ".join(frame[20:] + [f"mine{i // 2}x{k}" for k in range(40)] + ["x"] * (i % 2))) for i in range(40)]
    assert _rows(near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 85)) == _linked(rows, 85)[0]
    met = 0
    for name in ("near", "rare"):
        full = saved[f"{name}-open"]
        x, y = (full.select("bucket", *(F.col(c).alias(f"{c}_{k}") for c in ("digest", "component", "inside", "all"))) for k in "xy")
        pairs = x.filter("not inside_x").join(y, "bucket").filter("component_x <> component_y and (inside_y or digest_x < digest_y)").withColumn("once", near_dedup.first_meeting("x", "y"))
        told = pairs.groupBy(F.least("digest_x", "digest_y"), F.greatest("digest_x", "digest_y")).agg(F.count("*").alias("n"), F.count_if("once").alias("once")).collect()
        assert all(r["once"] == 1 for r in told)
        met += sum(r["n"] > 1 for r in told)
    assert met > 100


def test_long_texts_meet_in_few_of_their_buckets(spark, steps, monkeypatch):
    """Three texts of a kind share about 80 rare shingles, more than a list holds; a pair is made once in each of two ranges at most, and none is lost."""
    monkeypatch.setattr(near_dedup, "FEW", 4)
    monkeypatch.setattr(near_dedup, "OUTSIDERS", 0)
    saved, _, _ = steps
    frame = [f"frame{k}" for k in range(340)]
    rows = [(i, " ".join(frame + [f"mine{i // 3}x{k}" for k in range(190)] + [f"own{i}x{k}" for k in range(70)])) for i in range(30)] + [(100, " ".join(frame + [f"mine0x{k}" for k in range(190)] + [f"own0x{k}" for k in range(60)]))]
    assert _rows(near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 80)) == _linked(rows, 80)[0]
    full = saved["rare-open"]
    assert full.groupBy("digest").count().agg(F.max("count")).first()[0] > near_dedup.LISTED
    x, y = (full.select("bucket", *(F.col(c).alias(f"{c}_{k}") for c in ("digest", "component", "inside", "all"))) for k in "xy")
    pairs = x.filter("not inside_x").join(y, "bucket").filter("component_x <> component_y and (inside_y or digest_x < digest_y)").withColumn("once", near_dedup.first_meeting("x", "y"))
    told = pairs.groupBy("digest_x", "digest_y").agg(F.count("*").alias("n"), F.count_if("once").alias("once")).collect()
    assert all(1 <= r["once"] <= 2 for r in told) and sum(r["n"] > near_dedup.LISTED for r in told) > 20


@pytest.mark.parametrize("listed", [1, 3])
def test_ranges_of_different_sizes_lose_no_link(spark, monkeypatch, listed):
    """Lists of a bucket or three, so that classes have ranges of many sizes; brute force finds the same."""
    monkeypatch.setattr(near_dedup, "LISTED", listed)
    rows = _edited(60, most=14)
    assert _rows(near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 80)) == _linked(rows, 80)[0]


def test_common_shingles_are_counted_in_batches():
    s = np.arange(50, dtype=np.int64).tobytes()
    (got,) = near_dedup._shingles([pa.RecordBatch.from_arrays([pa.array([s] * 30 + [s[:80]])], names=["s"])])
    assert got.num_rows == 50 and got.column(1).to_pylist() == [31] * 10 + [30] * 40


def test_recombined_passages_make_no_square(spark, steps):
    """800 texts of 75 of the same 100 passages, in one order, so that all pairs share very many shingles, rare ones included; 20 copies with an edit are linked. Rows that are joined stay within a few times the rows of buckets."""
    saved, joined, rows_of = steps
    rng = np.random.default_rng(3)
    passages = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 12)) for _ in range(100)]
    rows = [(i, " ".join(passages[k] for k in np.sort(rng.permutation(100)[:75]))) for i in range(800)]
    rows += [(1000 + i, rows[30 * i][1] + " one more end") for i in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 85).collect()}
    assert all(got[1000 + i] == 30 * i for i in range(20))
    assert sum(d == c for d, c in got.items()) == 800
    assert joined("near") <= 64 * saved["buckets"].count() and joined("rare") <= 2 * near_dedup.WORK * rows_of("rare")
    assert rows_of("wide") == near_dedup.wide_bands(85) * saved["still"].count() and joined("wide") <= rows_of("wide")


@pytest.mark.parametrize("percent", [80, 85])
def test_wide_bands_lose_no_link(spark, monkeypatch, percent):
    """With small bounds everything beyond the hubs goes to the wide bands; brute force finds the same."""
    monkeypatch.setattr(near_dedup, "FEW", 2)
    monkeypatch.setattr(near_dedup, "OUTSIDERS", 0)
    monkeypatch.setattr(near_dedup, "WORK", 0)
    rows = _edited(60, most=14)
    assert _rows(near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), percent)) == _linked(rows, percent)[0]


def test_recall_of_links(spark):
    """Links against brute force on the table of 1,000 documents, by sets of shingles: all components are equal."""
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(path).select("doc_id", "text").collect()]
    by_shingle = collections.defaultdict(list)
    sets = [_set(t) for _, t in rows]
    for k, s in enumerate(sets):
        for x in s:
            by_shingle[hash(x)].append(k)
    pairs = {(a, b) for v in by_shingle.values() if len(v) > 1 for a, b in itertools.combinations(v, 2)}
    linked = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.groups(spark.read.parquet(path)).collect()}
    found = sum(got[rows[a][0]] == got[rows[b][0]] for a, b in linked)
    print(f"recall of links at 0.8 on {len(rows)} documents: {found} of {len(linked)}")
    assert found == len(linked) > 20


def test_sketches_estimate():
    rng = np.random.default_rng(1)
    for j in (0.7, 0.85, 0.95):
        errors = []
        for _ in range(60):
            s = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
            k = int(2000 * (1 - j) / (1 + j))
            a, b = (near_dedup.odd_sketch(near_dedup.minhash(x)) for x in (s[: 2000 - k], s[k:]))
            true = (2000 - 2 * k) / 2000
            errors.append(near_dedup.sketch_similarity(int(np.bitwise_count(a ^ b).sum())) - true)
        assert abs(np.mean(errors)) < 0.03
    assert near_dedup.most_bits(0.85) > near_dedup.most_bits(0.95)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(edges, Scratch(spark, "t"), "p").collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == 100


def _base(rows, learn):
    words = [(d, [*lower(t).split(), None]) for d, t in rows]
    c = collections.Counter(w for d, ws in words if learn(d) for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted((str(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in words)


@pytest.mark.parametrize("chunk", [50, lattice_lm.CHUNK])
def test_base_scores(odd, odd_rows, chunk):
    got = lattice_lm.score(odd, fold("doc_id", 7) != 2, PIECES, chunk_bytes=chunk)
    want = _base([(r[1], r[2]) for r in odd_rows], lambda d: d is None or zlib.crc32(str(d).encode()) % 7 != 2)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got.collect()) == want


def test_scores_do_not_hang_on_the_split(odd, nothing):
    a, b = ({(r["doc_id"], r["n_tokens"]): r["score"] for r in lattice_lm.score(odd, F.lit(True), PIECES, chunk_bytes=k).collect()} for k in (50, lattice_lm.CHUNK))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 * max(1, abs(a[k])) and a[k] < 0 for k in a)
    assert lattice_lm.score(nothing, F.lit(True), PIECES).count() == 0
    assert lattice_lm.score(odd, F.lit(False), PIECES).filter("score < 0 and n_known = 0").count() == odd.count()


def test_scores_by_enumeration(spark, monkeypatch):
    """Documents' scores recomputed in plain Python: every segmentation of every word, for the scoring and for both rounds of expected counts."""
    mark = lattice_lm.MARK.encode()
    pieces = [mark, b"a", b"b", b"ab", mark + b"a", b"aba", *(bytes([x]) for x in range(256) if x not in b"ab")]
    first = np.log(np.random.default_rng(0).dirichlet(np.ones(len(pieces))))
    monkeypatch.setattr(lattice_lm, "vocabulary", lambda _: (pieces, first))
    docs = [(1, "ab aba"), (2, "ab b ab"), (3, "abba bab"), (4, None), (5, "ba")]
    learn = {1, 2, 4}

    def ways(w):
        """Segmentations of a marked word; none starts inside the mark."""
        def go(x, at):
            if not x:
                yield []
            for k in range(1, len(x) + 1):
                if x[:k] in pieces and not (at in (1, 2) and at + k > 3):
                    for rest in go(x[k:], at + k):
                        yield [x[:k], *rest]

        return list(go(mark + w, 0))

    trained = [w for d, t in docs if d in learn for w in lower(t).split()]
    c, ends = collections.Counter(trained), len(learn)
    weights = dict(zip(pieces, np.exp(first), strict=True))
    total = lambda w, p: sum(math.prod(p[x] for x in s) for s in ways(w))
    for _ in range(2):
        x = dict.fromkeys(pieces, 0.01)
        for w in c:
            for s in ways(w):
                for piece in s:
                    x[piece] += math.prod(weights[q] for q in s) / total(w, weights)
        whole = sum(x.values()) + ends
        weights = {p: n / whole for p, n in x.items()}
    n = len(trained) + ends
    own, end = 1 - sum(k == 1 for k in c.values()) / len(trained), ends / n
    want = {d: math.log10(end) + sum(math.log10(own * c[w] / n + (1 - own) * (1 - end) * total(w, weights)) for w in lower(t).split()) for d, t in docs}
    got = lattice_lm.score(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id").isin(*learn), PIECES)
    assert {r["doc_id"]: round(r["score"], 6) for r in got.collect()} == {d: round(x, 6) for d, x in want.items()}


def test_all_pieces_are_kept():
    import sentencepiece

    pieces, _ = lattice_lm.vocabulary(PIECES)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    whole = {sp.id_to_piece(i).encode() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))}
    assert whole <= set(pieces) and max(map(len, whole)) > 32


def test_lattice_sums_all_segmentations():
    pieces = [lattice_lm.MARK.encode(), b"a", b"b", b"ab", lattice_lm.MARK.encode() + b"a", b"aba", *(bytes([x]) for x in range(256) if x not in b"ab")]
    p = np.random.default_rng(0).dirichlet(np.ones(len(pieces)))
    known = dict(zip(pieces, p, strict=True))
    lattice = lattice_lm.Lattice(pieces, np.log(p))

    def all_ways(w):
        return 1.0 if not w else sum(known[w[:k]] * all_ways(w[k:]) for k in range(1, len(w) + 1) if w[:k] in known)

    words = [b"a", b"ab", b"abab", b"ababa", b"c", b"aXb" * 3]
    got = lattice.log_marginals(words)
    for w, g in zip(words, got, strict=True):
        # the mark's own bytes aren't pieces of a segmentation
        want = sum(known[m + w[:k]] * all_ways(w[k:]) for m in [lattice_lm.MARK.encode()] for k in range(len(w) + 1) if m + w[:k] in known) + np.prod([known[bytes([x])] for x in lattice_lm.MARK.encode()]) * all_ways(w)
        assert abs(math.exp(g) - want) < 1e-3 * want + 1e-15
        assert abs(lattice.one(w) - g) < 1e-2


def test_token_store(spark, odd, odd_rows, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    path = Scratch(spark, "store").root
    token_store.store(odd, BPE, path)
    got = token_store.read(spark, path, with_ids=True).orderBy("start").collect()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0)) and len(got) == len(odd_rows)
    texts = collections.defaultdict(list)
    for r in odd_rows:
        texts[r[1]].append(r[2])
    at = 0
    for r in got:
        want = [*t.encode(texts[r["doc_id"]][0] or "", add_special_tokens=False).ids, 2]
        assert r["ids"] == want and r["start"] == at and r["n_tokens"] == len(want) and r["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    token_store.store(nothing, BPE, f"{path}-none")
    assert token_store.read(spark, f"{path}-none").count() == 0


@pytest.mark.parametrize("step", [4096, 50])
def test_long_words_give_expected_counts(monkeypatch, step):
    pieces, logp = lattice_lm.vocabulary(PIECES)
    lattice = lattice_lm.Lattice(pieces, logp)
    words = ["日本語の文章はとても長いです" * 12, "internationalization" * 30, "x" * 158, "é" * 400]
    words, c = [w.encode() for w in words], np.array([1.0, 2.0, 3.0, 4.0])
    got, want = np.zeros(len(pieces)), np.zeros(len(pieces))
    size = np.array([len(p) for p in pieces])
    monkeypatch.setattr(lattice_lm, "STEP", step, raising=False)
    lattice.expect(words, c, got)
    assert got[size > 1].sum() > 50
    monkeypatch.setattr(lattice_lm, "LONG", 1000)
    lattice.expect(words, c, want)
    assert np.allclose(got, want, atol=1e-6) and abs((got * size).sum() - sum(n * (len(w) + 3) for w, n in zip(words, c, strict=True))) < 1e-4


def test_more_pieces_than_the_table_holds():
    from tokenizers import Tokenizer

    text = " ".join(f"w{i}q{i * 7919 % 1000003}" for i in range(500_000))
    got = token_store.Encoder(BPE).batch([b"x", text.encode(), b"", b"y  z"])
    t = Tokenizer.from_file(BPE)
    assert [np.frombuffer(g, np.uint16).tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in ("x", text, "", "y  z")]


def test_random_unicode_has_the_librarys_ids():
    import random

    from tokenizers import Tokenizer

    rng, t, e = random.Random(1), Tokenizer.from_file(BPE), token_store.Encoder(BPE)
    letters = " \n\t\x1c\x85\xa0\u3000ab1'sé日.!²½ſ\u200b\ufeff×÷Àß"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += ["it's 's  's\n\n  's", "<|endoftext|>", " x <|endoftext|>  y<|endoftext|><|endoftext|>", "a" * 5000, "x " * 300 + "y" * 40]
    assert [np.frombuffer(g, np.uint16).tolist() for g in e.batch([x.encode() for x in texts])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_added_tokens(spark):
    from tokenizers import Tokenizer

    t, end = Tokenizer.from_file(BPE), "<|endoftext|>"
    texts = [end, f"a {end} b", f"one{end}{end}two\n {end}", f"  {end}  it's 12 <|endoftext {end}|>", f"é ß{end}日本 \x1c x", "no such token"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = Scratch(spark, "added").root
    token_store.store(docs, BPE, path)
    got = token_store.read(spark, path, with_ids=True).orderBy("start").collect()
    assert [r["ids"] for r in got] == [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts] and 50256 in got[1]["ids"]


def test_coder_from_checkpoints():
    rng = np.random.default_rng(4)
    ids = (rng.zipf(1.3, 400_000) % 50_000).astype(np.uint16)
    coder = token_store.Coder(token_store.scale_counts(np.bincount(ids, minlength=1 << 16)))
    payload = coder.pack([(1, ids[:1000].tobytes()), (None, ids[1000:].tobytes())])
    index, back = coder.unpack(payload)
    assert (back == ids).all() and index[:, 1].tolist() == [1000, 399_000]
    step = token_store.CHECKPOINT_STEPS * token_store.LANES
    assert all((coder.unpack(payload, k)[1] == ids[k * step : (k + 1) * step]).all() for k in range(-(-len(ids) // step)))
    broken = bytearray(payload)
    broken[len(broken) // 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        coder.unpack(bytes(broken))
    p = np.bincount(ids) / len(ids)
    assert len(payload) * 8 / len(ids) < 1.1 * -(p[p > 0] * np.log2(p[p > 0])).sum() + 0.5


def test_fingerprints(spark, real, nothing):
    got = {r["doc_id"]: r for r in fingerprints.against_edited(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    order = sorted(real, reverse=True)
    for d, n in zip(order, [*order[1:], order[0]], strict=True):
        t, k = real[d], len(real[d]) // 3
        e = t[: len(t) - k] + real[n][:k]
        assert got[d]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and got[d]["n_chars"] == len(t)
        assert got[d]["near_next"] == fingerprints.likeness_of_texts(got[d]["fingerprint"], got[n]["fingerprint"])
        assert got[d]["near_edited"] == fingerprints.likeness_of_texts(got[d]["fingerprint"], got[d]["edited_fingerprint"])
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.97
    plain = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert all(plain[d] == got[d]["fingerprint"] for d in got)
    assert fingerprints.against_edited(nothing).count() == 0


def _plain_sketch(text):
    """The parse by plain loops over Python numbers: runs folded, four coin tosses, cuts at local minima, least names in bins."""
    m64 = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m64
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m64
        return x ^ (x >> 31)

    low, bins = fingerprints.LOW_BINS, fingerprints.BINS
    best = {}
    names = [mix(ord(c) + 1) for c in text]
    for level in range(1, fingerprints.LEVELS + 1):
        folded = [(x, len(list(run))) for x, run in itertools.groupby(names)]
        x = [mix((y + mix(n)) & m64) if n > 1 else y for y, n in folded]
        label = x
        for _ in range(4):
            new = []
            for k, y in enumerate(label):
                d = y ^ (label[k - 1] if k else ~y & m64)
                at = (d & -d).bit_length() - 1
                new.append(2 * at | (y >> at & 1))
            label = new
        phrases = []
        for k, y in enumerate(x):
            if not k or (label[k] < label[k - 1] and label[k] < (label[k + 1] if k + 1 < len(label) else 99)):
                phrases.append([])
            phrases[-1].append(y)
        names = [mix((sum(mix((y + (k + 1) * 0x9E3779B97F4A7C15) & m64) for k, y in enumerate(p)) + level) & m64) for p in phrases]
        for y in names:
            h = mix(y)
            b = h >> 60 if level == 1 else (h >> 58) + low
            best[b] = min(best.get(b, m64), h & ((1 << 58) - 1))
    return [1 + mix(best[b]) % 65535 if b in best else 0 for b in range(low + bins)]


def test_parse_by_plain_loops(real):
    rng = np.random.default_rng(8)
    texts = ["", "a", "aa", "aaaaab", "ß日本日本", *("".join(rng.choice(list("abc "), n)) for n in (2, 9, 40, 300)), *[t[:1500] for t in list(real.values())[:15] if t]]
    got = fingerprints.sketches(texts)
    assert [s.tolist() for s in got] == [_plain_sketch(t) for t in texts]


def test_equal_parts_are_parsed_alike():
    rng = np.random.default_rng(3)
    common = "".join(rng.choice(list("abcdefgh "), 3000))
    a, b = "x" * 7 + common, "".join(rng.choice(list("abcdefgh "), 41)) + common
    s = fingerprints.sketches([a, b, "".join(rng.choice(list("abcdefgh "), 3000)), "", "zzzzzz", "zzzzzz"])
    assert fingerprints.likeness(s[0], s[1]) > 0.9 > 0.3 > fingerprints.likeness(s[0], s[2])
    assert (s[4] == s[5]).all() and fingerprints.likeness(s[3], s[3]) == 1 and fingerprints.likeness(s[3], s[0]) == 0


def test_fingerprint_odd_rows(odd):
    got = fingerprints.against_edited(odd).collect()
    assert len(got) == odd.count()
    one = odd.filter("doc_id = 6")
    r = fingerprints.against_edited(one).first()
    assert r["near_next"] == 1.0


def _hits(docs, items, size=10):
    word = lambda t: [w for w in "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in lower(t).decode()).split(" ") if w]
    windows = collections.defaultdict(set)
    for i, t in items:
        w = word(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, met = word(t), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                if (x := tuple(w[k : k + n])) in windows and len(x) == n:
                    hit.update(range(k, k + n))
                    met |= windows[x]
        out.append((d, len(w), sorted(hit), sorted(met)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [500_000, 20])
def test_benchmark_hits(spark, odd, odd_rows, nothing, most):
    items = [(1, "one two three four five"), (2, "Word1 und1 Word2, und2; Word3 und3 Word4 und4 Word5 und5 Word6 und6 Word7"), (2, "two words"), (3, None), (4, "!!"), (10, "ß ü"), (None, "stands in several")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.scan(odd, bench, max_windows=most)
    want = _hits([(r[1], r[2]) for r in odd_rows], [("" if i is None else i, t) for i, t in items])
    assert sorted(((r["doc_id"], r["n_words"], r["hits"], r["items"]) for r in got.collect()), key=repr) == want
    cleaned = decontam.clean(odd, bench, max_windows=most, drop_over=0.5)
    texts = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert cleaned.columns == odd.columns and 5 not in texts and "stands in several" not in texts[6] and texts[6].startswith("This one line") and texts[0] is None
    named = odd.withColumnsRenamed({"extra": "__quern_hits", "id": "__quern_items", "features": "__QUERN_ROW", "rep": "row", "part": "hits", "source": "items"})
    again = decontam.clean(named, bench, max_windows=most, drop_over=0.5)
    assert again.columns == named.columns and sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, cleaned.collect()), key=repr)
    assert decontam.scan(nothing, bench, max_windows=most).count() == 0 and decontam.scan(odd, bench.limit(0)).filter("n_hit > 0").count() == 0
