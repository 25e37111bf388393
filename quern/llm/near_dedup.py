"""Near-duplicates by MinHash, banded candidates and odd sketches.

1. Each text's set of word shingles gives K MinHash samples: bands of them propose candidates, and all of them, folded into a parity bitmap (an odd sketch), estimate the similarity of a candidate pair by the population count of the bitmaps' XOR.
2. Texts with equal sets are one class, named by the set's 128-bit digest; only classes go on, however many rows and ids they have.
3. In each bucket (band, value), classes are paired with two hubs, the least and the most central of them, not with each other. Pairs that the sketch finds likely are confirmed on the full sets, and the links make components.
4. Then only pairs of a bucket that lie in different components can still change a component. Where a bucket has few classes, or few outside its largest component, those few meet the others. The classes of all other buckets (templates: texts that are alike, but not enough) are paired anew by their rarest shingles: two sets with a similarity of t have a shingle in common among the n - ceil(t * n) + 1 rarest of each, so buckets by these lose nothing, and what a template's texts share isn't among them. Where such buckets are so large that they make more than WORK rows for each of theirs (texts put together from the same passages, which share their rarest shingles with very many others), their classes get MinHash samples anew, in bands of WIDE_ROWS: texts far under the threshold hardly ever agree on so many samples, and there are as many bands as keep a link's miss under MISS. All these pairs are bounded by sizes, by the sketch and by counts of shingles in hash classes (the lesser counts add up to no less than the overlap), then confirmed. No link between different components is lost, and a bucket of texts that are alike costs as many pairs as it has members. A pair is looked at without being linked only if it shares a small bucket, or is so like that it agrees on a wide band: pairs just under the threshold do, and there the work grows with their number.
5. Components are found by star contraction over written tables.

A pair at 0.8 misses all 32 bands of 4 rows with probability 5e-8 (at 0.85: 5e-11) and is refused by the sketch with about 1e-8.

Edge cases: texts without words are linked with nothing and kept; a text of fewer words than a shingle has its whole word sequence as its only shingle; repeated rows are linked like any equal texts, and so are different texts with one doc_id. A null doc_id counts as the least id: its component's id is null, and it is kept. An empty table gives an empty result. Only doc_id and text are read, so other columns may have any name; `one_of_each` keeps them all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, space_words, sub_batches, texts_of
from .components import components

BANDS, ROWS = 32, 4
K = BANDS * ROWS
SKETCH_BITS = 512
CLASSES = 128
#: Rows of ids (16 bytes each) that may be broadcast; beyond, the join is by shuffle.
BROADCAST_ROWS = 1_000_000
#: A bucket's classes meet directly where it has so many at most, or so many outside its largest component.
FEW, OUTSIDERS = 64, 64
#: Samples in a band for the classes of buckets that stay large, and how often a link may be missed by them.
WIDE_ROWS, MISS = 16, 1e-8
#: Rows that the rarest shingles' buckets may make when they meet directly, for each row in them.
WORK = 64
#: A class' row in a bucket carries the list of its buckets, or those of the bucket's range where it is in more than so many.
LISTED = 64
#: Stands for as many classes as are affordable.
AS_MANY = -1
#: A shingle of so many sets at most isn't common.
COMMON = 16
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix(x):
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_rng = np.random.default_rng(20)
_A = _rng.integers(1, 1 << 63, K, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(1, 1 << 63, K, dtype=np.uint64)


class _WordHash(dict):
    """64-bit hashes of words; what it remembers is bounded."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


_hashes = _WordHash()


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = [space_words(t) for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    flat = np.array([_hashes[x] for w in words for x in w], np.uint64)
    out, at = [], 0
    if len(flat) >= size:
        h = np.zeros(len(flat) - size + 1, np.uint64)
        for j in range(size):
            h = h * _MULT + flat[j : j + len(h)]
        h = _mix(h)
    for k in n.tolist():
        if k >= size:
            out.append(np.unique(h[at : at + k - size + 1]))
        elif k:
            short = np.uint64(k)
            with np.errstate(over="ignore"):
                for x in flat[at : at + k]:
                    short = short * _MULT + x
            out.append(_mix(np.array([short], np.uint64) ^ np.uint64(0x5851F42D4C957F2D)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += k
    return out


def minhash(s: np.ndarray) -> np.ndarray:
    """The K samples of a set that isn't empty."""
    best = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 512):
        best = np.minimum(best, (s[i : i + 512, None] * _A + _B).min(0))
    return best


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """The parity bitmap of (place, sample) pairs, as 64-bit words."""
    bit = (_mix(samples + np.arange(1, K + 1, dtype=np.uint64) * _MULT) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = np.bincount(bit, minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def sketch_similarity(xor_bits: float) -> float:
    """The Jaccard similarity that a population count of the XOR of two odd sketches tells."""
    z = min(xor_bits, SKETCH_BITS / 2 - 1)
    return 1 - np.log(1 - 2 * z / SKETCH_BITS) / np.log(1 - 2 / SKETCH_BITS) / (2 * K)


def most_bits(threshold: float, sigmas: float = 5.5) -> int:
    """The largest population count that a pair of this similarity may show, but for chance beyond so many standard deviations of the MinHash estimate."""
    least = threshold - sigmas * (threshold * (1 - threshold) / K) ** 0.5
    return max((z for z in range(SKETCH_BITS // 2) if sketch_similarity(z) >= least), default=SKETCH_BITS)


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _sign(size: int):
    def run(batches):
        for b in sub_batches(batches):
            n, digests, bands, odd = [], [], [], []
            for s in shingle_sets(texts_of(b), size):
                n.append(len(s))
                if not len(s):
                    digests.append(None), bands.append(None), odd.append(None)
                    continue
                m = minhash(s)
                h = np.full(BANDS, 7, np.uint64)
                for r in range(ROWS):
                    h = _mix(h * _MULT + m[r::ROWS])
                digests.append(_digest(s))
                bands.append((h + np.arange(BANDS, dtype=np.uint64) * _MULT).view(np.int64))
                odd.append(odd_sketch(m).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))], names=["doc_id", "h", "n_shingles", "digest", "bands", "odd"])

    return run


def _sets(size: int):
    """Digest, the set, and its counts of shingles by hash class; null counts where they are too large for the type."""

    def run(batches):
        for b in sub_batches(batches):
            sets = shingle_sets(texts_of(b), size)
            counts = [np.bincount((s & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([c.astype(np.int16) if c.max() < 1 << 15 else None for c in counts], pa.list_(pa.int16()))], names=["digest", "s", "by_class"])

    return run


def _shingles(batches):
    """s -> bucket, n: how many sets of the batch have a shingle, so that what all sets of a template share is a row for each batch, not for each set."""
    for b in batches:
        names, n = np.unique(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n.astype(np.int64))], names=["bucket", "n"])


def _rarest(shared, percent: int):
    """digest, s -> digest, buckets: the n - ceil(t * n) + 1 first shingles of each set in one order for all sets: those that aren't common by their hash, then the common ones by how many sets have them."""

    def run(batches):
        names, df = shared.value
        order = np.argsort(names)
        names, df = names[order], df[order]
        for b in batches:
            firsts = []
            for s in b.column(1).to_pylist():
                x = np.frombuffer(s, np.int64)
                at = np.minimum(np.searchsorted(names, x), max(0, len(names) - 1))
                often = np.where(names[at] == x, df[at], 0) if len(names) else np.zeros(len(x), np.int64)
                firsts.append(x[np.lexsort((x, often))[: len(x) - -(-percent * len(x) // 100) + 1]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(firsts, pa.list_(pa.int64()))], names=["digest", "buckets"])

    return run


def wide_bands(percent: int) -> int:
    """How many bands of WIDE_ROWS samples a link at the threshold misses with a probability of MISS."""
    return int(np.ceil(np.log(MISS) / np.log1p(-((percent / 100) ** WIDE_ROWS))))


def _wide(percent: int):
    """digest, s -> digest, buckets: the wide bands of each set."""

    def run(batches):
        n = wide_bands(percent)
        rng = np.random.default_rng(21)
        a, b = (rng.integers(1, 1 << 63, n * WIDE_ROWS, dtype=np.uint64) for _ in range(2))
        a |= np.uint64(1)
        for batch in batches:
            bands = []
            for s in batch.column(1).to_pylist():
                x = np.frombuffer(s, np.uint64)
                best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
                for k in range(0, len(x), 64):
                    best = np.minimum(best, (x[k : k + 64, None] * a + b).min(0))
                h = np.arange(n, dtype=np.uint64) * _MULT
                for r in range(WIDE_ROWS):
                    h = _mix(h * _MULT + best[r::WIDE_ROWS])
                bands.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bands, pa.list_(pa.int64()))], names=["digest", "buckets"])

    return run


def _confirm(percent: int):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _affordable(buckets: DataFrame, rows: int) -> int:
    """buckets (m, outside): the largest power of two, FEW at least, for which all buckets of so many classes make no more than so many rows together."""
    sizes = {r["size"]: r["cost"] for r in buckets.groupBy(F.ceil(F.log2("m")).alias("size")).agg(F.sum(F.col("m") * F.col("outside")).alias("cost")).collect()}  # a row for each power of two
    few, cost = FEW, sum(c for k, c in sizes.items() if 1 << k <= FEW)
    for k in sorted(k for k in sizes if 1 << k > FEW):
        cost += sizes[k]
        if cost > rows:
            break
        few = 1 << k
    return few


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marks for broadcast if it has few enough rows; else leaves the join to a shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def bucket_range(bits: str):
    """The range of a bucket among 2^bits equal ones, by its first bits; where two classes have ranges of different sizes, one lies in the other."""
    return F.expr(f"shiftrightunsigned(shiftrightunsigned(bucket, 63 - {bits}), 1)")


def first_meeting(x: str, y: str):
    """Whether a bucket is the least of its range (the smaller one of the two) that two classes have in common, so that a pair is made once in a range, not in each bucket it shares."""
    return F.array_min(F.array_intersect(f"all_{x}", f"all_{y}")) == F.col("bucket")


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, h, text: a row is known by its id and a hash of its text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), text.alias("text"))


def _same_row(left: str, right: str):
    return F.col(f"{left}.h").eqNullSafe(F.col(f"{right}.h")) & F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id"))


def decide(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """Per row: doc_id, h (a hash of its text), n_shingles, class (null without words), component_id, kept."""
    scratch = Scratch(docs.sparkSession, "neardup")
    texts = _marked(docs)
    signed = scratch.save(texts.mapInArrow(_sign(size), "doc_id long, h long, n_shingles long, digest binary, bands array<long>, odd array<long>"), "signed")
    # One row for each class; min() takes a null id as the least.
    classes = scratch.save(signed.filter("digest is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "h")).alias("rep"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", "odd"))), "classes")
    # Buckets of more than one class. What is aggregated is written before it meets the rows, so that adaptive execution can split a hot bucket.
    rows = classes.select("digest", F.explode("bands").alias("bucket"))
    shared = scratch.save(rows.groupBy("bucket").agg(F.min("digest").alias("low"), F.max("digest").alias("high"), F.count("*").alias("m")).filter("low < high").drop("high"), "shared")
    few_shared = small(shared, 2 * shared.count())  # 32 bytes a row
    buckets = scratch.save(rows.join(few_shared, "bucket"), "buckets")
    # A bucket's second hub is its most central class, which meets most others in its buckets: of a text and its edited copies, the text.
    central = scratch.save(buckets.groupBy("digest").agg(F.sum("m").alias("met")), "central")
    n_near = central.count()
    hub = scratch.save(buckets.join(small(central, 2 * n_near), "digest").groupBy("bucket").agg(F.max_by("digest", F.struct("met", "digest")).alias("hub")), "hub")
    # The sets of all classes in them, found once.
    near = small(central.select("digest"), n_near)
    wanted = scratch.save(classes.join(near, "digest").select("rep.doc_id", "rep.h"), "wanted")
    sets = texts.alias("t").join(small(wanted, n_near).alias("w"), _same_row("t", "w"), "left_semi").mapInArrow(_sets(size), "digest binary, s binary, by_class array<short>")
    sets = scratch.save(sets.dropDuplicates(["digest"]), "sets")
    sketches = scratch.save(classes.join(sets.select("digest", "by_class"), "digest").select("digest", "n_shingles", "odd", "by_class"), "sketches")
    limit = most_bits(percent / 100)

    def fits(x: str, y: str):
        """Whether sizes, odd sketches and counts by hash class allow a link."""
        n, m = F.col(f"n_shingles_{x}"), F.col(f"n_shingles_{y}")
        bits = sum((F.bit_count(F.col(f"odd_{x}")[k].bitwiseXOR(F.col(f"odd_{y}")[k])) for k in range(SKETCH_BITS // 64)), F.lit(0))
        overlap = F.aggregate(F.zip_with(f"by_class_{x}", f"by_class_{y}", lambda p, q: F.least(p, q)), F.lit(0), lambda t, v: t + v)
        return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (bits <= limit) & F.coalesce((100 + percent) * overlap >= percent * (n + m), F.lit(True))

    def suffixed(df: DataFrame, x: str) -> DataFrame:
        return df.select(*(c if c == "bucket" else F.col(c).alias(f"{c}_{x}") for c in df.columns))

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs (a, b) that the full sets confirm, written."""
        s = sets.select("digest", "s")
        joined = small(pairs, 2 * pairs.count()).join(s.toDF("a", "sa"), "a").join(s.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
        return scratch.save(joined.mapInArrow(_confirm(percent), "a binary, b binary"), name)

    def crossing(members: DataFrame, parts: DataFrame, name: str, few: int | None) -> tuple[DataFrame, DataFrame]:
        """members (bucket, digest): the likely pairs that may join components, written, and the rows of buckets that are left for later: none if `few` is None, of those that cost more than WORK allows if it is AS_MANY."""
        placed = scratch.save(members.join(parts.select(F.col("id").alias("digest"), "component"), "digest", "left").withColumn("component", F.coalesce("component", "digest")), f"{name}-placed")
        sized = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
        open_ = scratch.save(sized.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("m"), (F.sum("n") - F.max("n")).alias("outside")).filter("outside > 0"), f"{name}-buckets")
        rows = placed.join(open_, "bucket")
        if few == AS_MANY:
            few = _affordable(open_, WORK * placed.count())
        direct = F.lit(True) if few is None else (F.col("m") <= few) | (F.col("outside") <= OUTSIDERS)
        # a row for each class and range of buckets meets the sketches; those of a class stay in one place
        bits = F.greatest(F.lit(0), F.ceil(F.log2(F.size("at") / LISTED))).cast("int").alias("bits")
        listed = rows.filter(direct).groupBy("digest").agg(F.first("component").alias("component"), F.collect_list(F.struct("bucket", (F.col("component") == F.col("main")).alias("inside"))).alias("at"))
        ranged = listed.select("digest", "component", bits, F.inline("at")).groupBy("digest", bucket_range("bits").alias("range")).agg(F.first("component").alias("component"), F.collect_list(F.struct("bucket", "inside")).alias("at"))
        full = ranged.join(sketches, "digest").select("digest", "component", "n_shingles", "odd", "by_class", F.col("at.bucket").alias("all"), F.explode("at").alias("p"))
        full = scratch.save(full.select("p.bucket", "digest", "component", "n_shingles", "odd", "by_class", "all", "p.inside"), f"{name}-open")
        x, y = suffixed(full.filter("not inside").drop("inside"), "x"), suffixed(full, "y")
        met = x.join(y, "bucket").filter((F.col("component_x") != F.col("component_y")) & (F.col("inside_y") | (F.col("digest_x") < F.col("digest_y"))) & fits("x", "y") & first_meeting("x", "y"))
        pairs = scratch.save(met.select(F.least("digest_x", "digest_y").alias("a"), F.greatest("digest_x", "digest_y").alias("b")).distinct(), f"{name}-pairs")
        return pairs, rows.filter(~direct)

    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    hubs = buckets.join(small(hub, 2 * hub.count()), "bucket").select(F.explode(F.array(pair("low", "digest"), F.when(F.col("hub") < F.col("digest"), pair("hub", "digest")).otherwise(pair("digest", "hub")))).alias("p")).select("p.a", "p.b").filter("a < b").distinct()
    likely = hubs.join(suffixed(sketches, "a").withColumnRenamed("digest_a", "a"), "a").join(suffixed(sketches, "b").withColumnRenamed("digest_b", "b"), "b").filter(fits("a", "b")).select("a", "b")
    links = confirmed(scratch.save(likely, "hubs"), "links")
    parts = components(links, scratch, "cc-hubs")

    def joined(pairs: DataFrame, name: str) -> DataFrame:
        """The components with what the pairs add."""
        nonlocal links
        if not pairs.head(1):
            return parts
        more = confirmed(pairs, f"links-{name}")
        if not more.head(1):
            return parts
        links = links.unionByName(more)
        return components(links, scratch, f"cc-{name}")

    pairs, rest = crossing(buckets.select("bucket", "digest"), parts, "near", FEW)
    parts = joined(pairs, "near")
    many = scratch.save(rest.select("digest").distinct(), "many")
    if many.head(1):
        own = scratch.save(sets.join(many, "digest").select("digest", "s"), "own")
        often = scratch.save(own.select("s").mapInArrow(_shingles, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("df")).filter(F.col("df") > COMMON), "often")
        # Which shingles count as common only moves work: as many are broadcast as are bounded.
        least = COMMON
        while often.filter(F.col("df") > least).count() > BROADCAST_ROWS:
            least *= 2
        common = often.filter(F.col("df") > least).toPandas()
        shared = docs.sparkSession.sparkContext.broadcast((common["bucket"].to_numpy(np.int64), common["df"].to_numpy(np.int64)))
        rare = scratch.save(own.mapInArrow(_rarest(shared, percent), "digest binary, buckets array<long>"), "rare").select("digest", F.explode("buckets").alias("bucket"))
        pairs, rest = crossing(rare, parts, "rare", AS_MANY)
        parts = joined(pairs, "rare")
        still = scratch.save(rest.select("digest").distinct(), "still")
        if still.head(1):
            wide = scratch.save(sets.join(still, "digest").select("digest", "s").mapInArrow(_wide(percent), "digest binary, buckets array<long>"), "wide").select("digest", F.explode("buckets").alias("bucket"))
            parts = joined(crossing(wide, parts, "wide", None)[0], "wide")
    placed = classes.select("digest", "rep.doc_id").join(parts.select(F.col("id").alias("digest"), "component"), "digest", "left").select("digest", "doc_id", F.coalesce("component", "digest").alias("component"))
    least = placed.groupBy("component").agg(F.min(F.struct("doc_id")).alias("least"))
    named = scratch.save(placed.join(least, "component").select("digest", F.col("component").alias("class"), F.col("least.doc_id").alias("component_id")), "named")
    scratch.free("classes", "shared", "buckets", "central", "hub", "wanted", "sets", "sketches", "hubs", "many", "own", "often", "rare", "still", "wide", *(f"{x}-{y}" for x in ("near", "rare", "wide") for y in ("placed", "buckets", "open", "pairs")))
    own = ["doc_id", "h", "n_shingles"]
    worded = signed.filter("digest is not null").select(*own, "digest").join(named, "digest").select(*own, "class", "component_id")
    out = worded.unionByName(signed.filter("digest is null").select(*own, F.lit(None).cast("binary").alias("class"), F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def groups(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    return decide(docs, percent, size).select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """The rows of docs without near copies: of each group the row with the least id (of its texts the one with the least hash, of repeated rows one). Rows without words stay. Only what goes, and what is repeated, is joined to the rows."""
    scratch = Scratch(docs.sparkSession, "dedup")
    key = fresh("__quern_row", docs.columns)
    decided = scratch.save(decide(docs, percent, size).filter("class is not null").groupBy("class", "doc_id", "h", "kept").agg(F.count("*").alias("times")), "decided")
    chosen = scratch.save(decided.filter("kept").groupBy("class").agg(F.min("h").alias("least")), "chosen")
    kept = decided.join(chosen, "class", "left").withColumn("stays", F.col("kept") & (F.col("h") == F.col("least")))
    gone = scratch.save(kept.filter("not stays").select(F.struct("doc_id", "h").alias(key)), "gone")
    again = scratch.save(kept.filter("stays and times > 1").select(F.struct("doc_id", "h").alias(key)), "again")
    text = F.col("text").cast("string")
    rows = docs.withColumn(key, F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h")))
    # A struct is null-safe: its fields' nulls are equal.
    out = rows.join(small(gone, gone.count()), key, "left_anti")
    n = again.count()
    if n:
        repeated = out.join(small(again, n), key, "left_semi").dropDuplicates([key])
        out = out.join(small(again, n), key, "left_anti").unionByName(repeated)
    return out.drop(key)
