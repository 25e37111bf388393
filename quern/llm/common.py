"""What the operators share: scratch tables, text chunks, folds and word splitting."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once.
CHUNK_BYTES = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lower-cases A-Z and turns the other ASCII bytes that are not in [0-9a-z] into spaces.
_ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: As _ALNUM, but digits are spaces too.
_ALPHA = bytes(32 if 48 <= c <= 57 else c for c in _ALNUM)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, columns: list[str]) -> str:
    """The name, or a longer one that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: Column | str, m: int) -> Column:
    """crc32 of the id as text, modulo m; -1 for a null id, which is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % m, F.lit(-1))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; where none is configured, a local one of our own on a local master, and an error on a cluster, whose machines share no local folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        found = f"file://{tempfile.mkdtemp(prefix='quern-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        import atexit

        atexit.register(shutil.rmtree, found[7:], True)
    return found


class Scratch:
    """Tables of one run in the shared folder. They cut lineage: a lost executor costs a reread, not a rerun."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.options(**({"compression": "zstd"} | options)).mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def free(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def sub_batches(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` bytes of text each (or one row), so that memory doesn't grow with row counts."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(np.nan_to_num(np.asarray(pc.binary_length(sizes).to_numpy(zero_copy_only=False), dtype=float)))
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0.0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()]


def space_words(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. bytes.split() splits at just these bytes."""
    return text.translate(_LOWER).split()


def alnum_words(text: bytes) -> list[bytes]:
    """Words of 0-9, a-z and non-ASCII characters, with A-Z lower-cased."""
    return text.translate(_ALNUM).split()


def alpha_words(text: bytes) -> list[bytes]:
    """As alnum_words, without digits."""
    return text.translate(_ALPHA).split()


def stratified(df: DataFrame, by: str, key: str, cap: int, seed: str) -> DataFrame:
    """A bounded sample: of each value of `by`, about `cap` rows at most, the same rows on every run.

    A row is kept if a hash of its key is under cap / (rows of its value); no sort and no shuffle of the rows. The number of values is that of classes, which callers keep small."""
    counts = df.groupBy(by).count().collect()
    keep = F.lit(False)
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    for r in counts:
        keep = keep | (F.col(by).eqNullSafe(F.lit(r[by])) & (u < F.lit(min(1.0, cap / r["count"]))))
    return df.filter(keep)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def adam(grad, w: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Minimises by Adam with full gradients and a falling rate; for small models on the driver."""
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w
