"""Embedding whitening: covariance by aggregates over the upper triangle, decomposed with LAPACK.

1. An entry c becomes the whole number x = floor(64 * c) + 1000000. The fit list is each distinct vector of these once, written, so that copies of a vector, however many, weigh as one; they are aggregated before they are shuffled.
2. One aggregation gives the number of vectors and each dimension's sum, as whole numbers. A second one sums the centred products of every pair of dimensions (i <= j), by generated SQL expressions; what comes to the driver is one row of d * (d + 1) / 2 sums, where d is the number of dimensions. Products are centred before they are multiplied, since x is large against its spread. Above PAIRS pairs the expressions are dealt to several aggregations over the same written table, as a plan has only so many.
3. The covariance (divisor n) is decomposed on the driver. Rows are projected in batches; the mean and the components, of a size that d bounds, go with the tasks. No row, and no list of rows, comes to the driver.
4. What whitening promises is measured, not assumed: the covariance of the whitened fit list is aggregated in the same way, and its largest distance from the identity is in every row.

Components are unit vectors, numbered from 1 by falling eigenvalue; the entry of the largest size is positive, so that they are the same on every run.

Edge cases: a row whose vector is null, empty, or holds a null, a NaN or an infinity is dropped. Where vectors differ in length, those of the most frequent length stay (the least of these at a tie) and the others are dropped. Entries whose x is beyond 2^53 can't be told apart as doubles; their rows are dropped too. A null id is kept; repeated rows are all returned, with equal values, but fitted once. A component without variance (an eigenvalue under LEAST of the largest: fewer vectors than dimensions, a dimension that never changes) has a null `whitened`, since nothing can be divided by it, and isn't part of the measured identity; `explained` is null where no component has variance. `deviation` is exact, and null where it is beyond 2^63 - 1. An empty table gives an empty result. Other columns are never read, so they may have any name.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Pairs of dimensions in one aggregation.
PAIRS = 4_000
#: Eigenvalues under this share of the largest count as none: the covariance isn't known any better in doubles.
LEAST = 1e-11
SCALE, SHIFT = 64, 1_000_000
ROWS = 4096
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(vector: Column) -> Column:
    """The vector's entries as x; null where an entry has none."""
    entries = F.transform(vector.cast("array<double>"), lambda c: F.floor(F.lit(float(SCALE)) * c))
    good = F.forall(vector.cast("array<double>"), lambda c: F.coalesce(F.abs(c) <= 2.0**46, F.lit(False)))  # false for NaN, which is above all numbers
    return F.when(good & (F.size(vector) > 0), F.transform(F.when(good, entries), lambda x: x + F.lit(SHIFT)))


def vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that stay."""
    found = rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding")).alias("x")).filter("x is not null")
    lengths = found.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").head(1)  # the most frequent of all lengths
    return found.filter(F.size("x") == (lengths[0]["d"] if lengths else 0))


def pair_sums(fit: DataFrame, dims: int, per_pass: int = PAIRS) -> np.ndarray:
    """fit: columns z0, z1, ... (doubles) -> the symmetric matrix of sum(z_i * z_j): an expression for each pair, in one aggregation (several above per_pass pairs)."""
    pairs, out = list(combinations_with_replacement(range(dims), 2)), np.zeros((dims, dims))
    for k in range(0, len(pairs), per_pass):
        some = pairs[k : k + per_pass]
        sums = fit.selectExpr(*(f"sum(z{i} * z{j}) AS s{i}_{j}" for i, j in some)).first()
        for (i, j), s in zip(some, sums, strict=True):
            out[i, j] = out[j, i] = s
    return out


class Whitening:
    """What was fitted: n, the exact sums S, the centre (its whole part and the rest), eigenvalues and components, the latter as columns."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray):
        self.n, self.sums, self.values, self.vectors = n, sums, values, vectors
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([float(Fraction(s, n) - s // n) for s in sums])
        self.sound = values > LEAST * max(values.max(initial=0.0), 0.0)
        total = values.sum()
        self.explained = values / total if total > 0 else np.full(len(values), np.nan)
        self.error = float("nan")

    def project(self, x: np.ndarray, most: int) -> np.ndarray:
        """Whitened values of rows x (whole numbers) for the first components; NaN where a component has no variance."""
        z = (x - self.base).astype(np.float64) - self.rest
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.sound, 1 / np.sqrt(np.where(self.sound, self.values, 1.0)), np.nan)[:most]
        return (z @ self.vectors[:, :most]) * scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum((n * x - S)^2), exact: in 64 bits where that is enough, else in Python's numbers."""
        widest = max((abs(self.n * int(v) - s) for col, s in zip(x.T, self.sums, strict=True) for v in (col.min(), col.max())), default=0)
        if widest**2 * x.shape[1] < 1 << 63 and self.n * int(np.abs(x).max()) < 1 << 63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        exact = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(1)
        return [v if v < 1 << 63 else None for v in exact.tolist()]


def fit(x: DataFrame, scratch: Scratch, most: int = 16, per_pass: int = PAIRS) -> Whitening | None:
    """x: rows with a column x, of one length -> the whitening of its distinct vectors; None without rows."""
    once = scratch.save(x.select("x").distinct(), "fit")
    first = once.head(1)
    if not first:
        return None
    dims = len(first[0]["x"])
    wide = once.select(*(F.col("x")[i].alias(f"x{i}") for i in range(dims)))
    n, *sums = map(int, wide.selectExpr("count(*) AS n", *(f"sum(CAST(x{i} AS DECIMAL(19, 0))) AS s{i}" for i in range(dims))).first())
    centre = [(s // n, float(Fraction(s, n) - s // n)) for s in sums]
    centred = wide.select(*(((F.col(f"x{i}") - F.lit(a)).cast("double") - F.lit(b)).alias(f"z{i}") for i, (a, b) in enumerate(centre)))
    values, columns = np.linalg.eigh(pair_sums(centred, dims, per_pass) / n)
    values, columns = np.maximum(values[::-1], 0.0), columns[:, ::-1]
    signs = np.sign(columns[np.abs(columns).argmax(0), np.arange(dims)])
    out = Whitening(n, sums, values, columns * signs)
    out.error = _error(once, out, min(most, int(out.sound.sum())))
    return out


def _error(once: DataFrame, model: Whitening, most: int) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity."""
    if not most:
        return float("nan")
    names = [f"w{k}" for k in range(most)]

    def run(batches):
        for b in batches:
            w = model.project(_matrix(b.column(0)), most)
            yield pa.RecordBatch.from_arrays([pa.array(w[:, k]) for k in range(most)], names=names)

    white = once.select("x").mapInArrow(run, ", ".join(f"{c} double" for c in names))
    means = white.agg(*(F.avg(c) for c in names)).first()
    sums = pair_sums(white.select(*((F.col(c) - F.lit(m)).alias(f"z{k}") for k, (c, m) in enumerate(zip(names, means, strict=True)))), most)
    return float(np.abs(sums / model.n - np.eye(most)).max())


def _matrix(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(len(column), -1)


def whiten(rows: DataFrame, most: int = 16) -> DataFrame:
    """Per row that stays and component up to `most`: vec_id, component, n, deviation, whitened, explained, identity_error."""
    scratch = Scratch(rows.sparkSession, "whitening")
    x = vectors(rows)
    model = fit(x, scratch, most)
    scratch.free("fit")
    if model is None:
        return rows.sparkSession.createDataFrame([], OUT)
    m = min(most, len(model.sums))

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                b = batch.slice(k, ROWS)
                v = _matrix(b.column(1))
                white, at = model.project(v, m), np.repeat(np.arange(len(v)), m)
                again = lambda values: pa.array(np.tile(values, len(v)), pa.float64(), from_pandas=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(v))), pa.array(np.full(len(at), model.n)), pa.array(model.deviations(v), pa.int64()).take(pa.array(at)),
                        pa.array(white.ravel(), pa.float64(), from_pandas=True), again(model.explained[:m]), again(np.full(m, model.error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return x.mapInArrow(run, OUT)
