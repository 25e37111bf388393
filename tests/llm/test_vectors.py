"""Whitening against a brute-force version."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import queries, whitening
from quern.llm.common import Scratch

from .conftest import SF

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, most=16):
    """Values by plain loops: {(vec_id, component): (n, deviation, whitened, explained)}; whitened up to its sign."""
    xs = [(i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in xs})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    mean = [Fraction(s, n) for s in sums]
    v = np.array([[float(sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(v)
    out = {}
    for i, x in xs:
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        z = np.array([float(a - m) for a, m in zip(x, mean, strict=True)])
        for k in range(min(most, d)):
            e = values[d - 1 - k]
            out.setdefault((i, k + 1), []).append((n, dev, float(z @ vectors[:, d - 1 - k]) / math.sqrt(e) if e > 1e-9 * values[-1] else None, e / values.sum() if values.sum() > 0 else None))
    return out


def same(got, want):
    assert sorted((r["vec_id"], r["component"]) for r in got) == sorted(k for k, v in want.items() for _ in v)
    signs = {}
    for r in got:
        n, dev, white, share = want[r["vec_id"], r["component"]][0]
        assert r["n"] == n and r["deviation"] == dev
        assert (r["explained"] is None) == (share is None) and (share is None or abs(r["explained"] - share) <= 1e-4 * share + 1e-12)
        assert (r["whitened"] is None) == (white is None)
        if white is not None and abs(white) > 1e-6:
            signs.setdefault(r["component"], set()).add(np.sign(white * r["whitened"]))
            assert abs(abs(r["whitened"]) - abs(white)) < 1e-6 * max(1, abs(white))
    assert all(len(s) == 1 for s in signs.values())


def test_query_is_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = queries.queries()["op11_whitening"](spark, SF).collect()
    want = brute(rows)
    same(got, want)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-6


def test_copies_weigh_once_and_bad_rows_go(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=6)]) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(200)] + [(None, rows[1][1]), (7, rows[2][1]), (300, None), (301, []), (302, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (303, [float("nan")] * 6), (304, [math.inf] + [0.0] * 5), (305, [-math.inf] * 6), (306, [1.0, 2.0]), (307, [3e38] * 6)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = whitening.whiten(df).collect()
    kept = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if i is None or i < 300]
    want = brute(kept)
    assert {r["n"] for r in got} == {40} and {r["component"] for r in got} == set(range(1, 7))
    assert sum(r["vec_id"] is None for r in got) == 6 and sum(r["vec_id"] == 7 for r in got) == 12
    same([r for r in got if r["vec_id"] not in (None, 7)], {k: v for k, v in want.items() if k[0] not in (None, 7)})


def test_large_numbers_far_from_zero(spark):
    """The mean is a million times the spread in x; entries of 1e9 are exact too, and a deviation beyond 64 bits is null."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(1e6 + 1000 * v)) for v in rng.normal(size=4)]) for i in range(300)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    same(got, brute(rows))
    assert got[0]["identity_error"] < 1e-4
    far = [(0, [-7e13, 1.0]), (1, [7e13, 2.0]), (2, [0.0, 5.0])]
    assert {r["deviation"] for r in whitening.whiten(spark.createDataFrame(far, "vec_id long, embedding array<double>")).collect() if r["vec_id"] != 2} == {None}
    wide = [(0, [-1e9, 1.0]), (1, [1e9, 2.0]), (2, [0.0, 5.0])]
    same([r for r in whitening.whiten(spark.createDataFrame(wide, "vec_id long, embedding array<double>"), 1).collect() if r["vec_id"] == 2], {k: v for k, v in brute(wide, 1).items() if k[0] == 2})


def test_no_variance(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect()
    assert len(one) == 4 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in one)
    rows = [(i, [float(i), 3.0, 2.0 * i]) for i in range(9)]  # one direction only
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["component"] for r in got if r["whitened"] is not None} == {1} and got[0]["identity_error"] < 1e-9
    assert abs(next(r["explained"] for r in got if r["component"] == 1) - 1) < 1e-9


def test_pairs_in_several_aggregations(spark):
    rng = np.random.default_rng(7)
    x = spark.createDataFrame([([int(v) for v in rng.integers(0, 1000, 5)],) for _ in range(50)], "x array<long>")
    once, many = (whitening.fit(x, Scratch(spark, "w"), per_pass=n) for n in (4000, 4))
    assert np.allclose(once.values, many.values, rtol=1e-12) and once.n == 50


def test_empty_and_clashing_columns(spark):
    empty = whitening.whiten(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(spark.createDataFrame([(1, None)], SCHEMA)).count() == 0
    named = spark.createDataFrame([(i, [float(i), float(i * i)]) for i in range(5)], SCHEMA).withColumns({c: F.lit("x") for c in ("x", "n", "z0", "component", "whitened")})
    assert whitening.whiten(named).count() == 10


def test_components_are_the_same_again(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    a, b = (sorted(map(tuple, whitening.whiten(d, 2).select("vec_id", "component", "whitened").collect())) for d in (df, df.repartition(7)))
    assert all(x[:2] == y[:2] and x[2] == pytest.approx(y[2], abs=1e-6) for x, y in zip(a, b, strict=True))
