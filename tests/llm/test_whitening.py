"""Whitening against exact fractions and a dense decomposition; residues against whole numbers."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from kwforge.llm import whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, n int, x string, component string"


def brute_force(rows, components=16):
    """{id: [(component, n, deviation, whitened up to its sign, explained)]} by fractions and numpy."""
    usable = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = [list(x) for x in {tuple(x) for _, x in usable}]
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    y = np.array([[float(Fraction(n * x[j] - s[j], n)) for j in range(d)] for x in fit])
    e, a = np.linalg.eigh(y.T @ y / n)
    e, a = e[::-1], a[:, ::-1]
    k = min(components, int((e > 1e-12 * e[0]).sum()))
    return {i: [(c + 1, n, sum((n * x[j] - s[j]) ** 2 for j in range(d)), sum((x[j] - s[j] / n) * a[j, c] for j in range(d)) / math.sqrt(e[c]), e[c] / e.sum()) for c in range(k)] for i, x in usable}


def same(got, want):
    by, sign = {}, {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert set(by) == {i for i in want if want[i]}
    for i, rows in want.items():
        for c, n, dev, w, share in rows:
            r = by[i][c]
            assert (r.n, r.deviation) == (n, dev) and abs(r.explained - share) <= 1e-8 * share and r.identity_error < 1e-8
            if abs(w) > 1e-3:
                assert sign.setdefault(c, r.whitened * w > 0) == (r.whitened * w > 0)  # one sign a component
            assert abs(abs(r.whitened) - abs(w)) < 1e-5


def test_op11(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = whitening.op11_whitening(spark, SF).collect()
    same(got, brute_force(rows))
    assert len(got) == 16 * len(rows)


def test_op11_awkward(spark):
    """Nulls, non-finite entries, copies, a constant dimension, far apart scales, clashing columns."""
    g = np.random.default_rng(7)
    x = g.normal(size=(90, 5)) * np.array([40, 9, 0.5, 2, 0]) + np.array([0, 1e4, -3, 0, 0.5])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200 + i, x[3].tolist()) for i in range(50)]
    bad = [(300, None), (301, [1.0, None, 2.0, 3.0, 4.0]), (302, [float("nan")] * 5), (303, [1.0, 2.0, float("inf"), 0.0, 0.0]), (304, [])]
    df = spark.createDataFrame([(i, v, 1, "x", "c") for i, v in rows + bad], SCHEMA).repartition(3)
    got = whitening.whiten(df).collect()
    same(got, brute_force(rows))
    assert {r.n for r in got} == {90} and {r.component for r in got} == {1, 2, 3, 4}
    assert whitening.whiten(df.filter("vec_id = 3 or vec_id >= 200")).count() == 0  # all alike: nothing to whiten
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.filter("vec_id >= 300")).count() == 0
    two = whitening.whiten(df.unionByName(df.filter("vec_id < 300").withColumn("vec_id", F.col("vec_id") + 1000).withColumn("embedding", F.slice("embedding", 1, 2)))).collect()
    same([r for r in two if r.vec_id < 1000], brute_force(rows))  # each length by its own fit list
    same([r for r in two if r.vec_id >= 1000], brute_force([(i + 1000, v[:2]) for i, v in rows]))


@pytest.mark.parametrize("size", [1.0, 1e9, 1e13])
def test_op11_residues(spark, size, monkeypatch):
    """The scatter is exact at any size, over many blocks and tasks; deviations beyond a long are null."""
    monkeypatch.setattr(whitening, "BLOCK", 8)
    g = np.random.default_rng(5)
    x = g.normal(size=(60, 3)) * size
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    distinct = whitening.whole_numbers(df, "vec_id", "embedding").select("x").distinct()
    sums = whitening.column_sums(distinct)
    whole = [[math.floor(64 * c) + 1_000_000 for c in v] for v in x.tolist()]
    n, s, largest = sums[3]
    y = [[n * c - t for c, t in zip(v, s)] for v in whole]
    assert n == 60 and s == [sum(v[j] for v in whole) for j in range(3)] and largest >= max(abs(c) for v in y for c in v)
    assert whitening.scatter(distinct, sums)[3] == [[sum(v[i] * v[j] for v in y) for j in range(3)] for i in range(3)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(df).collect()}
    want = [sum(c * c for c in v) for v in y]
    assert got == {i: w if w < 1 << 63 else None for i, w in enumerate(want)}


def test_op11_primes():
    ps = whitening.primes_for(10**30)
    assert len(set(ps)) == len(ps) and math.prod(ps) > 2 * 10**30 and max(ps) < 1 << 20 and whitening.BLOCK * (max(ps) // 2) ** 2 < 1 << 53
