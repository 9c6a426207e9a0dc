"""Whole-node 2-means, the learned split, the sparse decomposition and exact medians against plain Python and numpy."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from kwforge import queries
from kwforge.functions import medians
from kwforge.functions.cost import BOTH, CostModel
from kwforge.operators.search import contains_all
from kwforge.plans import build, learn, lloyd, svd

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def objects():
    g = random.Random(12)
    out = {i: {f"{'ab'[i % 2]}{g.randint(0, 8)}" for _ in range(g.randint(2, 7))} | {"all"} for i in range(40)}
    return out | {40: {"alone"}, 41: set(out[3]), 42: {"all"}}


def pairs(spark, objects):
    return spark.createDataFrame([(i, k) for i, s in objects.items() for k in sorted(s)], "obj_id long, kw string")


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_two_means(spark, objects, metric):
    """Round by round against the same rounds over dense vectors."""
    kws = sorted(set().union(*objects.values()))
    x = np.array([[k in objects[i] for k in kws] for i in sorted(objects)], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = np.array([x[0], x[np.lexsort((np.arange(len(x)), np.round(x @ x[0], 9)))[0]]])
    want, was = [], None
    for _ in range(20):
        near = np.round(x @ c.T - (0.5 * (c * c).sum(1) if metric == "euclidean" else 0), 9)
        side = (near[:, 1] > near[:, 0]).astype(int)
        bits = sum(w * o + 32 * w + 32 * o for o, w in ((int((side == s).sum()), int((x[side == s] > 0).any(0).sum())) for s in (0, 1)))
        moved = len(x) if was is None else int((side != was).sum())
        want.append((bits, moved))
        was = side
        if not moved:
            break
        c = np.array([x[side == s].mean(0) for s in (0, 1)])
        c = c / np.linalg.norm(c, axis=1)[:, None] if metric == "cosine" else c
    sides, history = lloyd.two_means(pairs(spark, objects), metric=metric)
    assert [h[1:] for h in history] == want
    assert {r.obj_id: r.side for r in sides.collect()} == dict(zip(sorted(objects), was.tolist()))


def test_two_means_edges(spark):
    """Equal objects: no side stays empty; one object; none."""
    sides, history = lloyd.two_means(pairs(spark, {i: {"a", "b"} for i in range(3)}), 3)
    assert sorted(r.side for r in sides.collect()) == [0, 0, 1] and not math.isnan(history[-1][1])
    sides, history = lloyd.two_means(pairs(spark, {5: {"a"}}), 3)
    assert sides.count() == 1 and math.isnan(history[0][1])
    assert lloyd.two_means(pairs(spark, {}).limit(0), 3)[1] == []


def dense_cost(w, objects, queries, results, model, tau=1.0, balance=1e-2, entropy=1e-3, f=None):
    """The objective for weights w, straight from its definition."""
    kws = sorted(set().union(*objects.values()))
    pi = {i: 1 / (1 + math.exp(-sum(w[f[k]] for k in s) / math.sqrt(len(s)))) for i, s in objects.items()}
    total, o_l = 0.0, sum(pi.values())
    for left in (True, False):
        p = {i: v if left else 1 - v for i, v in pi.items()}
        o = sum(p.values())
        gate = {k: min(1 - math.exp(-sum(p[i] for i, s in objects.items() if k in s) / tau), 1 - 1e-6) for k in kws}
        omega = sum(gate.values())
        mass = {q: math.exp(sum(math.log(gate.get(k, 0.0) + 1e-9) for k in s)) for q, s in queries.items()}
        ns = sum(m * (model.epsilon + model.alpha * len(queries[q]) * o + model.beta * o + model.gamma * results.get(q, 0)) for q, m in mass.items())
        total += model.storage_weight * (omega * o + 32 * omega + 32 * o) + model.query_weight * ns
    n = len(pi)
    h = sum(-(p * math.log(p) + (1 - p) * math.log(1 - p)) for p in pi.values()) / n
    return total + balance * (o_l / n - 0.5) ** 2 - entropy * h


def test_gradient(spark, objects):
    """Cost and every entry of the gradient against differences of the definition; known hashes."""
    qs = {1: {"all", "a1"}, 2: {"b2", "b3"}, 3: {"a1", "none"}, 4: {"all"}}
    o, model = pairs(spark, objects), CostModel(query_weight=1.0, beta=0.01)
    q = spark.createDataFrame([(i, k) for i, s in qs.items() for k in s], "query_id long, kw string")
    results = {i: n for i in qs if (n := sum(qs[i] <= s for s in objects.values()))}
    r = spark.createDataFrame(list(results.items()), "query_id long, r long")
    hashed = learn.hashed(o, 16)
    f = {x.kw: x.f for x in hashed.select("kw", "f").distinct().collect()}
    w = {x.f: x.w for x in learn.first_weights(spark, 16).collect()}
    _, whole, gradient = learn.step(hashed, q, r, learn.first_weights(spark, 16), model)
    want = dense_cost(w, objects, qs, results, model, f=f)
    assert abs(whole.first()["cost"] - want) < 1e-9 * want
    got = {x.f: x.g for x in gradient.collect()}
    for b in w:
        up, down = ({**w, b: w[b] + s} for s in (1e-5, -1e-5))
        slope = (dense_cost(up, objects, qs, results, model, f=f) - dense_cost(down, objects, qs, results, model, f=f)) / 2e-5
        assert abs(got.get(b, 0.0) - slope) < 1e-3 + 1e-5 * abs(slope)


def test_learned_split(spark, objects):
    """The soft cost falls with every step that is kept, and the split is cheaper than no split."""
    o = pairs(spark, {i: s for i, s in objects.items() if i < 40})
    q = spark.createDataFrame([(1, "all"), (2, "a1")], "query_id long, kw string")
    r = contains_all(o, q).groupBy("query_id").agg(F.count("*").alias("r"))
    sides, history = learn.learn_split(o, q, r, CostModel(), steps=6, features=64)
    soft = [c for c, _ in history]
    assert len(soft) > 2 and all(b < a for a, b in zip(soft, soft[1:]))
    assert {x.side for x in sides.collect()} <= {1, 2} and sides.count() == 40
    assert history[-1][1] <= history[0][1]
    assert BOTH.query_weight == 1.0


def dense(df):
    rows = [tuple(r) for r in df.collect()]
    ids, kws = sorted({i for i, _ in rows}), sorted({w for _, w in rows})
    at, col = {i: n for n, i in enumerate(ids)}, {w: n for n, w in enumerate(kws)}
    x = np.zeros((len(ids), len(kws)))
    x[[at[i] for i, _ in rows], [col[w] for _, w in rows]] = 1
    return ids, np.linalg.svd(x, full_matrices=False)


def test_svd(spark, objects):
    """Singular values, coordinates and axes of a small matrix against a dense decomposition."""
    df = pairs(spark, objects)
    _, (u, s, vt) = dense(df)
    values, coords, axes = svd.truncated_svd(df, 2)
    assert np.allclose(values, s[:2], rtol=1e-8)
    assert np.allclose(np.abs([r.x for r in coords.orderBy("obj_id").collect()]), np.abs(u[:, :2] * s[:2]), atol=1e-4 * s[0])
    v = np.array([r.v for r in axes.orderBy("kw").collect()])
    assert np.allclose(np.abs((v * vt[:2].T).sum(0)), 1, atol=1e-6)
    assert svd.truncated_svd(pairs(spark, {1: {"a"}, 2: {"a"}}), 2)[0] == [pytest.approx(math.sqrt(2))]


@pytest.mark.parametrize("frequent", [0, 1, 4])
def test_svd_of_rare_keywords(spark, objects, frequent):
    """The same where only few keywords, or none, count as frequent and the others are joined."""
    df = pairs(spark, objects)
    _, (u, s, vt) = dense(df)
    values, coords, axes = svd.truncated_svd(df, 2, frequent=frequent)
    assert np.allclose(values, s[:2], rtol=1e-8)
    assert np.allclose(np.abs([r.x for r in coords.orderBy("obj_id").collect()]), np.abs(u[:, :2] * s[:2]), atol=1e-4 * s[0])
    v = np.array([r.v for r in axes.orderBy("kw").collect()])
    assert np.allclose(np.abs((v * vt[:2].T).sum(0)), 1, atol=1e-6)


def test_svd_shuffles_rare_pairs_alone(spark, objects):
    """The rows that power steps hand on by shuffles are bounded by tasks and frequent keywords, not by pairs."""
    df = pairs(spark, objects)
    all_ = [(r.obj_id, r.kw) for r in df.collect()]
    many = spark.createDataFrame([(i + 100 * copy, kw) for copy in range(50) for i, kw in all_], "obj_id long, kw string")
    words = svd._frequent(many, 1 << 10)
    ids = many.join(words, "kw").groupBy("obj_id").agg(F.collect_list("id").alias("ids")).select("obj_id", "ids", F.lit(None).cast("array<double>").alias("r"))
    rows = svd._rows(ids.coalesce(2), np.ones((words.count(), 3)), np.eye(3), keep=False)
    assert rows.count() <= 2 * (words.count() + 3) < many.count()


def test_svd_query(spark):
    ids, (u, s, _) = dense(queries._ow(spark, SF))
    rows = queries.keyword_svd(spark, SF).orderBy("obj_id").collect()
    assert [r.obj_id for r in rows] == ids and np.allclose([rows[0].singular0, rows[0].singular1], s[:2], rtol=1e-4)
    assert np.allclose(np.abs([r.x0 for r in rows]), np.abs(u[:, 0] * s[0]), atol=1e-3 * s[0])


def test_medians(spark):
    """Groups of any size and kind, in many ranges; one group with most of the rows, one of a single repeated value."""
    g = random.Random(2)
    rows = [("big", g.randint(0, 50) / 4) for _ in range(3000)] + [("same", 7.0)] * 500 + [("two", 1.0), ("two", 4.0), (None, 3.0), ("none", None)] + [(f"g{i}", float(j)) for i in range(5) for j in range(i + 1)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, []).append(v)
    for parts in (None, 9):
        got = {r.k: (r.n, r.low, r.high) for r in medians.middle_pair(df, ["k"], "v", parts).collect()}
        assert got == {k: (len(v), statistics.median_low(v), statistics.median_high(v)) for k, v in want.items()}
    assert medians.middle_pair(df.limit(0), ["k"], "v").count() == 0


def test_build_from_several_nodes(spark, objects):
    """A build that starts from two nodes splits each by itself and numbers on from it."""
    o = pairs(spark, {i: s for i, s in objects.items() if i < 40})
    start = o.select("obj_id").distinct().withColumn("node", F.when(F.col("obj_id") < 20, F.lit(4)).otherwise(F.lit(7)).cast("long"))
    leaves, edges = build.build(o, spark.createDataFrame([(1, "all")], "query_id long, kw string"), CostModel(), min_objects=4, max_depth=1, gain=-1e9, start=start)
    assert set(edges) == {(4, 0, 8), (4, 1, 9), (7, 0, 14), (7, 1, 15)}
    assert all((r.leaf_id >> 1) == (4 if r.obj_id < 20 else 7) for r in leaves.collect())
