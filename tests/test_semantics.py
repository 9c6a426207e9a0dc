"""Goldens, invariants and edge cases of search, routing, the tree and the cost model."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kwforge.functions.cost import BOTH, CostModel
from kwforge.operators import bitmaps, graph, keywords, routing, search
from kwforge.plans import build, calibrate, dp, tree
from kwforge.sources import readers, shared, writers
from kwforge.streaming import updates


def pairs(spark, sets, name):
    rows = [(i, k) for i, s in sets.items() for k in s]
    return spark.createDataFrame(rows, f"{name} long, kw string")


@pytest.fixture(scope="module")
def random_sets():
    g = random.Random(5)
    words = [f"w{i}" for i in range(14)]
    objects = {i: set(g.sample(words, g.randint(1, 9))) for i in range(70)}
    queries = {i: set(g.sample(words + ["zz"], g.randint(1, 4))) for i in range(30)}
    return objects, queries


def test_search_forms_agree(spark, random_sets):
    objects, queries = random_sets
    want = {(q, o) for q, qs in queries.items() for o, os in objects.items() if qs <= os}
    o, q = pairs(spark, objects, "obj_id"), pairs(spark, queries, "query_id")
    flat = {tuple(r) for r in search.contains_all(o, q).collect()}
    words = bitmaps.intersect(bitmaps.encode(o, ["kw"], "obj_id"), q)
    bits = {(r[0], r[1]) for r in bitmaps.decode(words, ["query_id"]).collect()}
    assert flat == bits == want
    for leaf in (F.col("obj_id") % 3, F.pmod(F.hash("obj_id"), F.lit(5))):
        assert {tuple(r) for r in tree.search(o, leaf.cast("long"), q).collect()} == want
    dropped = {(i, o) for i, qs in queries.items() for o, os in objects.items() if qs - {"zz"} and qs - {"zz"} <= os}
    assert {tuple(r) for r in search.contains_all(o, q, unknown="drop").collect()} == dropped
    some = {(i, o) for i, qs in queries.items() for o, os in objects.items() if qs & os}
    assert {tuple(r) for r in search.contains_any(o, q).collect()} == some


def test_empty_tables(spark):
    none_o, none_q = pairs(spark, {}, "obj_id"), pairs(spark, {}, "query_id")
    assert search.contains_all(none_o, none_q).count() == 0
    assert keywords.vocabulary(none_o).count() == 0


def test_routing(spark):
    objects = pairs(spark, {1: "ab", 2: "bc"}, "obj_id")
    bits = routing.side_bits(objects, F.col("obj_id"))
    assert {tuple(r) for r in bits.collect()} == {("a", 1), ("b", 3), ("c", 2)}
    q = pairs(spark, {1: ["a"], 2: ["b"], 3: ["b", "c"], 4: ["a", "c"], 5: ["z"]}, "query_id")
    assert {tuple(r) for r in routing.route(q, bits).collect()} == {(1, 1), (2, 3), (3, 2)}
    assert {tuple(r) for r in routing.route(q, bits, drop_if_neither=False).collect()} == {(1, 1), (2, 3), (3, 2), (4, 3), (5, 3)}


def test_costs(spark):
    row = spark.range(1).select(
        BOTH.storage(F.lit(3), F.lit(5)), BOTH.query(F.lit(100), F.lit(2), F.lit(10)), BOTH.query(F.lit(100), F.lit(0), F.lit(10)),
        BOTH.node(F.lit(3), F.lit(5), F.lit(0), F.lit(0), F.lit(0)),
    ).first()
    assert row[0] == 271 and abs(row[1] - 408.26) < 1e-9 and row[2] == 0 and row[3] == 0


NODES = "node_id long, depth int, omega long, queries long, sum_len long, cost double"


def test_broken_nodes(spark):
    """A binary tree in which the inner node pays to be broken."""
    rows = [(1, 0, 4, 0, 0, 0.0), (2, 1, 3, 0, 0, 0.0), (3, 1, 1, 0, 0, 10.0), (4, 2, 1, 0, 0, 10.0), (5, 2, 1, 0, 0, 10.0)]
    edges = build.edge_table(spark, [(1, 0, 2), (1, 1, 3), (2, 0, 4), (2, 1, 5)])
    solved = dp.solve(spark.createDataFrame(rows, NODES), edges, CostModel())
    got = {(r.node_id, r.k): (r.cost, r.l, r.r) for r in solved.collect()}
    assert got[2, 1][0] == 186 and got[2, 2] == (20, 1, 1)
    assert got[1, 1] == (266, 2, 1) and got[1, 2] == (196, 1, 1) and got[1, 3] == (30, 2, 1)
    assert {tuple(r) for r in dp.materialize(solved, edges, 1).collect()} == {(1, 0, 4), (1, 1, 5), (1, 2, 3)}


def test_node_removal_is_optimal(spark):
    """Random trees with a query weight, against the recurrence over all (l, r) and a recount over the thinned tree."""
    g = random.Random(8)
    model = CostModel(query_weight=1.0)
    for _ in range(2):
        rows, edges, todo, fresh = [], [], [(1, 0)], 2
        while todo:
            n, depth = todo.pop()
            rows.append((n, depth, g.randint(1, 40), g.randint(0, 50), g.randint(0, 90), float(g.randint(0, 9000))))
            if depth < 4 and (depth < 2 or g.random() < 0.6):
                edges += [(n, 0, fresh), (n, 1, fresh + 1)]
                todo += [(fresh, depth + 1), (fresh + 1, depth + 1)]
                fresh += 2
        kids = {}
        for parent, _pos, child in edges:
            kids.setdefault(parent, []).append(child)
        by = {r[0]: r for r in rows}

        def best(n):
            _, _, omega, queries, sum_len, cost = by[n]
            if n not in kids:
                return {1: (cost, queries)}
            (a, b), out = (best(c) for c in kids[n]), {}
            for x, (ca, va) in sorted(a.items()):
                for y, (cb, vb) in sorted(b.items()):
                    k = x + y
                    kept = omega * k + 32 * omega + 32 * k + model.epsilon * queries + model.alpha * sum_len * k + model.beta * k + model.gamma * (va + vb)
                    if ca + cb < out.get(k, (1e99,))[0]:
                        out[k] = ca + cb, va + vb
                    if ca + cb + kept < out.get(1, (1e99,))[0]:
                        out[1] = ca + cb + kept, queries
            return out

        nodes, table = spark.createDataFrame(rows, NODES), build.edge_table(spark, edges)
        solved = dp.solve(nodes, table, model)
        got = {r.k: (round(r.cost, 6), r.visits) for r in solved.filter("node_id = 1").collect()}
        assert got == {k: (round(c, 6), v) for k, (c, v) in best(1).items()}
        thinned = dp.materialize(solved, table, 1)
        assert abs(tree.cost_of(nodes, thinned, model).first()["cost"] - got[1][0]) < 1e-5
        assert {r.child for r in thinned.collect()} >= {n for n in by if n not in kids}


def test_wide_fanout_masks(spark):
    edges = spark.createDataFrame([(100, i, i) for i in range(40)], "parent long, child_pos int, child long")
    node_kw = spark.createDataFrame([(i, "k") for i in (0, 33)], "node_id long, kw string")
    assert {tuple(r) for r in tree.child_masks(edges, node_kw).collect()} == {(100, "k", 0, 1), (100, "k", 1, 2)}
    q = pairs(spark, {1: ["k"]}, "query_id")
    seen = tree.descend(edges, tree.child_masks(edges, node_kw), q, 100, 1)
    assert {r.node_id for r in seen.collect()} == {100, 0, 33}


def test_build_keeps_answers(spark, random_sets):
    objects = {i: ({f"x{i % 7}", f"x{i % 5}", "left"} if i % 2 else {f"y{i % 7}", f"y{i % 5}", "right"}) for i in range(120)}
    o, q = pairs(spark, objects, "obj_id"), pairs(spark, {1: ["left", "x1"], 2: ["right", "y2"], 3: ["left"]}, "query_id")
    leaves, edges = build.build(o, q, CostModel(), sample=50, max_depth=3)
    assert edges and leaves.count() == 120 and leaves.select("leaf_id").distinct().count() == len(edges) // 2 + 1
    by_leaf = o.join(leaves, "obj_id").select("leaf_id", "kw").distinct()
    hits = search.contains_all(o, q)
    assert hits.join(leaves, "obj_id").join(tree.candidate_leaves(by_leaf, q), ["query_id", "leaf_id"], "left_anti").count() == 0


def test_controlled_data(spark):
    for n in (10, 300):
        m = min(200, n)
        assert calibrate.controlled_objects(spark, n).count() == 12 * n + m * (m + 1) // 2


def test_non_negative_fit(spark):
    rows = [(float(a), float(b), 5.0 + 2.0 * a) for a in range(5) for b in range(4)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    sums = calibrate.gram(df, {"one": F.lit(1.0), "a": F.col("a"), "b": F.col("b")}, F.col("y"))
    w = calibrate.fit_non_negative(sums, ["one", "a", "b"])
    assert abs(w["one"] - 5) < 1e-6 and abs(w["a"] - 2) < 1e-6 and abs(w["b"]) < 1e-6


def test_two_means():
    rows = [[0, 1], [0, 1, 2], [3, 4], [3, 4, 5], [0, 2], [4, 5]]
    for metric in ("cosine", "euclidean"):
        side, history = build.two_means(rows, 6, metric=metric)
        assert side.tolist() == [0, 0, 1, 1, 0, 1] and history[-1] == 2 * (3 * 3 + 32 * 3 + 32 * 3)
    side, _ = build.two_means([[0], [0], [0]], 1)
    assert 0 < side.sum() < 3  # no side is empty
    assert build.two_means([[0]], 1)[0].tolist() == [0] and np.isnan(build.two_means([[0]], 1)[1][0])


def test_cost_curves(spark):
    sample = spark.createDataFrame([(1, i, [f"x{i % 2}", f"y{i % 2}", f"z{i}"]) for i in range(12)], "node long, obj_id long, kws array<string>")
    got = build.cost_curves(sample).toPandas()
    assert set(got["metric"]) == {"cosine", "euclidean"} and got.groupby("metric")["bits"].last().eq(2 * (8 * 6 + 32 * 8 + 32 * 6)).all()


def test_batches(spark, random_sets):
    """As many batches as it takes change only what earlier batches change; one batch is the single-step choice."""
    objects, queries = random_sets
    seeds = [(i, k, 1 + i % 2) for i in range(10) for k in objects[i]]
    s = spark.createDataFrame(seeds, "obj_id long, kw string, side int")
    new, q = pairs(spark, {i: objects[i] for i in range(10, 70)}, "obj_id"), pairs(spark, queries, "query_id")
    model = CostModel()
    one = {r.obj_id: r.side for r in routing.assign_batches(s, q, new, model, batches=1).collect()}
    have = {x: {k for _, k, y in seeds if x == y} for x in (1, 2)}
    delta = lambda i, x: len(have[x]) + len(objects[i] - have[x]) * (5 + 33) + 32
    assert one == {i: 1 if delta(i, 1) <= delta(i, 2) else 2 for i in range(10, 70)}
    assert {r.obj_id for r in routing.assign_batches(s, q, new, model, batches=3).collect()} == set(range(10, 70))


def test_grid(spark):
    def want(start, end, n):
        xs = []
        for i in range(n):
            t = i / max(1, n - 1)
            v = int((1 - t) * start + t * end + 0.5)
            v = min(end, max(start, xs[-1] + 1 if xs and v == xs[-1] else v))
            xs.append(max(v, xs[-1]) if xs else v)
        return xs

    for case in ((0, 5, 10), (10, 1000, 7), (3, 3, 4), (7, 9, 1), (0, 3, 0)):
        assert [r.x for r in calibrate.linear_grid(spark, *case).orderBy("i").collect()] == want(*case)


def test_principal_axes(spark):
    g = np.random.default_rng(3)
    x = g.normal(size=(200, 5)) * np.array([5, 3, 1, 0.5, 0.1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [float("nan")] * 5)], "id long, v array<double>")
    axes, shares = calibrate.principal_axes(df, "v")
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs((axes * vt[:2]).sum(1)), 1) and np.allclose(shares, s[:2] ** 2 / (s**2).sum())
    got = {r.id: (r.x, r.y) for r in calibrate.project(df, "v", axes).collect()}
    assert np.allclose([got[i] for i in range(200)], x @ axes.T) and got[900] == (None, None)
    assert calibrate.principal_axes(df.filter("id > 899"), "v")[0].shape == (2, 0)


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x, y;y\n\n  z|x \n")
    (tmp_path / "b.jsonl").write_text('{"keywords": ["p", "q"]}\n{"text": "r s"}\n{"text": "[draft] hello"}\n{"keywords": null, "query": "t"}\n\n{"tokens": [" u ", ""], "text": "no"}\n')
    (tmp_path / "c.csv").write_text('k1,k2,k3\nnew york,big apple,\n"one cell, two",,\n,,\nx,y,x\n')
    (tmp_path / "d.csv").write_text("Title\n\n'kw1' kw2,kw3\nkw4\n")
    (tmp_path / "v.json").write_text('{"a": 0, "b": 1}')
    (tmp_path / "bad.jsonl").write_text('{"other": 1}\n')
    read = lambda name: [(r.line, sorted(r.kws)) for r in readers.read_keywords(spark, str(tmp_path / name)).orderBy("line").collect()]
    assert read("a.txt") == [(0, ["x", "y"]), (1, ["x", "z"])]
    assert read("b.jsonl") == [(0, ["p", "q"]), (1, ["r", "s"]), (2, ["[draft]", "hello"]), (3, ["t"]), (4, ["u"])]
    assert read("c.csv") == [(0, ["big apple", "new york"]), (1, ["cell", "one", "two"]), (2, ["x", "y"])]
    assert [(r.line, r.kws) for r in readers.token_lines(spark, str(tmp_path / "d.csv"), least=2).collect()] == [(0, ["kw1", "kw2", "kw3"])]
    assert {tuple(r) for r in readers.read_vocabulary(spark, str(tmp_path / "v.json")).collect()} == {("a", 0), ("b", 1)}
    with pytest.raises(Exception, match="none of the fields"):
        read("bad.jsonl")
    with pytest.raises(ValueError, match="no reader"):
        read("x.xls")


def test_line_numbers(spark, tmp_path):
    """Dense in file order, over several partitions of a folder of files."""
    spark.range(0, 1000, 1, 7).selectExpr("concat('w', id)").write.text(str(tmp_path / "many"))
    got = readers.from_lines(spark, str(tmp_path / "many")).collect()
    assert sorted(r.line for r in got) == list(range(1000))


def test_workload(spark, tmp_path):
    (tmp_path / "w.csv").write_text("Title\na b a\n\nzz\n b;zz \n")
    vocab = spark.createDataFrame([("a", 0), ("b", 1)], "kw string, kw_id long")
    q, n = readers.load_workload(spark, str(tmp_path / "w.csv"), vocab)
    assert sorted(tuple(r) for r in q.collect()) == [(0, 0, 0), (0, 1, 1), (0, 2, 0), (2, 0, 1)] and tuple(n.first()) == (3, 1, 6, 2)
    q, n = readers.load_workload(spark, str(tmp_path / "w.csv"), vocab, drop_unknown=False)
    assert (1, 0, -1) in {tuple(r) for r in q.collect()} and n.first()["skipped"] == 0
    q, _ = readers.load_workload(spark, str(tmp_path / "w.csv"), vocab, drop_empty=False)
    assert (1, None, None) in {tuple(r) for r in q.collect()}


def test_vocabulary_lookups(spark):
    vocab = spark.createDataFrame([("a", 0), ("b", 1)], "kw string, kw_id long")
    assert {tuple(r) for r in keywords.lookup(spark.createDataFrame([("a",), ("z",)], "kw string"), vocab).collect()} == {("a", 0, "a"), ("z", -1, "<UNK>")}
    assert {tuple(r) for r in keywords.tokens_of(spark.createDataFrame([(1,), (9,)], "kw_id long"), vocab).collect()} == {(1, "b"), (9, "<UNK>")}


def test_saved_tree(spark, tmp_path, random_sets):
    objects, queries = random_sets
    o, q = pairs(spark, objects, "obj_id"), pairs(spark, queries, "query_id")
    sided = o.withColumn("leaf_id", F.col("obj_id") % 4)
    edges = build.edge_table(spark, [(9, i, i) for i in range(4)])
    readers.save_tree(str(tmp_path / "t"), edges, sided, sided.select(F.col("leaf_id").alias("node_id"), "kw").distinct())
    e, leaves, node_kw = readers.load_tree(spark, str(tmp_path / "t"))
    assert e.count() == 4 and node_kw.exceptAll(sided.select("leaf_id", "kw").distinct()).count() == 0
    assert {tuple(r) for r in tree.search_leaves(leaves, q).collect()} == {(i, j) for i, qs in queries.items() for j, os in objects.items() if qs <= os}


def test_frequent_items_in_blocks(spark):
    sets = {i: {"all", f"g{i % 3}"} for i in range(40)}
    got = {(r.src, r.dst): (r.shared, r.n_src, r.n_dst) for r in graph.overlaps(pairs(spark, sets, "id"), "id", "kw", block=4).collect()}
    assert got == {(i, j): (len(sets[i] & sets[j]), 2, 2) for i in range(40) for j in range(i + 1, 40)}


def test_writers(spark, tmp_path):
    p = spark.createDataFrame([(1, "a b", 2, 3, 1500.0)], "query_id long, query_keywords string, query_keyword_count long, result_count long, pred_query_time_ns double")
    writers.write_predictions(str(tmp_path / "p"), p, spark.createDataFrame([(1, 2.5)], "n_queries long, avg double"))
    assert spark.read.csv(str(tmp_path / "p/query_predictions"), header=True).first()["pred_query_time_us"] == "1.5" and spark.read.json(str(tmp_path / "p/summary")).count() == 1
    points = spark.createDataFrame([("num_objects", 1, 2)], "plot_type string, x long, y long")
    writers.write_calibration(str(tmp_path / "c"), points, points)
    assert spark.read.csv(str(tmp_path / "c/mean_line"), header=True).first()["plot_type"] == "num_objects"


def test_cluster_needs_a_shared_folder(spark):
    class Other:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared.shared_dir(Other)


def test_update_stream(spark, tmp_path):
    rows = [(1, "a b", False, 1), (2, "c", False, 1), (1, "a", False, 2), (2, None, True, 3)]
    spark.createDataFrame(rows, updates.SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(updates.SCHEMA).parquet(str(tmp_path / "in"))
    updates.maintain(stream, str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
    assert [tuple(r) for r in updates.current(spark, str(tmp_path / "log")).collect()] == [(1, "a")]


def test_grown_leaves(spark):
    old, new = (spark.createDataFrame(x, "leaf_id long, cost double") for x in ([(1, 10.0), (2, 10.0)], [(1, 11.0), (2, 13.0), (3, 1.0)]))
    assert {r.leaf_id for r in updates.grown_leaves(old, new).collect()} == {2, 3}


def test_windowed_counts(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "b", 3.0)]
    spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("to_timestamp(ts) ts", "event_type", "value").write.parquet(str(tmp_path / "e"))
    stream = updates.windowed_counts(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "e")))
    stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {(r.event_type, r.n, r.total) for r in spark.table("windows").collect()} == {("a", 2, 3.0), ("b", 1, 3.0)}
