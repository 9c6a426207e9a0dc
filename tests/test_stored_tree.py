"""The stored tree: pruned search, thinning of a built tree, blocks of the node removal."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from kwforge.functions.cost import CostModel
from kwforge.plans import build, dp, stored, tree


def pairs(spark, sets, name):
    return spark.createDataFrame([(i, k) for i, s in sets.items() for k in sorted(s)], f"{name} long, kw string")


@pytest.fixture(scope="module")
def collection(spark):
    """Four kinds of objects with words of their own, so that a tree over them has something to prune."""
    g = random.Random(11)
    objects = {i: {f"{'abcd'[i % 4]}{g.randint(0, 11)}" for _ in range(5)} | {"all", "abcd"[i % 4]} for i in range(160)}
    queries = {1: {"a", "all"}, 2: {"b", "b1"}, 3: {"a", "b"}, 4: {"all", "a2", "a3"}, 5: {"none"}, 6: {"a", "none"}, 7: {"b"}, 8: set()}
    return objects, queries


def hits(objects, queries):
    return {(q, o) for q, qs in queries.items() for o, os_ in objects.items() if qs and qs <= os_}


def test_search_opens_candidate_leaves_only(spark, tmp_path, collection):
    """With the folders of all other leaves spoilt the answers stay right, and the plan says why."""
    objects, queries = collection
    o, q = pairs(spark, objects, "obj_id"), pairs(spark, queries, "query_id")
    leaf_of = o.select("obj_id").distinct().withColumn("leaf_id", F.col("obj_id") % 4 + 4)
    edges = build.edge_table(spark, [(1, 0, 2), (1, 1, 3), (2, 0, 4), (2, 1, 5), (3, 0, 6), (3, 1, 7)])
    path = str(tmp_path / "t")
    stored.save(path, edges, o, leaf_of)
    for table in ("leaves", "leaf_kw"):
        for leaf in (6, 7):  # the objects of kinds c and d, which no query asks for
            files = glob.glob(f"{path}/{table}/leaf_id={leaf}/*.parquet")
            assert files
            for f in files:
                os.chmod(f, 0o644)
                open(f, "wb").write(b"spoilt")
                crc = os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
                if os.path.exists(crc):
                    os.remove(crc)
    t = stored.load(spark, path)
    asked = {i: s for i, s in queries.items() if s != {"a", "b"} | {"all"}}
    got = stored.search(t, pairs(spark, {i: s for i, s in asked.items() if i != 1} | {1: {"a", "all"}}, "query_id"))
    assert {tuple(r) for r in got.collect()} == hits(objects, queries)
    with pytest.raises(Exception, match="(?i)parquet|spoilt|length"):
        t.leaves.count()
    plan = stored.held_pairs(t.leaves, stored.route(t, q))._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_wide_and_uneven_trees(spark, tmp_path, collection):
    """Forty leaves under one node, leaves at several depths, and a tree of one leaf."""
    objects, queries = collection
    o, q = pairs(spark, objects, "obj_id"), pairs(spark, queries, "query_id")
    ids = o.select("obj_id").distinct()
    shapes = [
        ([(1, i, 100 + i) for i in range(40)], F.col("obj_id") % 40 + 100),
        ([(1, 0, 2), (1, 1, 3), (3, 0, 6), (3, 1, 7), (7, 0, 14), (7, 1, 15)], F.element_at(F.array(*map(F.lit, (2, 6, 14, 15))), (F.col("obj_id") % 4 + 1).cast("int"))),
        ([], F.lit(1)),
    ]
    for n, (edges, leaf) in enumerate(shapes):
        stored.save(str(tmp_path / str(n)), build.edge_table(spark, edges), o, ids.withColumn("leaf_id", leaf.cast("long")))
        t = stored.load(spark, str(tmp_path / str(n)))
        assert {tuple(r) for r in stored.search(t, q).collect()} == hits(objects, queries)
        assert stored.search(t, q.limit(0)).count() == 0


def test_masks_in_one_shuffle(spark, collection):
    """Masks from paths are those that level by level gives."""
    o = pairs(spark, collection[0], "obj_id")
    edges = build.edge_table(spark, [(1, 0, 2), (1, 1, 3), (2, 0, 4), (2, 1, 5)])
    leaf_kw = o.select((F.element_at(F.array(*map(F.lit, (3, 4, 5))), (F.col("obj_id") % 3 + 1).cast("int"))).cast("long").alias("leaf_id"), "kw").distinct()
    want = tree.child_masks(edges, tree.subtree_keywords(edges, leaf_kw, 2))
    assert {tuple(r) for r in stored.masks_of(leaf_kw, edges).collect()} == {tuple(r) for r in want.collect()}


def test_built_thinned_searched(spark, tmp_path, collection):
    objects, queries = collection
    o, q = pairs(spark, objects, "obj_id"), pairs(spark, queries, "query_id")
    model = CostModel(zero_if_no_queries=False)
    leaves, rows = build.build(o, q, model, sample=60, max_depth=3, min_objects=8)
    edges = build.edge_table(spark, rows)
    nodes = build.node_table(leaves, o, q, model)
    # every node against a recount of its own objects
    leaf = {r.obj_id: r.leaf_id for r in leaves.collect()}
    for r in nodes.collect():
        under = [i for i, n in leaf.items() if any(n >> k == r.node_id for k in range(5))]
        kws = set().union(*(objects[i] for i in under))
        feasible = [s for s in queries.values() if s and s <= kws]
        assert (r.o, r.omega, r.queries, r.sum_len, r.depth) == (len(under), len(kws), len(feasible), sum(len(s) - 1 for s in feasible), r.node_id.bit_length() - 1)
        assert r.cost == len(kws) * len(under) + 32 * len(kws) + 32 * len(under)
    solved = dp.solve(nodes, edges, model)
    thin = dp.materialize(solved, edges, 1)
    claimed = solved.filter("node_id = 1 AND k = 1").first()["cost"]
    assert abs(tree.cost_of(nodes, thin, model).first()["cost"] - claimed) < 1e-6
    stored.save(str(tmp_path / "t"), thin, o, leaves)
    assert {tuple(r) for r in stored.search(stored.load(spark, str(tmp_path / "t")), q).collect()} == hits(objects, queries)


def test_node_removal_in_blocks(spark):
    """A root with thirty leaves on each side, in blocks of four branches: the same minima as in one block, and no key above a block pair."""
    g = random.Random(3)
    rows, edges = [], []

    def grow(n, leaves, depth):
        rows.append((n, depth, g.randint(1, 40), g.randint(0, 50), g.randint(0, 90), float(g.randint(0, 9000))))
        if leaves > 1:
            for i, part in enumerate((leaves // 2, leaves - leaves // 2)):
                edges.append((n, i, 2 * n + i))
                grow(2 * n + i, part, depth + 1)

    grow(1, 24, 0)
    nodes = spark.createDataFrame(rows, "node_id long, depth int, omega long, queries long, sum_len long, cost double")
    table, model = build.edge_table(spark, edges), CostModel(query_weight=1.0)
    key = lambda df: sorted((r.node_id, r.k, round(r.cost, 6), r.visits, r.l, r.r) for r in df.collect())
    small = dp.solve(nodes, table, model, block=4)
    assert key(small) == key(dp.solve(nodes, table, model))
    below = small.join(table, small.node_id == table.child).select("parent", "child_pos", "k", "cost", "visits")
    met = dp.block_pairs(below, nodes.select("node_id", "omega", "queries", "sum_len"), 4)
    assert met.groupBy("node_id", "lb", "rb").count().agg(F.max("count")).first()[0] <= 16
    n = {(r.parent, r.child_pos): r["count"] for r in below.groupBy("parent", "child_pos").count().collect()}
    assert met.filter("node_id = 1").count() == n[1, 0] * n[1, 1]
