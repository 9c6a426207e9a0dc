"""Which inner nodes of a binary tree to keep: dynamic programming over node tables, one join and one minimum a level.

A node's rows say, for every number k of branches that it may hand to its parent, the least cost of its subtree, how
often these branches are visited, and which numbers of its two children's branches that takes. A node that is broken
hands up its children's branches; a node that is kept hands up one. A node has at most as many rows as it has leaves
below it, so the pairs of its children's rows are quadratic in its leaves. The rows of both children are dealt into blocks
of numbers of branches, and each pair of blocks is a join key of its own: no key holds more than BLOCK^2 pairs, the root's
neither. The pairs are weighed where they meet, and their minimum by (node, k) is taken there first and then over blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwforge.functions.cost import CostModel
from kwforge.sources.shared import cut

#: Rows of a child in one block.
BLOCK = 256


def kept_cost(branches: Column, visits: Column, model: CostModel) -> Column:
    """Cost of a kept inner node (omega, queries, sum_len) with so many branches, which are visited so often."""
    c = F.col
    bits = c("omega") * branches + F.lit(32) * c("omega") + F.lit(32) * branches
    ns = F.lit(model.epsilon) * c("queries") + F.lit(model.alpha) * c("sum_len") * branches + F.lit(model.beta) * branches + F.lit(model.gamma) * visits
    return (F.lit(model.storage_weight) * bits + F.lit(model.query_weight) * ns).cast("double")


def block_pairs(below: DataFrame, level: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node_id, l, l_cost, l_visits, r, r_cost, r_visits, omega, queries, sum_len) of all rows of a node's two children.

    below: parent, child_pos (0 or 1), k, cost, visits. level: node_id, omega, queries, sum_len. A child's rows are copied to
    each block of the other child, and what the node itself has travels with the left rows.
    """
    last = lambda i: F.max(F.when(F.col("child_pos") == i, F.floor(F.col("k") / block))).alias(f"last{i}")
    dealt = below.join(below.groupBy("parent").agg(last(0), last(1)), "parent").join(level.withColumnRenamed("node_id", "parent"), "parent")

    def side(pos: int, k: str, blocks: tuple[str, str], *more: str) -> DataFrame:
        mine, others = F.floor(F.col("k") / block).alias(blocks[0]), F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"last{1 - pos}"))).alias(blocks[1])
        return dealt.filter(F.col("child_pos") == pos).select(F.col("parent").alias("node_id"), F.col("k").alias(k), F.col("cost").alias(f"{k}_cost"), F.col("visits").alias(f"{k}_visits"), mine, others, *more)

    return side(0, "l", ("lb", "rb"), "omega", "queries", "sum_len").join(side(1, "r", ("rb", "lb")), ["node_id", "lb", "rb"])


def solve(nodes: DataFrame, edges: DataFrame, model: CostModel, block: int = BLOCK) -> DataFrame:
    """(node_id, k, cost, visits, l, r) for every node: k branches at this cost, from l and r branches of its children.

    nodes: node_id, depth, omega, queries, sum_len, cost (of a leaf). edges: parent, child_pos (0 or 1), child. Ties go to
    the smaller l, then the smaller r. A leaf has one row, with l and r 0.
    """
    inner = nodes.join(edges.select(F.col("parent").alias("node_id")).distinct(), "node_id", "left_semi")
    leaves = nodes.join(inner.select("node_id"), "node_id", "left_anti")
    columns = ("node_id", "k", "cost", "visits", "l", "r")
    solved = leaves.select("node_id", F.lit(1).alias("k"), F.col("cost").cast("double").alias("cost"), F.col("queries").cast("long").alias("visits"), F.lit(0).alias("l"), F.lit(0).alias("r"))
    solved = cut(solved, "solved")
    depth = inner.agg(F.max("depth")).first()[0]
    while depth is not None and depth >= 0:
        level = inner.filter(F.col("depth") == depth).select("node_id", "omega", "queries", "sum_len")
        below = solved.join(edges, F.col("node_id") == F.col("child")).select("parent", "child_pos", "k", "cost", "visits")
        pairs = block_pairs(below, level, block)
        total, visits, branches = F.col("l_cost") + F.col("r_cost"), F.col("l_visits") + F.col("r_visits"), F.col("l") + F.col("r")
        broken = F.struct(total.alias("cost"), "l", "r", visits.alias("visits"), branches.alias("k"))
        kept = F.struct((total + kept_cost(branches, visits, model)).alias("cost"), "l", "r", F.col("queries").cast("long").alias("visits"), F.lit(1).alias("k"))
        ways = pairs.select("node_id", F.explode(F.array(broken, kept)).alias("w"))
        best = ways.groupBy("node_id", F.col("w.k").alias("k")).agg(F.min(F.struct("w.cost", "w.l", "w.r", "w.visits")).alias("b"))
        solved = solved.unionByName(cut(best.select("node_id", "k", "b.cost", "b.visits", "b.l", "b.r"), "solved"))
        depth -= 1
    return solved.select(*columns)


def materialize(solved: DataFrame, edges: DataFrame, root: int) -> DataFrame:
    """(parent, child_pos, child) of the tree in which the root is kept and every other node kept or broken as solved.

    Goes down level by level. A row of the front is a node with the number of branches that it hands up, the kept node
    above it, and its place among that node's branches.
    """
    spark = edges.sparkSession
    children = edges.groupBy("parent").agg(F.max(F.when(F.col("child_pos") == 0, F.col("child"))).alias("a"), F.max(F.when(F.col("child_pos") == 1, F.col("child"))).alias("b"))
    picks = solved.select("node_id", "k", "l", "r")
    front = spark.createDataFrame([(root, 1, None, 0)], "node_id long, k int, above long, place int")
    out = spark.createDataFrame([], "parent long, child_pos int, child long")
    while True:
        # a node that hands up one branch is kept (or a leaf) and hangs below; its own branches start anew
        out = out.unionByName(front.filter((F.col("k") == 1) & F.col("above").isNotNull()).select(F.col("above").alias("parent"), F.col("place").alias("child_pos"), F.col("node_id").alias("child")))
        down = front.join(picks, ["node_id", "k"]).join(children, F.col("node_id") == F.col("parent"))
        kept = F.col("k") == 1
        above, first = F.when(kept, F.col("node_id")).otherwise(F.col("above")), F.when(kept, F.lit(0)).otherwise(F.col("place"))
        each = F.array(
            F.struct(F.col("a").alias("node_id"), F.col("l").alias("k"), above.alias("above"), first.alias("place")),
            F.struct(F.col("b").alias("node_id"), F.col("r").alias("k"), above.alias("above"), (first + F.col("l")).alias("place")),
        )
        front = cut(down.select(F.explode(each).alias("x")).select("x.*"), "front")
        if not front.limit(1).count():
            return cut(out, "edges")
