"""The pruning tree as tables: leaf layout, child masks, search, integrity, sizes.

Tables: edges (parent, child_pos, child), leaf_of (obj_id, leaf_id). Parent keywords hold child keywords, so a leaf can
match exactly if its own keyword set holds the whole query: search is one division over leaf keywords and one over the
objects of the candidate leaves, with two shuffles whatever the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kwforge.functions.cost import CostModel
from kwforge.operators.search import contains_all, held_pairs
from kwforge.plans.dp import kept_cost


def leaf_objects(objects: DataFrame, leaf: Column) -> DataFrame:
    """(leaf_id, obj_id, pos): pos counts from 0 within a leaf in id order."""
    ids = objects.select("obj_id").distinct().withColumn("leaf_id", leaf)
    return ids.withColumn("pos", (F.row_number().over(Window.partitionBy("leaf_id").orderBy("obj_id")) - 1).cast("long")).select("leaf_id", "obj_id", "pos")


def leaf_keywords(objects: DataFrame, leaf: Column) -> DataFrame:
    """Distinct (leaf_id, kw)."""
    return objects.select(leaf.alias("leaf_id"), "kw").distinct()


def candidate_leaves(leaf_kw: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, leaf_id) for the leaves whose keywords hold the whole query."""
    return contains_all(leaf_kw.withColumnRenamed("leaf_id", "obj_id"), queries).withColumnRenamed("obj_id", "leaf_id")


def search(objects: DataFrame, leaf: Column, queries: DataFrame) -> DataFrame:
    """All-keyword search that reads only candidate leaves; the objects themselves are read once."""
    return search_leaves(held_pairs(objects.withColumn("leaf_id", leaf), queries), queries)


def search_leaves(sided: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, obj_id) from (leaf_id, obj_id, kw): a leaf that lacks a keyword of a query is never looked into.

    In a candidate leaf, a query enters at the keyword that the fewest of the leaf's objects hold.
    """
    df = sided.groupBy("leaf_id", "kw").agg(F.count("*").alias("df"))
    size = queries.groupBy("query_id").agg(F.count("*").alias("q"))
    sorted_kws = F.array_sort(F.collect_list(F.struct("df", "kw")))
    routed = df.join(queries, "kw").groupBy("leaf_id", "query_id").agg(sorted_kws.alias("k")).join(size, "query_id").filter(F.size("k") == F.col("q"))
    entry = routed.select("query_id", "leaf_id", F.col("k")[0]["kw"].alias("kw"), F.transform(F.slice("k", F.lit(2), F.size("k")), lambda x: x["kw"]).alias("rest"))
    candidates = sided.join(entry, ["leaf_id", "kw"]).select("query_id", "obj_id", "rest")
    needed = candidates.select("query_id", "obj_id", F.size("rest").alias("q"), F.explode("rest").alias("kw"))
    found = needed.join(sided.select("obj_id", "kw"), ["obj_id", "kw"]).groupBy("query_id", "obj_id", "q").agg(F.count("*").alias("m"))
    return found.filter("m = q").select("query_id", "obj_id").unionByName(candidates.filter(F.size("rest") == 0).select("query_id", "obj_id"))


def subtree_keywords(edges: DataFrame, leaf_kw: DataFrame, depth: int) -> DataFrame:
    """Distinct (node_id, kw) for leaves and for every node above them, level by level."""
    level = leaf_kw.select(F.col("leaf_id").alias("node_id"), "kw")
    found = level
    for _ in range(depth):
        level = level.join(edges, level.node_id == edges.child).select(F.col("parent").alias("node_id"), "kw").distinct()
        found = found.unionByName(level)
    return found.distinct()


def child_masks(edges: DataFrame, node_kw: DataFrame) -> DataFrame:
    """(parent, kw, word_idx, child_mask): bit child_pos mod 32 of word child_pos div 32 for children that have kw."""
    bit = F.expr("shiftleft(1L, cast(child_pos % 32 as int))")
    met = node_kw.join(edges, node_kw.node_id == edges.child)
    return met.groupBy("parent", "kw", F.floor(F.col("child_pos") / 32).cast("long").alias("word_idx")).agg(F.bit_or(bit).alias("child_mask"))


def descend(edges: DataFrame, masks: DataFrame, queries: DataFrame, root: int, depth: int) -> DataFrame:
    """(query_id, node_id, depth) of every node that a query visits, by masks from the root down."""
    q = queries.groupBy("query_id").agg(F.count("*").alias("q"))
    front = q.select("query_id", F.lit(root).cast("long").alias("node_id"))
    seen = front.withColumn("depth", F.lit(0))
    # masks are a row a node and keyword, in files that look small: never broadcast
    for d in range(1, depth + 1):
        met = front.join(queries, "query_id").join(masks.withColumnRenamed("parent", "node_id").hint("merge"), ["node_id", "kw"])
        met = met.groupBy("query_id", "node_id", "word_idx").agg(F.bit_and("child_mask").alias("mask"), F.count("*").alias("m")).join(q, "query_id").filter("m = q AND mask <> 0")
        hit = met.join(edges, (F.col("parent") == F.col("node_id")) & (F.floor(F.col("child_pos") / 32) == F.col("word_idx")))
        front = hit.filter(F.expr("getbit(mask, cast(child_pos % 32 as int)) = 1")).select("query_id", F.col("child").alias("node_id"))
        seen = seen.unionByName(front.withColumn("depth", F.lit(d)))
    return seen


def integrity(edges: DataFrame, leaves: DataFrame, root: int) -> DataFrame:
    """Counts of what a sound tree has none of: children without a table row, nodes with two parents, a root with one."""
    inner = edges.select(F.col("parent").alias("n")).distinct()
    known = inner.unionByName(leaves.select(F.col("leaf_id").alias("n")).distinct())
    missing = edges.join(known, edges.child == known.n, "left_anti").agg(F.count("*").alias("missing_children"))
    shared = edges.groupBy("child").agg(F.count("*").alias("c")).filter("c > 1").agg(F.count("*").alias("shared_children"))
    rooted = edges.filter(F.col("child") == root).agg(F.count("*").alias("root_parents"))
    orphans = known.filter(F.col("n") != root).join(edges, edges.child == known.n, "left_anti").agg(F.count("*").alias("orphans"))
    return missing.join(shared).join(rooted).join(orphans)  # four one-row tables


def index_bits(leaf: DataFrame, inner: DataFrame) -> DataFrame:
    """Bits of leaves (omega, o) and of inner nodes (omega, c): a mask a keyword, and 32 bits for each keyword and entry."""
    a = leaf.agg(F.sum(F.expr("omega * o + 32 * omega + 32 * o")).cast("long").alias("leaf_bits"), F.count("*").alias("n_leaves"))
    b = inner.agg(F.sum(F.expr("omega * c + 32 * omega + 32 * c")).cast("long").alias("inner_bits"), F.count("*").alias("n_inner"))
    both = a.join(b).na.fill(0)
    return both.select("n_leaves", "n_inner", "leaf_bits", "inner_bits", F.expr("leaf_bits + inner_bits").alias("total_bits"), F.expr("(leaf_bits + inner_bits + 7) div 8").alias("total_bytes"))


def cost_of(nodes: DataFrame, edges: DataFrame, model: CostModel) -> DataFrame:
    """(cost, n_leaves, n_inner) of a tree: leaves at their own cost, inner nodes by their branches and the visits of these.

    nodes: node_id, omega, queries, sum_len, cost (of the node as a leaf). Nodes that edges don't name are left out.
    """
    there = edges.select(F.explode(F.array("parent", "child")).alias("node_id")).distinct()
    met = edges.join(nodes.select(F.col("node_id").alias("child"), "queries"), "child").groupBy(F.col("parent").alias("node_id")).agg(F.count("*").alias("branches"), F.sum("queries").alias("visits"))
    each = nodes.join(there, "node_id").join(met, "node_id", "left")
    leaf = F.col("branches").isNull()
    cost = F.when(leaf, F.col("cost")).otherwise(kept_cost(F.col("branches"), F.col("visits"), model))
    return each.agg(F.sum(cost).alias("cost"), F.count_if(leaf).alias("n_leaves"), F.count_if(~leaf).alias("n_inner"))
