"""Written tables as the planner sees them."""

import re

from pyspark.sql import functions as F

from kwforge.operators import bitmaps, joins, routing, search
from kwforge.plans import tree
from kwforge.sources import shared


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_rows_in_small_files_are_not_broadcast(spark):
    """300,000 rows take a few kilobytes of files; the planner would send all of them through the driver."""
    many = shared.cut(spark.range(300_000).select((F.col("id") % 7).alias("k"), F.lit("word").alias("kw")), "many")
    large = spark.range(1 << 40).withColumnRenamed("id", "k")
    assert "Broadcast" not in _plan(large.join(many, "k"))
    assert "Broadcast" not in _plan(large.join(many.select("k").distinct(), "k", "left_semi"))
    few = shared.cut(spark.range(10).withColumnRenamed("id", "k"), "few")
    assert "BroadcastHashJoin" in _plan(large.join(few, "k"))


def test_search_broadcasts_queries_alone(spark, monkeypatch):
    monkeypatch.setattr(shared, "MANY", 50)
    objects = spark.range(200).select(F.col("id").alias("obj_id"), F.explode(F.array(F.concat(F.lit("w"), (F.col("id") % 5).cast("string")), F.lit("all"))).alias("kw"))
    queries = spark.createDataFrame([(1, "all"), (1, "w3"), (2, "all"), (3, "none"), (3, "all")], "query_id long, kw string")
    hits = search.contains_all(objects, queries)
    sides = [x for x in _plan(hits).splitlines() if "BroadcastHashJoin" in x and "obj_id" in x]
    assert not sides
    got = {(r.query_id, r.obj_id) for r in hits.collect()}
    assert got == {(1, i) for i in range(200) if i % 5 == 3} | {(2, i) for i in range(200)}


def test_rows_of_few_files_are_dealt(spark):
    """A scan of one small file is dealt into tasks by rows, and the distinct hits of an object need no further shuffle."""
    one = shared.cut(spark.range(20_000).coalesce(1), "one")
    dealt = joins.deal(one, "id", 1000)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 1300
    objects = dealt.select(F.col("id").alias("obj_id"), F.explode(F.array(F.lit("a"), F.concat(F.lit("w"), (F.col("id") % 3).cast("string")))).alias("kw"))
    queries = spark.createDataFrame([(1, "a"), (1, "w1"), (2, "w2"), (3, "none")], "query_id long, kw string")
    hits = search.contains_any(objects, queries)
    assert _plan(hits).count("Exchange hashpartitioning") == 1
    assert {r.query_id: r["count"] for r in hits.groupBy("query_id").count().collect()} == {1: 20_000, 2: 6666}


def test_words_are_combined_in_tasks_of_bounded_size(spark):
    """Pairs that share no word are dealt by word; nothing is combined where a split of files is read."""
    pairs = spark.range(4_000).select((F.col("id") % 400).alias("kw"), (F.col("id") * 32).alias("pos"))
    words = bitmaps.encode(pairs, ["kw"], "pos", 20)
    plan = _plan(words)
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    assert plan.index("partial_bit_or") < plan.index("Exchange")  # the tree is printed from the top
    sizes = [r["count"] for r in words.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 400 and words.exceptAll(bitmaps.encode(pairs, ["kw"], "pos")).count() == 0 == 4_000 - words.count()


def test_bitmaps_meet_at_the_rarest_keyword(spark):
    """Words of frequent keywords are joined by place to those of the keyword that sets the fewest bits."""
    objects = spark.range(2_000).select(F.col("id").alias("obj_id"), F.explode(F.array(F.lit("all"), F.concat(F.lit("w"), (F.col("id") % 500).cast("string")))).alias("kw"))
    queries = spark.createDataFrame([(1, "all"), (1, "w3"), (2, "w7"), (3, "none"), (3, "all"), (4, "w1"), (4, "w2")], "query_id long, kw string")
    met = bitmaps.intersect(bitmaps.encode(objects, ["kw"], "obj_id"), queries)
    assert re.search(r"Join \[kw#\d+, word_idx#\d+L\]", _plan(met))
    got = {tuple(r) for r in bitmaps.decode(met, ["query_id"]).collect()}
    assert got == {(1, i) for i in range(3, 2000, 500)} | {(2, i) for i in range(7, 2000, 500)}


def test_new_keywords_are_met_once_for_all_sides(spark, monkeypatch):
    """Pairs of new objects are shuffled by keyword as they are, not once for each side."""
    new = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "c"), (2, "d"), (3, "a")], "obj_id long, kw string")
    have = spark.createDataFrame([(1, "a"), (2, "a"), (1, "b"), (2, "c")], "side int, kw string")
    counts = spark.createDataFrame([(1, 2), (2, 1)], "side int, o long")
    queries = spark.createDataFrame([(1, "a"), (1, "c"), (2, "d")], "query_id long, kw string")
    written = []
    monkeypatch.setattr(routing, "cut", lambda df, label: written.append(label) or shared.cut(df, label))
    out = routing.deltas_against(have, counts, queries, new, 0.0, 0.0, 0.0, 1.0)
    assert "fresh" not in written
    got = {(r.obj_id, r.side): (r.delta_storage, r.delta_new) for r in out.collect()}
    fresh = {(1, 1): 1, (1, 2): 1, (2, 1): 2, (2, 2): 1, (3, 1): 0, (3, 2): 0}
    opened = {(1, 1): 1.0, (2, 1): 2.0, (2, 2): 1.0}
    assert got == {k: (2 + n * ({1: 2, 2: 1}[k[1]] + 33) + 32, opened.get(k, 0.0)) for k, n in fresh.items()}


def test_masks_are_not_broadcast(spark):
    """The masks of a stored tree are many rows in small files."""
    masks = spark.createDataFrame([(1, "a", 0, 1), (1, "b", 0, 3)], "parent long, kw string, word_idx long, child_mask long")
    edges = spark.createDataFrame([(1, 0, 2), (1, 1, 3)], "parent long, child_pos int, child long")
    queries = spark.createDataFrame([(1, "b"), (2, "a"), (2, "b")], "query_id long, kw string")
    seen = tree.descend(edges, shared.cut(masks, "masks"), queries, 1, 1)
    assert re.search(r"SortMergeJoin \[kw#\d+\]", _plan(seen)) and "BroadcastHashJoin [kw" not in _plan(seen)
    assert {tuple(r) for r in seen.filter("depth = 1").collect()} == {(1, 2, 1), (1, 3, 1), (2, 2, 1)}
