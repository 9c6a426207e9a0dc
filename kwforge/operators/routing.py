"""Which side, child or leaf a keyword lives on, and where queries go by that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwforge.operators.search import contains_all, few, held_pairs
from kwforge.sources.shared import cut

LEFT, RIGHT = 1, 2


def side_bits(objects: DataFrame, side: Column) -> DataFrame:
    """(kw, bits): 1 if objects of the left side have the keyword, plus 2 for the right; null sides are left out."""
    return objects.withColumn("side", side).filter("side IS NOT NULL").groupBy("kw").agg(F.bit_or("side").alias("bits"))


def route(queries: DataFrame, bits: DataFrame, drop_if_neither: bool = True) -> DataFrame:
    """(query_id, bits): the sides that hold all of a query's keywords.

    A query that fits neither side is dropped, or goes to both. Queries without keywords have no row.
    """
    met = queries.join(bits, "kw", "left").groupBy("query_id").agg(F.bit_and(F.coalesce("bits", F.lit(0))).alias("bits"))
    if drop_if_neither:
        return met.filter("bits <> 0")
    return met.select("query_id", F.when(F.col("bits") == 0, F.lit(LEFT | RIGHT)).otherwise(F.col("bits")).alias("bits"))


def single_step_deltas(objects: DataFrame, side: Column, queries: DataFrame, new: DataFrame, alpha: float, beta: float, gamma: float, epsilon: float) -> DataFrame:
    """(obj_id, side, delta_storage, delta_existing, delta_new) of adding each new object to either side.

    Storage grows by omega + d_omega (O + 33) + 32, where omega counts the side's keywords and d_omega the object's new
    ones. Existing queries of a side cost alpha * sum(q - 1) + beta each more, and gamma for each that the object answers.
    Queries that become feasible only with the object cost epsilon each, (O + 1)(alpha * sum(q - 1) + beta * n) and gamma
    for each the object answers.
    """
    sided = objects.withColumn("side", side).filter("side IS NOT NULL")
    have = cut(sided.select("side", "kw").distinct(), "have")  # read five times below
    counts = sided.groupBy("side").agg(F.count_distinct("obj_id").alias("o"))
    return deltas_against(have, counts, queries, new, alpha, beta, gamma, epsilon)


def deltas_against(have: DataFrame, counts: DataFrame, queries: DataFrame, new: DataFrame, alpha: float, beta: float, gamma: float, epsilon: float) -> DataFrame:
    """The same from what the sides amount to: their distinct keywords, have (side, kw), and objects, counts (side, o)."""
    state = counts.join(have.groupBy("side").agg(F.count("*").alias("omega")), "side")
    size = queries.groupBy("query_id").agg(F.count("*").alias("q"))
    sides = state.select("side")
    met = queries.join(have, "kw").groupBy("side", "query_id").agg(F.count("*").alias("m"))
    active = cut(met.join(size, "query_id").filter("m = q").select("side", "query_id", "q"), "active")
    base = state.join(active.groupBy("side").agg(F.sum(F.col("q") - 1).alias("sum_q"), F.count("*").alias("n_act")), "side", "left").na.fill(0)
    each = new.select("obj_id").distinct().join(F.broadcast(sides))  # two sides
    # a keyword comes once, with all sides that have it, so an object's pairs are shuffled once, not once a side
    had = have.groupBy("kw").agg(F.collect_set("side").alias("had"))
    missed = F.array_except("all", F.coalesce("had", F.slice("all", 1, 0)))
    fresh = new.join(had, "kw", "left").join(F.broadcast(sides.agg(F.collect_set("side").alias("all")))).select("obj_id", F.explode(missed).alias("side"))
    d_omega = fresh.groupBy("obj_id", "side").agg(F.count("*").alias("d_omega"))
    held = held_pairs(new, queries)
    holds = cut(contains_all(new, queries, held=held), "holds")
    hit = holds.join(active, "query_id").groupBy("obj_id", "side").agg(F.count("*").alias("hits"))
    # a query becomes feasible if the object has every keyword of it that the side lacks
    lacks = queries.join(F.broadcast(sides)).join(have, ["side", "kw"], "left_anti")
    n_lacks = lacks.groupBy("side", "query_id").agg(F.count("*").alias("lacks"))
    given = held.join(F.broadcast(lacks) if few(queries) else lacks, "kw").groupBy("obj_id", "side", "query_id").agg(F.count("*").alias("m"))
    opened = given.join(n_lacks, ["side", "query_id"]).filter("m = lacks").join(size, "query_id")
    opened = opened.join(holds.withColumn("hit", F.lit(1)), ["obj_id", "query_id"], "left")
    opened = opened.groupBy("obj_id", "side").agg(F.count("*").alias("n_new"), F.sum(F.col("q") - 1).alias("new_q"), F.count("hit").alias("new_hits"))
    all_ = each.join(F.broadcast(base), "side").join(d_omega, ["obj_id", "side"], "left").join(hit, ["obj_id", "side"], "left").join(opened, ["obj_id", "side"], "left").na.fill(0)
    c = F.col
    return all_.select(
        "obj_id", "side",
        (c("omega") + c("d_omega") * (c("o") + 33) + 32).alias("delta_storage"),
        (alpha * c("sum_q") + beta * c("n_act") + gamma * c("hits")).alias("delta_existing"),
        (epsilon * c("n_new") + (c("o") + 1) * (alpha * c("new_q") + beta * c("n_new")) + gamma * c("new_hits")).alias("delta_new"),
    )


def cheaper_side(deltas: DataFrame, model) -> DataFrame:
    """(obj_id, side): where an object costs less under the model's weights; ties go left."""
    cost = F.lit(model.storage_weight) * F.col("delta_storage") + F.lit(model.query_weight) * (F.col("delta_existing") + F.col("delta_new"))
    return deltas.groupBy("obj_id").agg(F.min(F.struct(cost.alias("cost"), "side"))["side"].alias("side"))


def assign_batches(seeds: DataFrame, queries: DataFrame, new: DataFrame, model, batches: int = 8) -> DataFrame:
    """(obj_id, side) of every new object: each goes where it costs less, against the sides as the batches before left them.

    seeds are (obj_id, kw, side). Objects are dealt into batches by hash; within a batch all are weighed against the same
    sides, so that a batch is one set of joins. Ties go left. As many batches as objects would be the exact one-by-one pass.
    """
    sides, out = cut(seeds.select("obj_id", "kw", "side"), "sides"), None
    for k in range(batches):
        batch = new.filter(F.pmod(F.xxhash64("obj_id"), F.lit(batches)) == k)
        deltas = single_step_deltas(sides, F.col("side"), queries, batch, model.alpha, model.beta, model.gamma, model.epsilon)
        chosen = cut(cheaper_side(deltas, model), "chosen")
        out = chosen if out is None else out.unionByName(chosen)
        sides = cut(sides.unionByName(batch.join(chosen, "obj_id").select("obj_id", "kw", "side")), "sides") if k < batches - 1 else sides
    return out
