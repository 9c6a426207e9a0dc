"""A split that is learned: gradient steps on the soft cost of two sides, each step a handful of SQL aggregates.

An object goes left with probability pi = sigmoid(w . x), x being its keywords hashed into `features` buckets and scaled by
the root of their number. Side by side (pi left, 1 - pi right): s of a keyword is the mass of its objects, its gate is
1 - exp(-s / tau), the soft number of keywords is the sum of gates, and a query's mass is the exponential of the summed
logarithms of its keywords' gates. These enter the storage and latency model in place of counts; a small term draws the
halves together and another rewards undecided objects. The gradient goes back the same way: keyword by keyword, object by
object, and bucket by bucket. No row leaves the executors but the weights, one number a bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwforge.functions.cost import CostModel
from kwforge.operators.joins import join_dealt
from kwforge.sources.shared import cut

FEATURES, EPS = 256, 1e-9
SIDES = ("l", "r")


def bucket(kw: Column, features: int = FEATURES) -> Column:
    """Hashed feature of a keyword: the first 32 bits of its MD5, modulo the number of features."""
    return F.pmod(F.conv(F.substring(F.md5(kw.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(features)).cast("int")


def first_weights(spark, features: int = FEATURES) -> DataFrame:
    """(f, w): small weights of either sign that follow from the bucket."""
    return spark.range(features).select(F.col("id").cast("int").alias("f"), ((F.col("id") * 7919 % 1009) / 1009 - 0.5).alias("w"))


def hashed(objects: DataFrame, features: int = FEATURES) -> DataFrame:
    """(obj_id, kw, f, x) of distinct (obj_id, kw)."""
    n = objects.groupBy("obj_id").agg(F.count("*").alias("n"))
    return objects.join(n, "obj_id").select("obj_id", "kw", bucket(F.col("kw"), features).alias("f"), (1 / F.sqrt("n")).alias("x"))


def probabilities(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """(obj_id, pi)."""
    z = pairs.join(F.broadcast(weights), "f").groupBy("obj_id").agg(F.sum(F.col("w") * F.col("x")).alias("z"))  # one row a bucket
    return z.select("obj_id", (1 / (1 + F.exp(-F.col("z")))).alias("pi"))


def _sides(f) -> list[Column]:
    return [f(s) for s in SIDES]


def _add(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def gates(pairs: DataFrame, pi: DataFrame, tau: float) -> DataFrame:
    """(kw, k_l, k_r, e_l, e_r): each side's gate of a keyword, and its derivative by the mass."""
    mass = pairs.join(pi, "obj_id").groupBy("kw").agg(F.sum("pi").alias("s_l"), F.sum(1 - F.col("pi")).alias("s_r"))
    return mass.select("kw", *_sides(lambda s: F.least(1 - F.exp(-F.col(f"s_{s}") / tau), F.lit(1 - 1e-6)).alias(f"k_{s}")), *_sides(lambda s: (F.exp(-F.col(f"s_{s}") / tau) / tau).alias(f"e_{s}")))


def query_masses(gate: DataFrame, queries: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, q, r, m_l, m_r): masses of each query on either side; results (query_id, r) may lack queries without any."""
    none = F.log(F.lit(EPS))  # a keyword that no object has is closed on both sides
    met = queries.join(gate, "kw", "left").groupBy("query_id").agg(F.count("*").alias("q"), *_sides(lambda s: F.exp(F.sum(F.coalesce(F.log(F.col(f"k_{s}") + EPS), none))).alias(f"m_{s}")))
    return met.join(results.select("query_id", "r"), "query_id", "left").na.fill(0, ["r"])


def totals(pi: DataFrame, gate: DataFrame, masses: DataFrame) -> DataFrame:
    """One row: n, o, omega, w, sum_q, sum_r of the two sides, and the mean entropy of the probabilities."""
    p = F.least(F.greatest(F.col("pi"), F.lit(1e-6)), F.lit(1 - 1e-6))
    a = pi.agg(F.count("*").alias("n"), F.sum("pi").alias("o_l"), F.sum(1 - F.col("pi")).alias("o_r"), F.avg(-(p * F.log(p) + (1 - p) * F.log(1 - p))).alias("entropy"))
    b = gate.agg(*_sides(lambda s: F.sum(f"k_{s}").alias(f"omega_{s}")))
    c = masses.agg(*(F.sum(F.col(f"m_{s}") * f).alias(f"{name}_{s}") for s in SIDES for name, f in (("w", F.lit(1)), ("sum_q", F.col("q")), ("sum_r", F.col("r")))))
    return a.join(b).join(c).na.fill(0.0)  # three one-row tables


def soft_cost(t: str, model: CostModel, balance: float, entropy: float) -> Column:
    """The objective from the columns of `totals`."""
    c = lambda name: F.col(f"{t}{name}")

    def side(s: str) -> Column:
        o, omega = c(f"o_{s}"), c(f"omega_{s}")
        ns = model.epsilon * c(f"w_{s}") + model.alpha * c(f"sum_q_{s}") * o + model.beta * c(f"w_{s}") * o + model.gamma * c(f"sum_r_{s}")
        return model.storage_weight * (omega * o + 32 * omega + 32 * o) + model.query_weight * ns

    return _add(_sides(side)) + balance * F.pow(c("o_l") / c("n") - 0.5, F.lit(2)) - entropy * c("entropy")


def step(pairs: DataFrame, queries: DataFrame, results: DataFrame, weights: DataFrame, model: CostModel, tau: float = 1.0, balance: float = 1e-2, entropy: float = 1e-3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(probabilities, one row with the totals and `cost`, gradient (f, g)) at the given weights; pairs as `hashed` gives them."""
    pi = cut(probabilities(pairs, weights), "pi")
    gate = cut(gates(pairs, pi, tau), "gates")
    masses = cut(query_masses(gate, queries, results), "masses")
    whole = cut(totals(pi, gate, masses).withColumn("cost", soft_cost("", model, balance, entropy)), "totals")
    one = F.broadcast(whole)  # one row
    # the cost by a query's mass, then by a keyword's gate: its own share and that of the queries that ask for it
    by_mass = lambda s: model.query_weight * (model.epsilon + model.alpha * F.col("q") * F.col(f"o_{s}") + model.beta * F.col(f"o_{s}") + model.gamma * F.col("r"))
    asked = masses.join(one).select("query_id", *_sides(lambda s: (by_mass(s) * F.col(f"m_{s}")).alias(f"a_{s}"))).join(queries, "query_id").groupBy("kw").agg(*_sides(lambda s: F.sum(f"a_{s}").alias(f"a_{s}")))
    by_gate = lambda s: model.storage_weight * (F.col(f"o_{s}") + 32) + F.coalesce(f"a_{s}", F.lit(0.0)) / (F.col(f"k_{s}") + EPS)
    by_kw = gate.join(asked, "kw", "left").join(one).select("kw", (by_gate("l") * F.col("e_l") - by_gate("r") * F.col("e_r")).alias("d"))
    sums = join_dealt(pairs.select("obj_id", "kw"), by_kw, "kw", "obj_id").groupBy("obj_id").agg(F.sum("d").alias("d"))
    by_size = lambda s: model.storage_weight * (F.col(f"omega_{s}") + 32) + model.query_weight * (model.alpha * F.col(f"sum_q_{s}") + model.beta * F.col(f"w_{s}"))
    p = F.least(F.greatest(F.col("pi"), F.lit(1e-6)), F.lit(1 - 1e-6))
    pulls = F.lit(2 * balance) * (F.col("o_l") / F.col("n") - 0.5) / F.col("n") + F.lit(entropy) * F.log(p / (1 - p)) / F.col("n")
    by_object = sums.join(pi, "obj_id").join(one).select("obj_id", ((F.col("d") + by_size("l") - by_size("r") + pulls) * F.col("pi") * (1 - F.col("pi"))).alias("g"))
    gradient = pairs.join(by_object, "obj_id").groupBy("f").agg(F.sum(F.col("g") * F.col("x")).alias("g"))
    return pi, whole, cut(gradient, "gradient")


def hard_bits(objects: DataFrame, pi: DataFrame, model: CostModel) -> float:
    """Storage of the two sides with every object on the side that it rather belongs to."""
    sided = pi.select("obj_id", (F.col("pi") >= 0.5).alias("left"))
    o = sided.groupBy("left").agg(F.count("*").alias("o"))
    omega = objects.join(sided, "obj_id").select("left", "kw").distinct().groupBy("left").agg(F.count("*").alias("omega"))
    return o.join(omega, "left").agg(F.sum(model.storage(F.col("o"), F.col("omega")).cast("double"))).first()[0] or 0.0


def learn_split(objects: DataFrame, queries: DataFrame, results: DataFrame, model: CostModel, steps: int = 10, rate: float = 1.0, features: int = FEATURES, tau: float = 1.0) -> tuple[DataFrame, list[tuple[float, float]]]:
    """((obj_id, side 1 or 2), [(soft cost, hard bits)] before each step and at the end).

    A step goes along the gradient scaled to its largest entry. One that would make the cost rise is taken back, and the
    rate halved.
    """
    pairs = cut(hashed(objects, features), "hashed")
    weights = cut(first_weights(objects.sparkSession, features), "weights")
    pi, whole, gradient = step(pairs, queries, results, weights, model, tau)
    cost = whole.first()["cost"]
    history = [(cost, hard_bits(objects, pi, model))]
    for _ in range(steps):
        top = gradient.agg(F.max(F.abs("g"))).first()[0]
        if not top:
            break
        moved = cut(weights.join(F.broadcast(gradient), "f", "left").select("f", (F.col("w") - F.lit(rate / top) * F.coalesce("g", F.lit(0.0))).alias("w")), "weights")
        new_pi, new_whole, new_gradient = step(pairs, queries, results, moved, model, tau)
        new = new_whole.first()["cost"]
        if new >= cost:
            rate /= 2
            continue
        weights, pi, gradient, cost = moved, new_pi, new_gradient, new
        history.append((cost, hard_bits(objects, pi, model)))
    return pi.select("obj_id", F.when(F.col("pi") >= 0.5, F.lit(1)).otherwise(F.lit(2)).alias("side")), history
