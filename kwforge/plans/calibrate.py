"""Calibration of the latency model: controlled data with known answers, sample cleaning, and non-negative fits."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kwforge.functions.medians import middle_pair

ANCHORS, UNIVERSAL, FILLERS = 200, 8, 4


def controlled_objects(spark: SparkSession, n: int) -> DataFrame:
    """(obj_id, kw): every object has the universal keywords and fillers of its own; anchor r is in the first r objects.

    Anchors go up to min(200, n), so a query for anchor r and universal keywords has exactly r results.
    """
    ids = spark.range(n).withColumnRenamed("id", "obj_id")
    top = min(ANCHORS, n)
    universal = F.transform(F.sequence(F.lit(0), F.lit(UNIVERSAL - 1)), lambda i: F.concat(F.lit("u"), i))
    anchors = F.when(F.col("obj_id") < top, F.transform(F.sequence(F.col("obj_id") + 1, F.lit(top).cast("long")), lambda i: F.concat(F.lit("a"), i))).otherwise(F.array().cast("array<string>"))
    own = F.transform(F.sequence(F.lit(0), F.lit(FILLERS - 1)), lambda i: F.concat(F.lit("f"), F.col("obj_id"), F.lit("_"), i))
    return ids.select("obj_id", F.explode(F.concat(universal, anchors, own)).alias("kw"))


def controlled_queries(spark: SparkSession, lengths: range = range(2, 9), results: range = range(1, 201)) -> DataFrame:
    """(query_id, kw, rc): anchor rc and the first length - 1 universal keywords."""
    grid = spark.range(len(lengths) * len(results)).select(F.col("id").alias("query_id"), (F.col("id") % len(results) + results.start).alias("rc"), (F.floor(F.col("id") / len(results)) + lengths.start).alias("k"))
    kws = F.concat(F.array(F.concat(F.lit("a"), F.col("rc"))), F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 2), lambda i: F.concat(F.lit("u"), i)))
    return grid.select("query_id", "rc", F.explode(kws).alias("kw"))


def median_of_repeats(samples: DataFrame, features: list[str], target: str) -> DataFrame:
    """One row a feature tuple with the interpolated median of the target; tuples without a target leave none."""
    pair = middle_pair(samples, features, target)
    return pair.select(*features, ((F.col("low") + F.col("high")) / 2).alias(target))


def gram(samples: DataFrame, columns: dict, target) -> dict[str, float]:
    """Sums of products of the columns and the target: the normal equations, from one aggregation."""
    names = list(columns)
    sums = {f"{a}|{b}": F.sum((columns[a] * columns[b]).cast("double")) for a, b in itertools.combinations_with_replacement(names, 2)}
    sums |= {f"{a}|y": F.sum((columns[a] * target).cast("double")) for a in names}
    return samples.agg(*(v.alias(k) for k, v in sums.items())).first().asDict()


def fit_non_negative(sums: dict[str, float], names: list[str], free: tuple = ()) -> dict[str, float]:
    """Least squares with coefficients >= 0 (but for `free`): the best feasible of all subsets of these few columns."""
    n = len(names)
    g = np.array([[sums.get(f"{a}|{b}", sums.get(f"{b}|{a}")) for b in names] for a in names], float)
    y = np.array([sums[f"{a}|y"] for a in names], float)
    best, out = np.inf, np.zeros(n)
    for r in range(n + 1):
        for use in itertools.combinations(range(n), r):
            w = np.zeros(n)
            if use:
                w[list(use)] = np.linalg.lstsq(g[np.ix_(use, use)], y[list(use)], rcond=None)[0]
            if any(w[i] < -1e-12 for i in range(n) if names[i] not in free):
                continue
            loss = w @ g @ w - 2 * w @ y
            if loss < best - 1e-9:
                best, out = loss, w
    return dict(zip(names, out.tolist(), strict=True))


def standardize(samples: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation; a deviation under 1e-12 counts as 1."""
    stats = samples.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns))
    joined = samples.join(F.broadcast(stats))  # one row
    rest = [c for c in samples.columns if c not in columns]
    return joined.select(*rest, *(((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") < 1e-12, F.lit(1.0)).otherwise(F.col(f"s_{c}"))).alias(c) for c in columns))


def regression_metrics(df: DataFrame, truth: str, predicted: str, by: str | None = None) -> DataFrame:
    """mae, mape (denominator at least 1) and r2 over all rows and, if given, for each value of `by`."""
    y, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    base = df.select(*([by] if by else []), y.alias("y"), p.alias("p"))
    sums = [
        F.count("*").alias("n"), F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"),
        F.avg(F.abs(F.col("y") - F.col("p")) / F.greatest(F.abs("y"), F.lit(1.0))).alias("mape"),
        F.sum((F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))).alias("res"), (F.var_pop("y") * F.count("*")).alias("tot"),
    ]
    got = base.groupingSets([[F.col(by)], []], F.col(by)).agg(*sums) if by else base.agg(*sums)
    r2 = F.when(F.col("tot") <= 1e-12, F.lit(0.0)).otherwise(1 - F.col("res") / F.col("tot"))
    return got.withColumn("r2", r2).drop("res", "tot")


def linear_grid(spark: SparkSession, start: int, end: int, n: int) -> DataFrame:
    """(i, x): n whole numbers evenly from start to end; one that equals the number before is raised by one, none passes end or falls."""
    at = lambda i: F.round((F.lit(1.0) - i / F.lit(float(max(1, n - 1)))) * F.lit(float(start)) + i / F.lit(float(max(1, n - 1))) * F.lit(float(end))).cast("long")

    def add(xs, i):
        last, x = F.element_at(xs, -1), at(i)
        raised = F.when(F.size(xs) == 0, x).when(x == last, last + 1).otherwise(x)
        held = F.least(F.greatest(raised, F.lit(start).cast("long")), F.lit(end).cast("long"))
        return F.concat(xs, F.array(F.when(F.size(xs) == 0, held).otherwise(F.greatest(held, last))))

    steps = F.sequence(F.lit(0), F.lit(n - 1)) if n > 0 else F.array().cast("array<int>")
    grid = F.aggregate(steps, F.array().cast("array<bigint>"), add) if n != 1 else F.array(F.lit(start).cast("long"))
    return spark.range(1).select(F.posexplode(grid).alias("i", "x"))


def split_parts(df: DataFrame, id_col: str, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """The rows with a column `part` (train, validation, test), by hash of the id: the same at every run and in every order."""
    share = F.conv(F.substring(F.md5(F.col(id_col).cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return df.withColumn("part", F.when(share < train, F.lit("train")).when(share < train + validation, F.lit("validation")).otherwise(F.lit("test")))


def log_target(c: Column) -> Column:
    """ln(1 + x) of a target, negative values taken as 0."""
    return F.log1p(F.greatest(c.cast("double"), F.lit(0.0)))


def from_log_target(c: Column) -> Column:
    """What log_target came from, never below 0."""
    return F.greatest(F.expm1(c), F.lit(0.0))


def principal_axes(df: DataFrame, vector_col: str, k: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(axes, shares of variance): the k main axes of the vectors of one length, each with its largest component positive.

    One aggregation sums vectors and their products by dimension, so the driver gets a matrix of the vectors' length.
    Vectors that are null or hold null or non-finite components are left out.
    """
    usable = df.filter(F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    pairs = usable.select(F.posexplode(F.col(vector_col).cast("array<double>")).alias("i", "x"), F.col(vector_col).cast("array<double>").alias("v"))
    sums = pairs.select("i", "x", F.posexplode("v").alias("j", "y")).groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum("x").alias("x"), F.count("*").alias("n")).collect()
    if not sums:
        return np.zeros((k, 0)), np.zeros(k)
    d = 1 + max(r["i"] for r in sums)
    xy, mean = np.zeros((d, d)), np.zeros(d)
    for r in sums:
        xy[r["i"], r["j"]], mean[r["i"]] = r["xy"] / r["n"], r["x"] / r["n"]
    values, axes = np.linalg.eigh(xy - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :k].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return axes, np.maximum(values[::-1][:k], 0) / max(float(np.maximum(values, 0).sum()), 1e-300)


def project(df: DataFrame, vector_col: str, axes: np.ndarray, names: tuple = ("x", "y")) -> DataFrame:
    """The rows with one column an axis: the product of vector and axis, null where the vector is."""
    v = F.col(vector_col).cast("array<double>")
    dot = lambda a: F.aggregate(F.zip_with(v, F.array(*map(F.lit, a.tolist())), lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return df.withColumns({name: dot(a) for name, a in zip(names, axes, strict=True)})
