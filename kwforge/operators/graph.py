"""Similarity graphs over objects: shared keywords or shared hits, top neighbours, normalisation, smoothing.

Pairs come from a self equi-join on the shared item. An item that very many ids share is dealt into blocks, and each
pair of blocks is a key of its own, so no item is one task; shared counts are summed before they are shuffled. The pairs
of an item are still the square of its frequency, which is what the graph asks for: meant for the bounded samples that
a split is trained on, not for a corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kwforge.sources.shared import cut


def overlaps(pairs: DataFrame, id_col: str, item: str, block: int = 2048) -> DataFrame:
    """(src, dst, shared, n_src, n_dst) for src < dst with a shared item."""
    n = pairs.groupBy(id_col).agg(F.count("*").alias("n"))
    parts = pairs.groupBy(item).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("parts"))
    sized = pairs.join(parts, item).join(n, id_col).select(F.col(id_col).alias("id"), F.col(item).alias("item"), "n", "parts", F.pmod(F.xxhash64(id_col), F.col("parts")).cast("int").alias("mine"))
    sized = cut(sized, "sized")
    # an id of block k meets block j >= k as a left side, and stands in block k as a right side for every i <= k
    a = sized.select("*", F.col("mine").alias("i"), F.explode(F.sequence(F.col("mine"), F.col("parts") - 1)).alias("j")).alias("a")
    b = sized.select("*", F.col("mine").alias("j"), F.explode(F.sequence(F.lit(0), F.col("mine"))).alias("i")).alias("b")
    same = (F.col("a.item") == F.col("b.item")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    met = a.join(b, same & ((F.col("a.i") < F.col("a.j")) | (F.col("a.id") < F.col("b.id"))))
    turned = F.col("a.id") > F.col("b.id")
    side = lambda c, x, y: F.when(turned, F.col(f"{y}.{c}")).otherwise(F.col(f"{x}.{c}"))
    return met.groupBy(side("id", "a", "b").alias("src"), side("id", "b", "a").alias("dst"), side("n", "a", "b").alias("n_src"), side("n", "b", "a").alias("n_dst")).agg(F.count("*").alias("shared"))


def jaccard(pairs: DataFrame, id_col: str, item: str) -> DataFrame:
    """(src, dst, weight), both directions."""
    w = overlaps(pairs, id_col, item).select("src", "dst", (F.col("shared") / (F.col("n_src") + F.col("n_dst") - F.col("shared"))).alias("weight"))
    return both_ways(w)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def cosine(pairs: DataFrame, id_col: str, item: str) -> DataFrame:
    """(src, dst, cosine) of binary vectors, src < dst."""
    return overlaps(pairs, id_col, item).select("src", "dst", (F.col("shared") / F.sqrt(F.col("n_src").cast("double") * F.col("n_dst"))).alias("cosine"))


def combine(a: DataFrame, b: DataFrame, weight_a: float, weight_b: float) -> DataFrame:
    """Weighted sum of two edge tables; an edge may be in either."""
    x, y = a.withColumnRenamed("weight", "wa"), b.withColumnRenamed("weight", "wb")
    zero = F.lit(0.0)
    return x.join(y, ["src", "dst"], "full").select("src", "dst", (F.lit(weight_a) * F.coalesce("wa", zero) + F.lit(weight_b) * F.coalesce("wb", zero)).alias("weight"))


def top_neighbours(edges: DataFrame, k: int) -> DataFrame:
    """The k heaviest edges of each src, ties to the smaller dst; directed."""
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return edges.filter("src <> dst").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def normalized(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of D^-1/2 (A + I) D^-1/2 with row degrees."""
    loops = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))
    full = edges.select("src", "dst", "weight").unionByName(loops)
    deg = full.groupBy("src").agg(F.sum("weight").alias("d"))
    return (
        full.join(deg.withColumnRenamed("d", "ds"), "src")
        .join(deg.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst")
        .select("src", "dst", (F.col("weight") / F.sqrt(F.col("ds") * F.col("dd"))).alias("weight"))
    )


def smooth(values: DataFrame, edges: DataFrame, a: float = 0.5) -> DataFrame:
    """One step of x <- a x + (1 - a) D^-1 W x for (id, item, value) and symmetric weights; no edges: x stays."""
    deg = edges.groupBy("src").agg(F.sum("weight").alias("d"))
    near = edges.join(values.withColumnRenamed("id", "dst"), "dst").groupBy("src", "item").agg(F.sum(F.col("weight") * F.col("value")).alias("s"))
    moved = near.join(deg, "src").select(F.col("src").alias("id"), "item", (F.col("s") / F.col("d")).alias("m"))
    full = values.join(moved, ["id", "item"], "full").join(deg.select(F.col("src").alias("id"), "d"), "id", "left")
    v = F.coalesce("value", F.lit(0.0))
    return full.select("id", "item", F.when(F.col("d").isNull(), v).otherwise(F.lit(a) * v + F.lit(1 - a) * F.coalesce("m", F.lit(0.0))).alias("value"))
