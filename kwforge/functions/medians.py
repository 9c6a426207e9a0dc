"""Exact middle values of groups of any size.

`median` of Spark keeps a group's values in one buffer. Here equal values are counted first, before anything is shuffled;
the counts are dealt into ranges of (group, value), written, and added up range by range. A group that holds a third of
all rows is as many ranges as it takes, and no task sees more of it than one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kwforge.sources.shared import cut


def middle_pair(df: DataFrame, keys: list[str], value: str, parts: int | None = None) -> DataFrame:
    """(*keys, n, low, high): the group's rows with a value, and its two middle values (one twice if n is odd).

    Null values are left out, and groups without any other; null keys are a group. Of doubles, NaN is the largest.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count("*").alias("c"))
    order = [*keys, "value"]
    dealt = cut(counts.repartitionByRange(*([parts] if parts else []), *order).withColumn("part", F.spark_partition_id()), "counts")
    group = F.struct(*keys).alias("g")
    held = dealt.groupBy(group, "part").agg(F.sum("c").alias("c"))
    by_group = Window.partitionBy("g")  # a row for each range that the group is in
    ahead = by_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("g", "part", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("before"), F.col("c").alias("here"), F.sum("c").over(by_group).alias("n"))
    lower, upper = F.expr("(n + 1) div 2"), F.expr("n div 2 + 1")
    # only the ranges with a middle value are looked into
    held = held.filter((F.col("before") < upper) & (F.col("before") + F.col("here") >= lower))
    rows = dealt.select(group, "part", "value", "c").join(held.select("g", "part", "before", "n"), ["g", "part"])
    within = Window.partitionBy("part", "g").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = rows.withColumn("upto", F.col("before") + F.sum("c").over(within)).withColumn("from", F.col("upto") - F.col("c"))
    at = lambda rank: F.max(F.when((F.col("from") < rank) & (F.col("upto") >= rank), F.col("value")))
    return reached.groupBy("g").agg(F.first("n").alias("n"), at(lower).alias("low"), at(upper).alias("high")).select("g.*", "n", "low", "high")
