"""Joins with a side whose size is not known before: keys that may be very frequent, tables that may be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 16
#: Rows of a few numbers that a broadcast may have; a table of more is joined by a shuffle.
FEW = 1 << 20
#: Rows of a table of short rows that a task gets.
ROWS = 1 << 16


def if_few(df: DataFrame, most: int = FEW) -> DataFrame:
    """The table, marked for a broadcast if it has `most` rows at most. It should be cheap to count: written, or a scan."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def deal(df: DataFrame, key: str, rows: int = ROWS) -> DataFrame:
    """The rows of a table, a scan or written, dealt by a key into tasks of about `rows` rows, however few its files are."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // rows)), key)


def join_dealt(rows: DataFrame, told: DataFrame, key: str, by: str, parts: int = PARTS, how: str = "inner") -> DataFrame:
    """rows joined to what is told about their key (how: inner or left); the rows of a key are dealt into parts by another column.

    told is copied to every part, so it should be the smaller table by far (keywords against their occurrences).
    """
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    copies = told.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.join(copies, [key, "_part"], how).drop("_part")
