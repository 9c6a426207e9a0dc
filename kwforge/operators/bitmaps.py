"""Sparse bitmaps: words of 32 bits kept in longs, one row a word with a bit set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kwforge.operators.search import few
from kwforge.sources.shared import cut

BITS = 32


def encode(pairs: DataFrame, keys: list[str], position: str, parts: int | None = None) -> DataFrame:
    """(*keys, word_idx, word): bit `position mod 32` of word `position div 32`, lowest bit first.

    parts: the pairs are dealt by word into as many tasks and combined there alone. That bounds a task's memory where few
    pairs share a word, as what a task of the scan combines would grow with the pairs that lie in one split of files.
    """
    p = F.col(position)
    bit = F.expr(f"shiftleft(1L, cast(`{position}` % {BITS} as int))")
    bits = pairs.select(*keys, F.floor(p / BITS).cast("long").alias("word_idx"), bit.alias("bit"))
    bits = bits if parts is None else bits.repartition(parts, *keys, "word_idx")
    return bits.groupBy(*keys, "word_idx").agg(F.bit_or("bit").alias("word"))


def decode(words: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, position) of every set bit."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit(F.col("word"), i) == 1)
    return words.select(*keys, F.col("word_idx"), F.explode(bits).alias("b")).select(*keys, (F.col("word_idx") * BITS + F.col("b")).alias("position"))


def intersect(words: DataFrame, queries: DataFrame, key: str = "kw") -> DataFrame:
    """(query_id, word_idx, word): bits that the words of all of a query's keywords have set.

    A query enters at the keyword that sets the fewest bits, so that only the other keywords' words at its places are met.
    """
    words = cut(words, "words")
    n = words.groupBy(key).agg(F.sum(F.bit_count("word")).alias("n"))
    sorted_keys = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col(key).alias("key"))))
    entry = queries.join(n, key, "left").groupBy("query_id").agg(sorted_keys.alias("k")).filter("k[0].n > 0")
    pivot = entry.select("query_id", F.col("k")[0]["key"].alias(key), F.transform(F.slice("k", F.lit(2), F.size("k")), lambda x: x["key"]).alias("rest"))
    first = words.join(F.broadcast(pivot) if few(queries) else pivot, key).select("query_id", "word_idx", F.col("word").alias("first"), "rest")
    needed = first.select("query_id", "word_idx", "first", F.size("rest").alias("q"), F.explode("rest").alias(key))
    met = needed.join(words, [key, "word_idx"]).groupBy("query_id", "word_idx", "first", "q").agg(F.bit_and("word").alias("word"), F.count("*").alias("m"))
    both = met.filter("m = q").select("query_id", "word_idx", F.col("word").bitwiseAND(F.col("first")).alias("word")).filter("word <> 0")
    return both.unionByName(first.filter(F.size("rest") == 0).select("query_id", "word_idx", F.col("first").alias("word")))
