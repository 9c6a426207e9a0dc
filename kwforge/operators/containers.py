"""Compressed bitmaps: chunks of 2^15 positions, each kept in the form that is smallest for it.

A container is one row (*keys, chunk, kind, n, data): `array` holds the sorted offsets (two bytes each), `runs` the start
and length less one of every run (four bytes a run), `bitmap` 1,024 words of 32 bits. A key, however frequent, is one
small row a chunk; no row is above 4,096 bytes as counted here.

An intersection goes from the smallest container of a chunk on: offsets are looked up in the next one by its kind, and two
bitmaps are put together word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK, WORDS, BITS = 1 << 15, 1 << 10, 32
ARRAY, RUNS, BITMAP = "array", "runs", "bitmap"


def _bits(word: Column, bits: Column) -> Column:
    """Offsets of a word's set bits, looked up byte by byte: the work is that of the bits that are set, not of all 32."""
    told = F.lit([[b for b in range(8) if byte >> b & 1] for byte in range(256)])
    byte = lambda k: F.get(told, F.shiftrightunsigned(bits, 8 * k).bitwiseAND(F.lit(255)))
    at = lambda k: F.transform(byte(k), lambda b: word * F.lit(BITS) + F.lit(8 * k) + b)
    return F.concat(*(at(k) for k in range(BITS // 8)))


def _dense(words: Column) -> Column:
    """All 1,024 words from the sorted (word, bits) that are not zero: each behind the zeros since the one before it."""
    zeros = lambda n: F.array_repeat(F.lit(0), n)
    after = lambda i: F.coalesce(F.get(words, i)["word"] + 1, F.lit(0))
    filled = F.flatten(F.transform(words, lambda w, i: F.concat(zeros(w["word"] - after(i - 1)), F.array(w["bits"]))))
    return F.concat(filled, zeros(F.lit(WORDS) - after(F.size(words) - 1)))


def encode(pairs: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Containers of (*keys, position); positions are not negative, and may repeat."""
    p = F.col(position)
    placed = pairs.select(*keys, F.floor(p / CHUNK).cast("long").alias("chunk"), F.floor(F.pmod(p, F.lit(CHUNK)) / BITS).cast("int").alias("word"), F.expr(f"shiftleft(1, cast(pmod(`{position}`, {BITS}) as int))").alias("bit"))
    words = placed.groupBy(*keys, "chunk", "word").agg(F.bit_or("bit").alias("bits"))
    lists = words.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"))  # 1,024 at most
    offsets = lists.withColumn("offsets", F.flatten(F.transform("words", lambda w: _bits(w["word"], w["bits"])))).withColumn("n", F.size("offsets"))
    edge = lambda step: F.filter("offsets", lambda x, i: ~F.coalesce(F.get("offsets", i + step) == x + step, F.lit(False)))
    runs = offsets.withColumns({"starts": edge(-1), "ends": edge(1)})
    small, few = 2 * F.col("n"), 4 * F.size("starts")
    kind = F.when((small <= few) & (small <= 4 * WORDS), F.lit(ARRAY)).when(few <= 4 * WORDS, F.lit(RUNS)).otherwise(F.lit(BITMAP))
    data = (
        F.when(F.col("kind") == ARRAY, F.col("offsets"))
        .when(F.col("kind") == RUNS, F.flatten(F.zip_with("starts", "ends", lambda s, e: F.array(s, e - s))))
        .otherwise(_dense(F.col("words")))
    )
    return runs.withColumn("kind", kind).select(*keys, "chunk", "kind", F.col("n").cast("int").alias("n"), data.cast("array<int>").alias("data"))


def _offsets(kind: Column, data: Column) -> Column:
    """Sorted offsets of a container of any kind."""
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.size(data) / 2).cast("int") - 1)), lambda i: F.sequence(F.get(data, i * 2), F.get(data, i * 2) + F.get(data, i * 2 + 1)))
    words = F.flatten(F.transform(data, lambda bits, i: _bits(i, bits)))
    return F.when(kind == ARRAY, data).when(kind == RUNS, F.flatten(pairs)).otherwise(words)


def _held(kind: Column, data: Column, x: Column) -> Column:
    """Whether a bitmap or a list of runs holds an offset; runs are found by halving."""
    in_bitmap = F.getbit(F.get(data, F.floor(x / BITS).cast("int")), x % BITS) == 1
    # the last run that starts at or before x, by 10 halvings of at most 1,024 runs
    last = F.aggregate(
        F.sequence(F.lit(0), F.lit(9)), F.lit(0),
        lambda at, k: F.when(F.coalesce(F.get(data, (at + F.pow(F.lit(2), F.lit(9) - k).cast("int")) * 2) <= x, F.lit(False)), at + F.pow(F.lit(2), F.lit(9) - k).cast("int")).otherwise(at),
    )
    in_runs = F.aggregate(F.array(last), F.lit(False), lambda _, r: (F.get(data, r * 2) <= x) & (x <= F.get(data, r * 2) + F.get(data, r * 2 + 1)))
    return F.when(kind == BITMAP, in_bitmap).otherwise(in_runs)


def decode(containers: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, position) of every position that is set."""
    return containers.select(*keys, "chunk", F.explode(_offsets(F.col("kind"), F.col("data"))).alias("o")).select(*keys, (F.col("chunk") * CHUNK + F.col("o")).alias("position"))


def intersect(containers: DataFrame, queries: DataFrame, key: str = "kw") -> DataFrame:
    """(query_id, position): positions that the containers of all of a query's keys hold.

    A group is the containers of one query and chunk: as many as the query has keys.
    """
    size = queries.groupBy("query_id").agg(F.count("*").alias("q"))
    met = containers.join(queries, key).groupBy("query_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("n", "kind", "data"))).alias("c"))
    whole = met.join(size, "query_id").filter(F.size("c") == F.col("q"))
    state = lambda kind, data: F.struct(kind.alias("kind"), data.alias("data"))

    def begin(c: Column) -> Column:
        is_bitmap = c["kind"] == BITMAP
        return state(F.when(is_bitmap, F.lit(BITMAP)).otherwise(F.lit(ARRAY)), F.when(is_bitmap, c["data"]).otherwise(_offsets(c["kind"], c["data"])))

    def both(s: Column, c: Column) -> Column:
        words = F.zip_with(s["data"], c["data"], lambda a, b: a.bitwiseAND(b))
        two_bitmaps = (s["kind"] == BITMAP) & (c["kind"] == BITMAP)
        mine = F.when(s["kind"] == BITMAP, _offsets(s["kind"], s["data"])).otherwise(s["data"])
        found = F.when(c["kind"] == ARRAY, F.array_intersect(mine, c["data"])).otherwise(F.filter(mine, lambda x: _held(c["kind"], c["data"], x)))
        return state(F.when(two_bitmaps, F.lit(BITMAP)).otherwise(F.lit(ARRAY)), F.when(two_bitmaps, words).otherwise(found))

    folded = F.aggregate(F.slice("c", F.lit(2), F.size("c")), begin(F.get("c", F.lit(0))), both)
    left = whole.select("query_id", "chunk", folded.alias("s")).select("query_id", "chunk", F.explode(_offsets(F.col("s.kind"), F.col("s.data"))).alias("o"))
    return left.select("query_id", (F.col("chunk") * CHUNK + F.col("o")).alias("position"))


def sizes(containers: DataFrame) -> DataFrame:
    """(kind, containers, positions, bytes)."""
    size = F.when(F.col("kind") == ARRAY, 2 * F.col("n")).when(F.col("kind") == RUNS, 2 * F.size("data")).otherwise(F.lit(4 * WORDS))
    return containers.groupBy("kind").agg(F.count("*").alias("containers"), F.sum("n").alias("positions"), F.sum(size).cast("long").alias("bytes"))
