"""Operator 8, sharding: a consistent-hash ring with virtual nodes and bounded loads.

Every key lies on a ring by its hash; a shard owns the arcs before its virtual nodes. A shard takes keys until it is
full; what overflows continues clockwise to the next shard that has room. The load here is rows, with capacities that
add up to the number of rows and are at most one apart, so row counts are at most one apart whatever the keys are.

How it scales: the ring is cut into a fixed number of cells. One aggregation counts the rows of each cell; the driver
walks that bounded table once and says, for each cell, which run of its rows (in the order of hash, then id) goes to
which shard and from which slot. Rows then find their place by their rank in their cell and a range join against the
bounded plan. A cell holds one part in `cells` of all rows; `cells` can grow with the table. One id, or the rows without
one, may be a large part of the table and lie in one cell: a cell of more than `hot` times the mean is ranked in
`PARTS` parts, dealt row by row, each from where the parts before it end.

Nulls: a null text has 0 bytes and checksum 0; rows with a null id are placed as rows of one key. Repeated rows are
rows of their own; a repeated id of many rows splits over shards. An empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

import bisect
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kwforge.llm.common import cut, table

#: Parts that a hot cell is ranked in.
PARTS = 64


def _point(*parts) -> int:
    import xxhash

    return xxhash.xxh64_intdigest("/".join(map(str, parts)))


def ring(shards: list, virtual_nodes: int, cells: int) -> list[tuple[int, object]]:
    """Virtual nodes as (cell, shard) in clockwise order. A shard's points depend on its name alone."""
    return sorted((_point("node", s, v) % cells, s) for s in shards for v in range(virtual_nodes))


def place_cells(counts: dict[int, int], shards: list, capacity: dict, virtual_nodes: int, cells: int) -> list[tuple[int, int, int, object, int]]:
    """Runs (cell, from_rank, to_rank, shard, first_slot) that place every row of every cell.

    First each shard takes what lies on its own arcs, clockwise, while it has room; then the rest goes round the ring
    as a queue and each node takes from its front what its shard has room for.
    """
    nodes = ring(shards, virtual_nodes, cells)
    at = [c for c, _ in nodes]
    left = dict(capacity)
    slot = dict.fromkeys(shards, 0)
    runs, over = [], [deque() for _ in nodes]

    def take(cell: int, start: int, n: int, shard) -> int:
        got = min(n, left[shard])
        if got:
            runs.append((cell, start, start + got, shard, slot[shard]))
            slot[shard] += got
            left[shard] -= got
        return got

    for cell in sorted(counts):
        i = bisect.bisect_left(at, cell) % len(nodes)
        got = take(cell, 0, counts[cell], nodes[i][1])
        if got < counts[cell]:
            over[i].append((cell, got, counts[cell] - got))
    moving: deque = deque()
    for turn in range(2 * len(nodes)):
        i = turn % len(nodes)
        while moving and left[nodes[i][1]]:
            cell, start, n = moving.popleft()
            got = take(cell, start, n, nodes[i][1])
            if got < n:
                moving.appendleft((cell, start + got, n - got))
        moving.extend(over[i])
        over[i].clear()
    if moving:
        raise ValueError("capacities are smaller than the number of rows")
    return runs


def shard_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 40, virtual_nodes: int = 64, cells: int = 1 << 14, hot: int = 16) -> DataFrame:
    """Place every row: id, size, text_crc32, shard, slot (gapless from 0 in a shard)."""
    h = F.xxhash64(F.col("id"))
    rows = df.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(16)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    # written once, without texts: counts and ranks must see the same parts
    keyed = cut(rows.withColumns({"h": h, "cell": F.pmod(h, F.lit(cells)).cast("int"), "deal": F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int")}), "keyed")
    counts = {r["cell"]: r["n"] for r in keyed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    shards = list(range(n_shards))
    by_point = sorted(shards, key=lambda s: _point("spare", s))
    capacity = {s: total // n_shards + (k < total % n_shards) for k, s in enumerate(by_point)}
    runs = place_cells(counts, shards, capacity, virtual_nodes, cells)
    spark = df.sparkSession
    plan = spark.createDataFrame(runs or [(-1, 0, 0, 0, 0)], "cell int, from_rank long, to_rank long, shard int, first_slot long")
    # the plan has at most one row for each cell and one for each time a shard fills: a bound that no input changes
    crowded = sorted(c for c, n in counts.items() if n * cells > hot * total and n > PARTS)  # under cells / hot of them
    parted = keyed.withColumn("part", F.when(F.col("cell").isin(crowded), F.col("deal")).otherwise(F.lit(0)) if crowded else F.lit(0))
    within = parted.filter(F.col("cell").isin(crowded)).groupBy("cell", "part").agg(F.count("*").alias("n")).collect() if crowded else []
    ahead, at = [], dict.fromkeys(crowded, 0)
    for r in sorted(within, key=lambda r: (r["cell"], r["part"])):
        ahead.append((r["cell"], r["part"], at[r["cell"]]))
        at[r["cell"]] += r["n"]
    before = spark.createDataFrame(ahead or [(-1, 0, 0)], "cell int, part int, before long")
    rank = Window.partitionBy("cell", "part").orderBy("h", "id", "text_crc32", "size")
    ranked = parted.withColumn("rank", F.row_number().over(rank).cast("long") - 1).join(F.broadcast(before), ["cell", "part"], "left")
    ranked = ranked.withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
    placed = ranked.join(F.broadcast(plan), (ranked.cell == plan.cell) & (ranked["rank"] >= plan.from_rank) & (ranked["rank"] < plan.to_rank))
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("first_slot") + F.col("rank") - F.col("from_rank")).alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_rows(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
