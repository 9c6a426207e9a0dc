"""Operator 13, conversation prefix trie, merged family by family first.

A family is the hundred conversation ids from a base id (a multiple of a hundred) on. Each conversation is rebuilt: its
first h turns are the base's, h following from its id, and the rest are its own. The trie's nodes are the distinct
beginnings of rebuilt conversations.

1. Turns shrink to 128-bit digests of role and text, and their code points, in the scan. The digests are dealt into
   ranges of (conversation, turn) and written. Ids of a family lie side by side, so a family is in one slice, or in a few
   adjacent ones; no conversation, however long, is more than a slice in any task.
2. One context row for each conversation and slice, with the base's first turns (five at most), what lies in earlier
   slices, and the digest so far, is cogrouped with the slice's turns by (slice, base id): both go through one exchange.
   There the conversations are rebuilt. A beginning is named by the exclusive or of 128-bit hashes of (turn, place), so a
   conversation that is cut by a slice goes on from the digest so far.
3. Within that partitioning each family's nodes are combined, without a shuffle. Only combined family nodes are shuffled
   to be merged by node.
4. Sums over subtrees come by doubling: in round k a node adds what its descendants 2^k levels below hold, so rounds grow
   with the logarithm of the depth. Only nodes of two members or more take part; below one with a single member there is
   one leaf and nothing to save.
5. Members that end at a node are hashed in order: families hand over their own sorted ids, these are dealt into ranges
   and joined to runs, and one stream over the runs updates the hash. A node that a third of all conversations ends at is
   sorted in parts and hashed in constant memory.

Two different beginnings would be taken for one with a probability of about n^2 / 2^129 for n nodes.

Cases: rows without a conversation id are left out. Null roles and texts are empty ones. A null turn comes first. Rows of
one turn number come in the order of their digests; repeated rows are turns of their own. A conversation that is left
without turns is a member of the root. For negative ids the base is the next lower multiple of a hundred. No
conversations: no nodes. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kwforge.llm.common import cut, each_salt, salt, salts_met, table

#: Ids of a family, and the number of values that h has: 0 to 5.
FAMILY, HEADS = 100, 6


def _mark(a: Column, b: Column, place: Column) -> tuple[Column, Column]:
    """The two halves of a turn's mark at its place in the rebuilt conversation."""
    return F.xxhash64(a, b, place.cast("long")), F.xxhash64(b, place.cast("long"), a)


def _base(conv_id: str = "conv_id") -> Column:
    return F.col(conv_id) - F.pmod(F.col(conv_id), F.lit(FAMILY))


def slices(conversations: DataFrame, parts: int | None = None) -> DataFrame:
    """(conv_id, turn, a, b, chars, tie, part): digests of turns in ranges of (conv_id, turn, digest), written.

    Rows that are equal in all of these are told apart by their place in the scan, so many repeated rows are split too.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("tie"),
    )
    return cut(rows.repartitionByRange(*([parts] if parts else []), "conv_id", *_ORDER).withColumn("part", F.spark_partition_id()), "turns")


#: Spark puts nulls first.
_ORDER = ("turn", "a", "b", "tie")


def _contexts(turns: DataFrame) -> DataFrame:
    """One row for each (part, conv_id): base, h, own turns in earlier slices and in all, the base's first turns, the digest so far."""
    by_conv = Window.partitionBy("conv_id")
    earlier = by_conv.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = turns.groupBy("part", "conv_id").agg(F.count("*").alias("n"))
    pieces = pieces.select("part", "conv_id", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(by_conv).alias("own"))
    pieces = cut(pieces.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).withColumn("base", _base()), "pieces")
    in_piece = Window.partitionBy("part", "conv_id").orderBy(*_ORDER)
    first = turns.filter(F.pmod("conv_id", F.lit(FAMILY)) == 0).withColumn("r", F.row_number().over(in_piece)).filter(F.col("r") < HEADS)
    placed = first.join(pieces.filter(F.col("before") < HEADS).select("part", "conv_id", "before"), ["part", "conv_id"]).withColumn("i", (F.col("before") + F.col("r") - 1).cast("int")).filter(F.col("i") < HEADS - 1)
    heads = placed.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("i", "a", "b", "chars"))).alias("head"))
    none = F.array().cast("array<struct<i:int,a:bigint,b:bigint,chars:bigint>>")
    known = pieces.join(heads, "base", "left").withColumn("head", F.coalesce("head", none)).withColumn("m", F.least("h", F.size("head")))
    known = cut(known, "contexts")
    # a slice goes on with one conversation of the slice before at most: as many of these as slices, whatever the rows
    going_on = known.filter("before > 0").select("conv_id").distinct()
    cut_up = turns.join(F.broadcast(going_on), "conv_id", "left_semi").withColumn("r", F.row_number().over(in_piece))
    cut_up = cut_up.join(known.select("part", "conv_id", "before", "h", "m"), ["part", "conv_id"]).withColumn("i", F.col("before") + F.col("r") - 1).filter("i >= h")
    x, y = _mark(F.col("a"), F.col("b"), F.col("i") - F.col("h") + F.col("m"))
    sums = cut_up.groupBy("part", "conv_id").agg(F.bit_xor(x).alias("x"), F.bit_xor(y).alias("y"))
    parts = known.filter("own > 0").join(F.broadcast(going_on), "conv_id", "left_semi").select("part", "conv_id").join(sums, ["part", "conv_id"], "left")
    so_far = parts.select("part", "conv_id", F.coalesce(F.bit_xor("x").over(earlier), F.lit(0)).alias("x0"), F.coalesce(F.bit_xor("y").over(earlier), F.lit(0)).alias("y0"))
    return known.join(so_far, ["part", "conv_id"], "left").na.fill(0, ["x0", "y0"])


def family_nodes(turns: DataFrame, contexts: DataFrame) -> DataFrame:
    """(part, base, node, up, depth, chars, conv_id, n_convs, ends) of each family in each slice; ends are the ids that end there."""
    context = F.struct("before", "own", "h", "m", "head", "x0", "y0").alias("c")
    told = contexts.select("part", "base", "conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("tie"), context)
    rows = turns.select("part", _base().alias("base"), "conv_id", F.lit(1).alias("kind"), "turn", "a", "b", "chars", "tie", F.lit(None).cast(told.schema["c"].dataType).alias("c"))
    met = told.unionByName(rows).repartition("part", "base")  # the cogroup: windows and groups below keep this partitioning
    order = Window.partitionBy("part", "base", "conv_id").orderBy("kind", *_ORDER)
    w = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = met.withColumn("c", F.first("c").over(w)).withColumn("i", F.col("c.before") + F.row_number().over(order) - 2)
    own = (F.col("kind") == 1) & (F.col("i") >= F.col("c.h"))
    place = F.col("i") - F.col("c.h") + F.col("c.m")
    x, y = _mark(F.col("a"), F.col("b"), place)
    met = met.withColumn("x", F.bit_xor(F.when(own, x)).over(w)).withColumn("y", F.bit_xor(F.when(own, y)).over(w))
    marks = lambda half, k: F.aggregate(F.slice("c.head", F.lit(1), k), F.lit(0).cast("long"), lambda z, t: z.bitwiseXOR(_mark(t["a"], t["b"], t["i"])[half]))
    name = lambda *halves: F.struct(*(z.alias(n) for z, n in zip(halves, ("x", "y"), strict=True)))
    begun = [F.coalesce(F.col(v), F.lit(0)).bitwiseXOR(F.col(f"c.{v}0")).bitwiseXOR(marks(i, F.col("c.m").cast("int"))) for i, v in enumerate("xy")]
    length = F.col("c.m") + F.greatest(F.col("c.own") - F.col("c.h"), F.lit(0))
    node = lambda at, up, depth, chars: F.struct(at.alias("node"), up.alias("up"), depth.cast("long").alias("depth"), chars.alias("chars"))
    mine = F.array(node(name(*begun), name(begun[0].bitwiseXOR(x), begun[1].bitwiseXOR(y)), place + 1, F.col("chars")))
    nowhere = F.lit(None).cast("struct<x:bigint,y:bigint>")
    # the root and the base's turns, told once, by the context of the conversation's first slice
    given = F.transform(
        F.sequence(F.lit(0), F.col("c.m").cast("int")),
        lambda k: node(name(marks(0, k), marks(1, k)), F.when(k > 0, name(marks(0, k - 1), marks(1, k - 1))).otherwise(nowhere), k, F.coalesce(F.get("c.head", k - 1)["chars"], F.lit(0))),
    )
    each = F.when(own, mine).when((F.col("kind") == 0) & (F.col("c.before") == 0), given).otherwise(F.array().cast("array<struct<node:struct<x:bigint,y:bigint>,up:struct<x:bigint,y:bigint>,depth:bigint,chars:bigint>>"))
    nodes = met.select("part", "base", "conv_id", length.alias("length"), F.explode(each).alias("n")).select("part", "base", "conv_id", "length", "n.*")
    # a family has a hundred ids at most, and so have its lists
    return nodes.groupBy("part", "base", "node").agg(
        F.first("up").alias("up"), F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        F.array_sort(F.collect_list(F.when(F.col("depth") == F.col("length"), F.col("conv_id")))).alias("ends"),
    )


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, y, digest) from runs (x, y, slice, ids) in order; the hash goes on from batch to batch."""
    at, h = None, None
    for batch in batches:
        done = []
        for x, y, ids in zip(*(batch.column(n).to_pylist() for n in ("x", "y", "ids")), strict=True):
            if (x, y) == at:
                h.update(b",")
            else:
                if at:
                    done.append((*at, h.hexdigest()))
                at, h = (x, y), hashlib.sha256()
            h.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["x", "y", "digest"])
    if at:
        yield pa.RecordBatch.from_pydict({"x": [at[0]], "y": [at[1]], "digest": [h.hexdigest()]})


def ends_digests(families: DataFrame) -> DataFrame:
    """(node, digest): SHA-256 of the ids that end at a node, ascending, joined by commas; nodes where none ends are absent."""
    lists = families.filter(F.size("ends") > 0).select("node", "base", "part", F.array_join(F.col("ends").cast("array<string>"), ",").alias("ids"))
    dealt = lists.repartitionByRange("node", "base", "part").withColumn("slice", F.spark_partition_id())
    runs = dealt.groupBy("slice", "node").agg(F.array_sort(F.collect_list(F.struct("base", "part", "ids"))).alias("l"))
    runs = runs.select("node.x", "node.y", "slice", F.array_join("l.ids", ",").alias("ids"))
    hashed = runs.repartition("x", "y").sortWithinPartitions("x", "y", "slice").mapInArrow(_hash_runs, "x long, y long, digest string")
    return hashed.select(F.struct("x", "y").alias("node"), "digest")


def _meet(rows: DataFrame, key: str, told: DataFrame) -> DataFrame:
    """rows joined to the one row of told (node, mask, ...) that their key names; the rows of a key are dealt into parts."""
    copies = told.withColumn("salt", each_salt()).drop("mask").withColumnRenamed("node", key)
    return rows.withColumn("salt", salt("node")).join(copies, [key, "salt"]).drop("salt")


def subtree_sums(shared: DataFrame) -> DataFrame:
    """(node, leaves, saved) summed over subtrees, for (node, up, depth, leaves, saved) where up is null at the top."""
    sums = cut(shared.select("node", "leaves", "saved"), "sums")
    jumps = cut(shared.filter("up IS NOT NULL").select("node", "up"), "jumps")
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    step = 1
    while step <= deepest:
        below = jumps.join(sums, "node").groupBy(F.col("up").alias("node")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        joined = sums.join(below, "node", "left").na.fill(0)
        sums = cut(joined.select("node", (F.col("leaves") + F.col("more_leaves")).alias("leaves"), (F.col("saved") + F.col("more_saved")).alias("saved")), "sums")
        step *= 2
        if step <= deepest:
            # masks say which parts the rows that jump to a node are in, so that its row is copied to these alone
            met = jumps.withColumn("salt", salt("node")).groupBy(F.col("up").alias("node")).agg(salts_met("salt").alias("mask"))
            up = jumps.select("node", F.col("up").alias("next")).join(met, "node")
            jumps = cut(_meet(jumps, "up", up).select("node", F.col("next").alias("up")), "jumps")
    return sums


def prefix_trie(conversations: DataFrame, parts: int | None = None) -> DataFrame:
    """The merged trie of conversations (conv_id, turn, role, text), one row a node; parts: slices, if not Spark's choice.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, chars.
    """
    turns = slices(conversations, parts)
    families = cut(family_nodes(turns, _contexts(turns)), "family-nodes")
    merged = families.groupBy("node").agg(F.first("up").alias("up"), F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    merged = cut(merged, "nodes")
    kids = merged.filter("up IS NOT NULL").withColumn("salt", salt("node")).groupBy(F.col("up").alias("node")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("single"), salts_met("salt").alias("mask"))
    nodes = cut(merged.join(kids, "node", "left").na.fill(0, ["n_children", "single", "mask"]), "nodes")
    shared = nodes.filter("n_convs > 1")
    leaves = F.col("single") + F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.lit(0))
    sums = subtree_sums(cut(shared.select("node", "up", "depth", leaves.alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")), "shared"))
    parents = nodes.filter("n_children > 0").select("node", "mask", F.col("conv_id").alias("parent_conv_id"))
    below = _meet(nodes.filter("up IS NOT NULL").drop("mask"), "up", parents)
    top = nodes.filter("up IS NULL").drop("mask").withColumn("parent_conv_id", F.lit(None).cast("long"))
    all_ = below.unionByName(top).join(sums, "node", "left").join(ends_digests(families), "node", "left")
    return all_.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "chars",
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("chars")


#: CRC-32 of a decimal number by its definition: bits shifted out of each byte in turn.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(CAST({0} AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST({0} AS VARCHAR), CAST(i AS INTEGER), 1)) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)), CAST(4294967295 AS BIGINT))"""

#: The same nodes in DuckDB, with whole beginnings as keys. Rows of one turn number come in no set order there.
SQL = f"""WITH t AS (SELECT conv_id, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, own, {_CRC.format('conv_id')} % 6 AS h FROM t),
b AS (SELECT h.conv_id, CASE WHEN p.own IS NULL THEN h.own[h.h + 1:] ELSE list_concat(p.own[1:h.h], h.own[h.h + 1:]) END AS path FROM h LEFT JOIN t p ON p.conv_id = h.conv_id - h.conv_id % 100),
m AS (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM b),
g AS (SELECT path[1:d] AS p, d, min(conv_id) AS conv_id, count(*) AS n, string_agg(CASE WHEN len(path) = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS e FROM m GROUP BY ALL),
k AS (SELECT p[1:d - 1] AS p, count(*) AS kids FROM g WHERE d > 0 GROUP BY ALL), g2 AS (SELECT g.*, coalesce(kids, 0) AS kids FROM g LEFT JOIN k USING (p)),
a AS (SELECT p[1:j] AS p, count(*) FILTER (kids = 0) AS leaves, sum(CASE WHEN d = 0 THEN 0 ELSE (n - 1) * length(p[d].x) END) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM g2) GROUP BY ALL)
SELECT g2.conv_id, g2.d AS depth, u.conv_id AS parent_conv_id, g2.n AS n_convs, g2.kids AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(g2.e, '')) AS ends_sha256
FROM g2 JOIN a ON a.p = g2.p LEFT JOIN g u ON g2.d > 0 AND u.p = g2.p[1:g2.d - 1]"""
