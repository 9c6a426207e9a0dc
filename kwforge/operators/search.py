"""Batched keyword search: which objects hold all, or any, of a query's keywords.

All-keyword search is relational division. Objects are read once: most keywords are in no query, so the pairs whose
keyword is in one are a small table, written before the search proper. Each query enters at its rarest keyword only,
so the candidates are as many as the shortest posting lists allow; a candidate is then checked by the other keywords.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kwforge.sources.shared import cut

#: Pairs of queries that a broadcast may have.
FEW = 1 << 16


def few(queries: DataFrame) -> bool:
    """Whether queries can be broadcast."""
    return queries.limit(FEW + 1).count() <= FEW


def held_pairs(objects: DataFrame, queries: DataFrame) -> DataFrame:
    """The object pairs whose keyword is in some query, as a written table: the one pass over the objects."""
    return cut(objects.join(queries.select("kw").distinct(), "kw", "left_semi"), "held")


def contains_all(objects: DataFrame, queries: DataFrame, unknown: str = "fail", held: DataFrame | None = None) -> DataFrame:
    """(query_id, obj_id) for every object that holds every keyword of the query.

    objects (obj_id, kw) and queries (query_id, kw) are distinct pairs. unknown="drop" ignores keywords that no object
    has; "fail" lets such a query match nothing. An empty query matches nothing. held: what held_pairs gave for these
    queries, if it is at hand.
    """
    held = held_pairs(objects, queries) if held is None else held
    df = held.groupBy("kw").agg(F.count("*").alias("df"))
    known = queries.join(df, "kw", "inner" if unknown == "drop" else "left")
    # a query is one row: its keywords in ascending frequency; one without objects comes first
    sorted_kws = F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("kw"))))
    entry = known.groupBy("query_id").agg(sorted_kws.alias("k")).filter("k[0].df > 0")
    pivot = entry.select("query_id", F.col("k")[0]["kw"].alias("kw"), F.transform(F.slice("k", F.lit(2), F.size("k")), lambda x: x["kw"]).alias("rest"))
    # where queries are few, the pairs stay where they are, and a frequent keyword is spread over all tasks
    candidates = held.join(F.broadcast(pivot) if few(queries) else pivot, "kw").select("query_id", "obj_id", "rest")
    needed = candidates.select("query_id", "obj_id", F.size("rest").alias("q"), F.explode("rest").alias("kw"))
    found = needed.join(held, ["obj_id", "kw"]).groupBy("query_id", "obj_id", "q").agg(F.count("*").alias("m"))
    many = found.filter("m = q").select("query_id", "obj_id")
    return many.unionByName(candidates.filter(F.size("rest") == 0).select("query_id", "obj_id"))


def contains_any(objects: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, obj_id) for every object that holds a keyword of the query."""
    return objects.join(F.broadcast(queries) if few(queries) else queries, "kw").select("query_id", "obj_id").distinct()


def result_sizes(hits: DataFrame, query_ids: DataFrame) -> DataFrame:
    """(query_id, n_results), with 0 for queries without a result."""
    n = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    return query_ids.select("query_id").distinct().join(n, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n_results"))


def object_hits(hits: DataFrame) -> DataFrame:
    """Queries that each object answers."""
    return hits.groupBy("obj_id").agg(F.count("*").alias("n_queries"), F.sum("query_id").alias("query_id_sum"))
