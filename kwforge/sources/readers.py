"""Readers of keyword rows and of saved trees; every reader is a Spark source, so any store will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kwforge.functions.text import TOKENIZERS
from kwforge.sources.shared import cut

_FIELDS = ("keywords", "tokens", "query", "text", "content")


def from_lines(spark: SparkSession, path: str, tokenizer: str = "piped") -> DataFrame:
    """(line, kws) of the non-blank lines of a text file; blank lines take no number."""
    return _kept(spark.read.text(path).select(TOKENIZERS[tokenizer](F.col("value")).alias("kws")))


def from_csv(spark: SparkSession, path: str, column: str | None = None, header: bool = True, tokenizer: str = "piped") -> DataFrame:
    """(line, kws): the named column, split; else one filled cell is split, and each of several filled cells is one keyword."""
    df = spark.read.csv(path, header=header, quote='"', escape='"')
    if column:
        return _kept(df.select(TOKENIZERS[tokenizer](F.col(f"`{column}`")).alias("kws")))
    cells = F.filter(F.transform(F.array(*(F.col(f"`{c}`") for c in df.columns)), lambda c: F.trim(c)), lambda c: c != "")
    return _kept(df.select(cells.alias("cells")).select(F.when(F.size("cells") == 1, TOKENIZERS[tokenizer](F.col("cells")[0])).otherwise(F.col("cells")).alias("kws")))


def from_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(line, kws): the first of keywords, tokens, query, text, content that a line has and that is not null, a list or a string.

    A line without any of them is an error. What a field holds tells a list from a string, not how its text begins.
    """
    parsed = F.from_json("value", ", ".join(f"{f} variant" for f in _FIELDS))
    value = F.coalesce(*(F.when(~F.is_variant_null(F.col("j")[f]), F.col("j")[f]) for f in _FIELDS))
    rows = spark.read.text(path).filter(F.trim("value") != "").select(parsed.alias("j")).select(value.alias("v"))
    as_list = F.filter(F.transform(F.try_variant_get("v", "$", "array<string>"), lambda w: F.trim(w)), lambda w: w != "")
    listed = F.when(F.schema_of_variant("v").startswith("ARRAY"), as_list).otherwise(TOKENIZERS["piped"](F.try_variant_get("v", "$", "string")))
    checked = F.when(F.col("v").isNull(), F.raise_error(F.lit("a line has none of the fields " + ", ".join(_FIELDS)))).otherwise(listed)
    return _kept(rows.select(checked.alias("kws")))


def token_lines(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """(line, kws) of a file of one token line a row under a heading: the heading and quotes go, rows of fewer than `least` tokens too."""
    rows = _numbered(spark.read.text(path).filter(F.trim("value") != ""))
    kws = TOKENIZERS["quoted"](F.col("value"))
    return _numbered(rows.filter("line > 0").select(kws.alias("kws")).filter(F.size("kws") >= least))


def load_workload(spark: SparkSession, path: str, vocab: DataFrame, drop_unknown: bool = True, drop_empty: bool = True) -> tuple[DataFrame, DataFrame]:
    """(queries (query_id, position, kw_id), counts of one row) of a file of one query a line.

    Blank lines and the heading Title are no queries. Repeated keywords of a query stay. A keyword that the vocabulary
    lacks is dropped, or kept as -1; a query that then has none is skipped, or keeps its number without a row. counts:
    queries, skipped, tokens, unknown.
    """
    lines = _numbered(spark.read.text(path).select(F.trim("value").alias("value")).filter((F.col("value") != "") & (F.lower("value") != "title")))
    return workload_ids(lines.select(F.col("line").alias("query_id"), TOKENIZERS["piped"](F.col("value")).alias("kws")), vocab, drop_unknown, drop_empty)


def workload_ids(queries: DataFrame, vocab: DataFrame, drop_unknown: bool = True, drop_empty: bool = True) -> tuple[DataFrame, DataFrame]:
    """load_workload for queries that are at hand as (query_id, kws)."""
    each = queries.select("query_id", F.posexplode_outer("kws").alias("position", "kw")).join(vocab, "kw", "left")
    per = each.groupBy("query_id").agg(F.count("kw").alias("tokens"), F.count("kw_id").alias("known"))
    counts = per.agg(
        F.count("*").alias("queries"), F.count_if(F.col("known" if drop_unknown else "tokens") == 0).alias("skipped"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.col("tokens") - F.col("known")), F.lit(0)).alias("unknown"),
    )
    found = each.filter("kw_id IS NOT NULL" if drop_unknown else "kw IS NOT NULL").select("query_id", "position", F.coalesce("kw_id", F.lit(-1)).alias("kw_id"))
    if not drop_empty:
        gone = per.filter(F.col("known" if drop_unknown else "tokens") == 0).select("query_id", F.lit(None).cast("int").alias("position"), F.lit(None).cast("long").alias("kw_id"))
        found = found.unionByName(gone)
    return found, counts


def _numbered(df: DataFrame) -> DataFrame:
    """The rows with `line`, dense from 0 in file order.

    The rows are written with the partition that they were read in; each partition counts its own rows, and the small
    table of partitions gives the number of rows before each.
    """
    rows = cut(df.withColumn("place", F.monotonically_increasing_id()), "lines").withColumn("part", F.shiftright("place", 33))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("part").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("part").orderBy("place"))
    return rows.withColumn("r", within).join(F.broadcast(base), "part").select((F.col("base") + F.col("r") - 1).cast("long").alias("line"), *df.columns)


def _kept(df: DataFrame) -> DataFrame:
    return _numbered(df.select(F.array_distinct("kws").alias("kws")).filter(F.size("kws") > 0))


def read_keywords(spark: SparkSession, path: str, **options) -> DataFrame:
    """Dispatch on the file's extension."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind in ("txt", "tsv"):
        return from_lines(spark, path, **options)
    if kind == "csv":
        return from_csv(spark, path, **options)
    if kind in ("json", "jsonl"):
        return from_jsonl(spark, path, **options)
    raise ValueError(f"no reader for .{kind} files")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(kw, kw_id) of a JSON object of keyword to id."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,bigint>").alias("m"))
    return whole.select(F.explode("m").alias("kw", "kw_id"))


_TREE = {"edges": "parent long, child_pos int, child long", "leaves": "obj_id long, kw string, leaf_id long", "node_kw": "node_id long, kw string"}


def save_tree(path: str, edges: DataFrame, leaves: DataFrame, node_kw: DataFrame) -> None:
    """Three tables: edges, leaves (obj_id, kw, leaf_id), node_kw. Leaf objects lie in a folder a leaf, so a search over few leaves reads few files."""
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    leaves.repartition("leaf_id", F.pmod(F.xxhash64("obj_id"), F.lit(16))).write.mode("overwrite").partitionBy("leaf_id").parquet(f"{path}/leaves")
    node_kw.write.mode("overwrite").parquet(f"{path}/node_kw")


def load_tree(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, leaves, node_kw)."""
    return tuple(spark.read.schema(schema).parquet(f"{path}/{t}") for t, schema in _TREE.items())
