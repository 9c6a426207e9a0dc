"""Objects and queries as long tables of (id, keyword), with vocabulary, postings and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kwforge.functions.text import TOKENIZERS
from kwforge.sources.shared import cut


def keyword_pairs(df: DataFrame, id_col: str, text: str | Column, out_id: str = "obj_id", tokenizer: str = "alphanumeric", unique_ids: bool = False) -> DataFrame:
    """Distinct (id, kw). Rows without keywords leave no pair; the duplicates of a row go in that row.

    unique_ids says that no id comes twice: then no pair can either, and nothing is shuffled.
    """
    col = F.col(text) if isinstance(text, str) else text
    pairs = df.select(F.col(id_col).alias(out_id), F.explode(F.array_distinct(TOKENIZERS[tokenizer](col))).alias("kw"))
    return pairs if unique_ids else pairs.distinct()


def vocabulary(pairs: DataFrame) -> DataFrame:
    """(kw, kw_id): dense ids from 0 in keyword order.

    Keywords are dealt into ranges of like size and written. Ids are ranks within a range, plus the number of keywords
    in the ranges before it; only the table of ranges, one row a partition, is ever in one task.
    """
    words = cut(pairs.select("kw").distinct().repartitionByRange("kw").withColumn("part", F.spark_partition_id()), "vocabulary")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = words.groupBy("part").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    ranked = words.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("kw")))
    return ranked.join(F.broadcast(base), "part").select("kw", (F.col("base") + F.col("r") - 1).cast("long").alias("kw_id"))


def postings(pairs: DataFrame, id_col: str = "obj_id") -> DataFrame:
    """(kw, ids) with ids ascending."""
    return pairs.groupBy("kw").agg(F.array_sort(F.collect_list(id_col)).alias("ids"))


def document_frequency(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("kw").agg(F.count("*").alias("df"))


def lengths(pairs: DataFrame, id_col: str, name: str) -> DataFrame:
    """Keywords of each id."""
    return pairs.groupBy(id_col).agg(F.count("*").alias(name))


def lookup(tokens: DataFrame, vocab: DataFrame, unknown: str = "<UNK>") -> DataFrame:
    """(kw, kw_id, known) of each token: -1 for one that the vocabulary lacks; known is the token or the mark for unknown ones."""
    return tokens.join(vocab, "kw", "left").select("kw", F.coalesce("kw_id", F.lit(-1)).alias("kw_id"), F.when(F.col("kw_id").isNull(), F.lit(unknown)).otherwise(F.col("kw")).alias("known"))


def tokens_of(ids: DataFrame, vocab: DataFrame, unknown: str = "<UNK>") -> DataFrame:
    """(kw_id, kw) of each id, with the mark for ids that the vocabulary lacks."""
    return ids.join(vocab, "kw_id", "left").select("kw_id", F.coalesce("kw", F.lit(unknown)).alias("kw"))


def mean_vectors(pairs: DataFrame, vectors: DataFrame, id_col: str = "obj_id") -> DataFrame:
    """(id, dim, value): the mean of the vectors (kw, vector) of an id's keywords; keywords without a vector don't count.

    An id none of whose keywords has a vector gets no row: its mean is zero everywhere.
    """
    each = pairs.join(vectors, "kw").select(id_col, F.posexplode("vector").alias("dim", "x"))
    return each.groupBy(id_col, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


def term_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kw, tf) of rows whose ids are unique: counted within the row, by where the runs of its sorted tokens begin."""
    t, s = F.col("tokens"), F.col("starts")
    sorted_ = df.select(F.col(id_col).alias("id"), F.array_sort(TOKENIZERS["alphanumeric"](F.col(text_col))).alias("tokens")).filter(F.size("tokens") > 0)
    begun = sorted_.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, F.greatest(i - 1, F.lit(0))))))
    each = F.transform(s, lambda at, k: F.struct(F.get(t, at).alias("kw"), (F.coalesce(F.get(s, k + 1), F.size(t)) - at).cast("long").alias("tf")))
    return begun.select("id", F.explode(each).alias("x")).select("id", "x.kw", "x.tf")


def tf_idf(df: DataFrame, id_col: str, text_col: str, min_df: int = 2, max_df: float = 0.95, unique_ids: bool = False) -> DataFrame:
    """(id, kw, weight): tf times ln((1 + n) / (1 + df)) + 1, each row scaled to length one.

    unique_ids says that no id comes twice; terms are then counted without a shuffle.
    """
    if unique_ids:
        terms, words = term_counts(df, id_col, text_col), keyword_pairs(df, id_col, text_col, unique_ids=True)
    else:
        terms = df.select(F.col(id_col).alias("id"), F.explode(TOKENIZERS["alphanumeric"](F.col(text_col))).alias("kw")).groupBy("id", "kw").agg(F.count("*").alias("tf"))
        words = terms
    n = df.select(F.count("*").alias("n"))
    used = words.groupBy("kw").agg(F.count("*").alias("df")).join(F.broadcast(n)).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    raw = terms.join(used, "kw").select("id", "kw", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.select("id", "kw", (F.col("w") / norm).alias("weight"))
