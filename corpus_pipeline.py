"""A corpus pipeline in five stages, each one of the operators in kwforge.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. A table without rows passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kwforge.llm import best_fit_packing, minhash_dedup, quality_classifier, quality_rules, secret_scan
from kwforge.llm.common import cut, table


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the scorer calls bad."""
    weights = quality_classifier.train(docs)
    return docs if weights is None else docs.filter(quality_classifier.score(F.col("text"), weights) >= quality_classifier.THRESHOLD)


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the base rule or a rule of the cascade rejects."""
    return docs.filter(quality_rules.keep(F.col("text"), quality_rules.order_rules(docs)))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the smallest id, of every group of near-duplicates; rows without a text stay.

    Of rows with one text a single one stays, whatever their ids: repeated rows, rows without an id, ids with several
    texts. A text of an id with several texts that is only near another text stays, as links are between ids.
    """
    reps, links = minhash_dedup.near_links(docs)
    classes = minhash_dedup.components(links).filter(F.col("id") != F.col("component")).select("id")
    several = reps.groupBy("id").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high")).filter("low <> high").select("id")
    gone = reps.filter(F.col("id") != F.col("rep")).select("id").union(classes).distinct().join(several, "id", "left_anti")
    # docs are a written table, so a row has the same number in every scan
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    keys = rows.select("__row", "doc_id", F.coalesce(F.sha2("text", 256), F.col("__row").cast("string")).alias("key"))
    left = keys.join(cut(gone, "gone").hint("merge"), keys.doc_id == F.col("id"), "left_anti")
    kept = left.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row"))["__row"].alias("__row"))
    return rows.join(kept.select("__row").hint("merge"), "__row", "left_semi").select(docs.columns)


def secret_scan_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the texts by a mark and bring n_chars in line; no document goes."""
    clean = secret_scan.redact(docs, secret_scan.scan(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    return best_fit_packing.pieces(best_fit_packing.pack(docs))


STAGES = [
    ("quality_classifier", quality_classifier_stage),
    ("quality_rules", quality_rules_stage),
    ("minhash_dedup", near_dedup_stage),
    ("secret_scan", secret_scan_stage),
    ("best_fit_packing", packing_stage),
]

#: The classifier, near-duplicates, the forest and the packing have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
