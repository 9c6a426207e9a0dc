"""From a file to an index in one go: CSV rows to vocabulary and postings, keyword lines to compressed bitmaps."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kwforge.functions.text import TOKENIZERS
from kwforge.operators import containers, keywords
from kwforge.sources.readers import _numbered
from kwforge.sources.shared import cut


class Indexed(NamedTuple):
    rows: DataFrame  #: row, kws: distinct keywords; a row without any has an empty list
    vocabulary: DataFrame  #: kw, kw_id
    postings: DataFrame  #: kw_id, ids ascending


def csv_texts(spark: SparkSession, path: str, column: str = "Title", header: bool = True, delimiter: str = ",", encoding: str = "utf-8", place: int = 1, most: int = 64) -> DataFrame:
    """(line, text) of the rows of a CSV file or folder; blank lines are no rows, and quoted cells may span lines.

    With a header the text is the named column; under a heading of that one name alone, rows of several cells have it in
    the second. Without a header it is cell number `place` from 0. A row that has no such cell gives all its cells. Cells
    beyond the first `most` are not read.
    """
    names = [f"c{i}" for i in range(most)]
    read = spark.read.options(sep=delimiter, encoding=encoding, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=False)
    rows = read.csv(path, schema=", ".join(f"{n} string" for n in names), header=header, enforceSchema=True)
    at, alone = place, False
    if header:
        first = read.csv(path, schema=", ".join(f"{n} string" for n in names), header=False).first()
        heading = [h.strip() for h in first if h is not None] if first else []
        at, alone = (heading.index(column) if column in heading else -1), heading == [column]
    every = F.concat_ws(" ", *names)  # passes over cells that there are not
    text = F.coalesce(F.col(names[at]), every) if 0 <= at < most else every
    if alone and most > 1:
        text = F.coalesce(F.col("c1"), text)
    return _numbered(rows.select(F.trim(text).alias("text")))


def index_csv(spark: SparkSession, path: str, tokenizer: str = "piped", **options) -> Indexed:
    """Read, split, number the keywords and list the rows of each, with one pass over the file."""
    rows = cut(csv_texts(spark, path, **options).select(F.col("line").alias("row"), F.array_distinct(TOKENIZERS[tokenizer](F.col("text"))).alias("kws")), "rows")
    pairs = rows.select(F.col("row").alias("obj_id"), F.explode("kws").alias("kw"))
    vocabulary = cut(keywords.vocabulary(pairs), "vocabulary")
    return Indexed(rows, vocabulary, keywords.postings(pairs).join(vocabulary, "kw").select("kw_id", "ids"))


def index_lines(spark: SparkSession, path: str, vocabulary: DataFrame, unknown: str = "drop") -> tuple[DataFrame, DataFrame]:
    """(containers by kw_id, counts of one row) of a file of one object a line; blank lines and the heading Title are none.

    A keyword that the vocabulary lacks is dropped, or is an error with unknown="fail". An object that then has no keyword
    keeps its number. counts: objects, pairs (of an object and a keyword).
    """
    if unknown not in ("drop", "fail"):
        raise ValueError(f"unknown is drop or fail, not {unknown}")
    lines = spark.read.text(path).select(F.trim("value").alias("value")).filter((F.col("value") != "") & (F.lower("value") != "title"))
    rows = _numbered(lines.select(F.array_distinct(TOKENIZERS["piped"](F.col("value"))).alias("kws")).filter(F.size("kws") > 0))
    rows = cut(rows, "rows")
    found = rows.select(F.col("line").alias("obj_id"), F.explode("kws").alias("kw")).join(vocabulary, "kw", "left")
    told = F.col("kw_id")
    if unknown == "fail":
        told = F.coalesce(told, F.raise_error(F.concat(F.lit("unknown keyword: "), F.col("kw"))).cast("long"))
    pairs = cut(found.select("obj_id", told.alias("kw_id")).filter("kw_id IS NOT NULL"), "pairs")
    counts = rows.agg(F.count("*").alias("objects")).join(pairs.agg(F.count("*").alias("pairs")))  # two one-row tables
    return containers.encode(pairs, ["kw_id"], "obj_id"), counts
