"""Operator 3, token counts: delta-maintained rollups by source, language and tokenizer version.

A delta is a set of signed rows: an insert adds a document's counts, a delete takes them away, a revision is a delete
of the old count and an insert of the new. Totals are sums, so a batch is first summed by key and only that small sum
is written. Each batch is one folder named by its id: a batch that is already there is not written again, so a retried
or repeated commit changes nothing; a batch that failed half-way has no _SUCCESS marker, is not read, and is written
anew. Reading sums the live batches by key; `compact` folds them into one so that reading stays in proportion to the
keys. A compaction is written under a temporary name, with the ids that it holds beside its sums, and published by one
rename: before it nothing has changed, after it the ids that it holds are read from it alone, whether their folders are
still there or not. A rollup has one writer at a time.

Nulls: a null text has 0 tokens; a null source or language is a key of its own. A null sign counts as an insert.
Repeated rows count as often as they come. Keys whose documents all went keep a row of zeros until `compact` drops it.
An empty delta commits an empty batch. Extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kwforge.llm.common import shared_dir, table
from kwforge.llm.tokens import encode

KEYS = ("source", "lang", "tokenizer")
SUMS = ("docs", "tokens")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"


def bpe_tokens(text: Column) -> Column:
    """Tokens of the byte-level BPE vocabulary."""

    @F.pandas_udf("long")
    def count(s):
        import pandas as pd

        return pd.Series([len(encode(x)) for x in s], dtype="int64")

    return count(text)


def word_tokens(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def part_tokens(text: Column) -> Column:
    """Runs of letters, runs of digits, and single other characters."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{M}]+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{M}\p{N}]")), F.lit(0)).cast("long")


TOKENIZERS: dict[str, Callable[[Column], Column]] = {"byte_bpe_50k": bpe_tokens, "words_v1": word_tokens, "words_v2": part_tokens}


def signed_counts(docs: DataFrame, tokenizers: Sequence[str] = tuple(TOKENIZERS), sign: int | Column = 1, text_col: str = "text") -> DataFrame:
    """Rows (source, lang, tokenizer, docs, tokens) to add for these documents; sign -1 takes them away."""
    s = F.coalesce(sign if isinstance(sign, Column) else F.lit(sign), F.lit(1)).cast("long")
    counted = docs.select(
        F.col("source"), F.col("lang"), s.alias("sign"),
        *(TOKENIZERS[t](F.col(text_col)).alias(f"n{i}") for i, t in enumerate(tokenizers)),
    )
    each = F.array(*(F.struct(F.lit(t).alias("tokenizer"), F.col(f"n{i}").alias("n")) for i, t in enumerate(tokenizers)))
    return counted.select("source", "lang", "sign", F.explode(each).alias("e")).select(
        "source", "lang", F.col("e.tokenizer").alias("tokenizer"), F.col("sign").alias("docs"), (F.col("sign") * F.col("e.n")).alias("tokens")
    )


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed rows that replace earlier counts by new ones."""
    back = old.select(*KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))
    return back.unionByName(new.select(*KEYS, *SUMS))


class Rollup:
    """Additive totals in a folder of committed batches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, prefix: str) -> list[str]:
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        return sorted(n.removeprefix(prefix) for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.startswith(prefix))

    def _delete(self, name: str) -> None:
        fs, p = self._fs(f"{self.path}/{name}")
        fs.delete(p, True)

    def _ended(self, name: str) -> bool:
        fs, marker = self._fs(f"{self.path}/{name}/_SUCCESS")
        return fs.exists(marker)

    def committed(self) -> list[str]:
        """Ids of the batches whose write ended and whose folders are there."""

        return [n for n in self._names("batch=") if self._ended(f"batch={n}")]

    def compactions(self) -> dict[str, set[str]]:
        """Published compactions and the ids that each holds, those of earlier compactions included."""
        names = [n for n in self._names("compact=") if self._ended(f"compact={n}/members")]
        if not names:
            return {}
        paths = [f"{self.path}/compact={n}/members" for n in names]
        rows = self.spark.read.schema("id string, member string").parquet(*paths).collect()
        return {n: {r["member"] for r in rows if r["id"] == n} for n in names}

    def commit(self, batch_id: str, delta: DataFrame) -> bool:
        """Add a batch once. False if it was there already, also as part of a compaction."""
        held = self.compactions()
        if batch_id in self.committed() or batch_id in held or any(batch_id in m for m in held.values()):
            return False
        summed = delta.groupBy(*KEYS).agg(*(F.sum(c).cast("long").alias(c) for c in SUMS))
        summed.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        return True

    def live(self) -> list[str]:
        """Folders that the totals are read from: batches and compactions that no compaction holds."""
        compactions = self.compactions()
        held = set().union(*compactions.values())
        return [f"batch={b}" for b in self.committed() if b not in held] + [f"compact={c}/sums" for c in compactions if c not in held]

    def batches(self) -> DataFrame:
        paths = [f"{self.path}/{b}" for b in self.live()]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*paths)

    def totals(self) -> DataFrame:
        """Current totals by key."""
        return self.batches().groupBy(*KEYS).agg(*(F.sum(c).cast("long").alias(c) for c in SUMS))

    def compact(self, batch_id: str) -> bool:
        """Fold all that is live into one batch. False, with nothing changed, if the id is known already.

        Folders that a compaction holds go after it is published; what a failure leaves of them goes with the next one.
        """
        earlier, batches = self.compactions(), self.committed()
        if batch_id in earlier or batch_id in batches or any(batch_id in m for m in earlier.values()):
            return False
        known = set(batches).union(earlier, *earlier.values())
        draft = f"_draft-{uuid.uuid4().hex}"
        self.totals().filter("docs <> 0 OR tokens <> 0").write.parquet(f"{self.path}/{draft}/sums")
        members = [(batch_id, b) for b in sorted(known)] or [(batch_id, "")]
        self.spark.createDataFrame(members, "id string, member string").coalesce(1).write.parquet(f"{self.path}/{draft}/members")
        fs, to = self._fs(f"{self.path}/compact={batch_id}")
        if not fs.rename(self._fs(f"{self.path}/{draft}")[1], to):
            raise RuntimeError(f"compaction {batch_id} could not be published")
        for b in batches:
            self._delete(f"batch={b}")
        for c in earlier:
            self._delete(f"compact={c}")
        return True


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents, held up to date by three commits.

    The first inserts every document under byte_bpe_50k and words_v1. The second moves every document from words_v1 to
    the next version, words_v2: a delete of its old count and an insert of the revised one. The third repeats the first
    one's id and changes nothing. words_v1 stays as rows of zeros.
    """
    docs = table(spark, sf_dir, "documents")
    rollup = Rollup(spark, f"{shared_dir(spark)}/kwforge/{spark.sparkContext.applicationId}/rollup-{uuid.uuid4().hex}")
    first = signed_counts(docs, ("byte_bpe_50k", "words_v1"))
    rollup.commit("0001", first)
    rollup.commit("0002", revised(signed_counts(docs, ("words_v1",)), signed_counts(docs, ("words_v2",))))
    rollup.commit("0001", first)
    return rollup.totals()
