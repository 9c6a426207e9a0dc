"""Assignment of a stream of objects to two sides that change with every batch.

The state is what the costs ask for, not the objects: the distinct keywords of each side and how many objects it has. It
is kept as versions: batch n writes the keywords that are new to a side, the objects it added, and who went where, each
into a folder of its own number. Batch n is weighed against the folders below n alone, so it sees the sides as the batch
before left them, and a batch that runs again, after a failure or a replay of the whole stream, writes what it wrote
before. An object that an earlier batch has placed stays where it is. Seeds are batch -1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kwforge.functions.cost import CostModel
from kwforge.operators.keywords import keyword_pairs
from kwforge.operators.routing import cheaper_side, deltas_against
from kwforge.sources.shared import cut

_STATE = {"keywords": "side int, kw string, batch int", "objects": "side int, o long, batch int", "placed": "obj_id long, side int, batch int"}


class Assignment:
    """Sides under a folder that all executors see."""

    def __init__(self, spark: SparkSession, path: str, queries: DataFrame, model: CostModel):
        self.spark, self.path, self.queries, self.model = spark, path, queries, model

    def _before(self, table: str, number: int) -> DataFrame:
        """A state table as it was before a batch; the folders of later batches are not opened."""
        return self.spark.read.schema(_STATE[table]).parquet(f"{self.path}/{table}").filter(F.col("batch") < number).drop("batch")

    def _write(self, df: DataFrame, table: str, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={number}")

    def seed(self, seeds: DataFrame) -> None:
        """Start from (obj_id, kw, side)."""
        sided = seeds.filter("side IS NOT NULL").select("obj_id", "kw", F.col("side").cast("int").alias("side"))
        self._write(sided.select("side", "kw").distinct(), "keywords", -1)
        placed = sided.select("obj_id", "side").distinct()
        self._write(placed, "placed", -1)
        self._write(placed.groupBy("side").agg(F.count("*").alias("o")), "objects", -1)

    def place(self, objects: DataFrame, number: int) -> None:
        """Assign a batch of (obj_id, kw): each object to the side where it costs less, all against the same sides."""
        new = cut(objects.filter("obj_id IS NOT NULL").select("obj_id", "kw").join(self._before("placed", number).select("obj_id"), "obj_id", "left_anti").distinct(), "batch")
        have = cut(self._before("keywords", number).distinct(), "have")
        counts = self._before("objects", number).groupBy("side").agg(F.sum("o").alias("o"))
        m = self.model
        chosen = cut(cheaper_side(deltas_against(have, counts, self.queries, new, m.alpha, m.beta, m.gamma, m.epsilon), m), "chosen")
        self._write(chosen, "placed", number)
        self._write(new.join(chosen, "obj_id").select("side", "kw").distinct().join(have, ["side", "kw"], "left_anti"), "keywords", number)
        self._write(chosen.groupBy("side").agg(F.count("*").alias("o")), "objects", number)

    def placed(self) -> DataFrame:
        """(obj_id, side, batch) of everything that has been placed, seeds apart."""
        return self.spark.read.schema(_STATE["placed"]).parquet(f"{self.path}/placed").filter("batch >= 0")

    def follow(self, stream: DataFrame, checkpoint: str):
        """Place a stream of (obj_id, text); Spark numbers the micro-batches and gives a failed one its number again."""
        step = lambda batch, number: self.place(keyword_pairs(batch, "obj_id", "text"), number)
        return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
