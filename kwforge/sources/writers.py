"""Sinks of predictions and of calibration data; every one is a Spark writer, so any store will do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_predictions(path: str, predicted: DataFrame, summary: DataFrame) -> None:
    """query_predictions as CSV with its latency in ns, us and ms, and summary as one JSON row.

    predicted: query_id, query_keywords, query_keyword_count, result_count, pred_query_time_ns.
    """
    ns = F.col("pred_query_time_ns")
    predicted.withColumns({"pred_query_time_us": ns / 1e3, "pred_query_time_ms": ns / 1e6}).write.mode("overwrite").csv(f"{path}/query_predictions", header=True)
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def write_calibration(path: str, points: DataFrame, line: DataFrame) -> None:
    """Points and mean lines of the calibration, one CSV folder for each and for each plot_type."""
    for name, df in (("points", points), ("mean_line", line)):
        df.write.mode("overwrite").partitionBy("plot_type").csv(f"{path}/{name}", header=True)
