"""The storage and latency model as column expressions.

Constants and weights are parameters; query length enters whole or less one, as the caller says.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CostModel:
    """Nanoseconds: fixed, for a keyword and object, for an object, for a result; and the weights of storage and latency."""

    # fixed values of the published fit
    epsilon: float = 380.17
    alpha: float = 0.106
    beta: float = 0.0
    gamma: float = 1.749
    storage_weight: float = 1.0
    query_weight: float = 0.0
    zero_if_no_queries: bool = True

    def storage(self, objects: Column, keywords: Column) -> Column:
        """Bits: a bitmap a keyword, and 32 bits for each keyword and object id."""
        return keywords * objects + F.lit(32) * keywords + F.lit(32) * objects

    def query(self, objects: Column, query_len: Column, results: Column, less_one: bool = True) -> Column:
        """Nanoseconds of one query; 0 for an empty one."""
        k = query_len - F.lit(1) if less_one else query_len
        ns = F.lit(self.epsilon) + F.lit(self.alpha) * k * objects + F.lit(self.beta) * objects + F.lit(self.gamma) * results
        return F.when(query_len <= 0, F.lit(0.0)).otherwise(ns)

    def node(self, objects: Column, keywords: Column, queries: Column, sum_len: Column, results: Column) -> Column:
        """Weighted cost of a node; 0 where it has no objects or, if so set, no queries."""
        latency = F.lit(self.epsilon) * queries + F.lit(self.alpha) * sum_len * objects + F.lit(self.beta) * queries * objects + F.lit(self.gamma) * results
        cost = F.lit(self.storage_weight) * self.storage(objects, keywords) + F.lit(self.query_weight) * latency
        empty = (objects <= 0) | (queries <= 0) if self.zero_if_no_queries else objects <= 0
        return F.when(empty, F.lit(0.0)).otherwise(cost)


#: Weights under which both sides of the model show, for reports.
BOTH = CostModel(query_weight=1.0)
