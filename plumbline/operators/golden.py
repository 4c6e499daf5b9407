"""Golden cases: expected against actual JSON, and reports over the results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.documents import compared

__all__ = ["compared", "report"]


def report(results: DataFrame, keys: list[str]) -> DataFrame:
    """Results ``score, passed, weight, critical, case`` by task and (with no key) overall: weighted score and critical failures."""
    weighted = F.floor(F.sum(F.col("score") * F.col("weight")) / F.sum("weight") + 0.5).cast("int")
    return results.groupBy(*keys).agg(
        F.count("*").alias("cases"), F.count_if("passed").alias("passed"), weighted.alias("weighted_score"), F.floor(F.avg("score") + 0.5).cast("int").alias("score"),
        F.count_if(~F.col("passed") & F.col("critical")).alias("critical_failures"), F.min(F.when(~F.col("passed") & F.col("critical"), F.col("case"))).alias("first_critical"),
    )
