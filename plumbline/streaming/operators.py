"""Stateful operators over event streams ``execution, type, code, at, seq``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.streaming.breaker import circuit_breaker

__all__ = ["circuit_breaker", "once_within", "outcome_counters", "windowed_failures"]


def once_within(events: DataFrame, keys: list[str], ttl: str = "10 minutes") -> DataFrame:
    """The first of equal requests inside the time to live; state is dropped with the watermark."""
    return events.withWatermark("at", ttl).dropDuplicatesWithinWatermark(keys)


def outcome_counters(events: DataFrame, keys: list[str]) -> DataFrame:
    """Running counters per key, for update mode."""
    return events.groupBy(*keys).agg(F.count("*").alias("attempts"), F.count_if(F.col("type") == "failed").alias("failures"), F.max("at").alias("last_at"))


def windowed_failures(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Failure rates per tumbling window; late rows are taken until the watermark passes."""
    grouped = events.withWatermark("at", late).groupBy(F.window("at", size), "execution")
    return grouped.agg(F.count("*").alias("n"), F.count_if(F.col("type") == "failed").alias("failures")).select(
        "execution", F.col("window.start").alias("start"), "n", "failures"
    )
