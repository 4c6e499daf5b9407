"""Strategy benchmarks: aggregates, leaders and promotion scores over ``strategy, difficulty, kind, elapsed_ms, failed, cold``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.scalars import half_up
from plumbline.operators.benchmark import lower_percentiles


#: Rates of a strategy and the rows' columns that they count.
RATES = {"field_accuracy": "field_ok", "critical_accuracy": "critical_ok", "total_accuracy": "total_ok", "date_accuracy": "date_ok", "fallback_rate": "fallback", "cache_hit_rate": "cache_hit", "timeout_rate": "timeout"}


def aggregate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, means and nearest-rank percentiles of a strategy, and how much warm runs gain."""
    e = F.col("elapsed_ms")
    whole = lambda c: F.floor(c + 0.5).cast("bigint")
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("cases"), half_up(F.avg(F.col("failed").cast("int"))).alias("failure_rate"), whole(F.avg(e)).alias("avg_ms"),
        whole(F.avg(F.when(F.col("cold"), e))).alias("cold_ms"), whole(F.avg(F.when(~F.col("cold"), e))).alias("warm_ms"),
        *[half_up(F.avg(F.col(c).cast("int"))).alias(name) for name, c in RATES.items()],
    )
    ranks = lower_percentiles(rows, keys, {"p50_ms": (e, 0.5), "p95_ms": (e, 0.95)}, nearest=True)
    joined = out.join(ranks, keys, "left")
    return joined.withColumns({"p50_ms": whole(F.col("p50_ms")), "p95_ms": whole(F.col("p95_ms")), "warm_speedup": half_up(F.try_divide(F.col("cold_ms"), F.col("warm_ms")), 3)})


def leaders(rows: DataFrame, min_cases: int = 5) -> DataFrame:
    """The strategy with the least failures, then time, for each difficulty and kind."""
    cells = aggregate(rows, ["difficulty", "kind", "strategy"]).filter(F.col("cases") >= min_cases)  # a small table
    first = Window.partitionBy("difficulty", "kind").orderBy("failure_rate", "avg_ms", "strategy")
    return cells.withColumn("place", F.row_number().over(first)).filter("place = 1").select("difficulty", "kind", "strategy", "cases", "failure_rate", "avg_ms")


def promotion_score(summary: DataFrame) -> DataFrame:
    """Weighted accuracies, with a little for mean and high latency under ten seconds."""
    quick = lambda c: 0.03 * (1 - F.least(F.lit(1.0), F.col(c) / 10000))
    score = 0.38 * F.col("field_accuracy") + 0.28 * F.col("critical_accuracy") + 0.16 * F.col("total_accuracy") + 0.12 * F.col("date_accuracy") + quick("avg_ms") + quick("p95_ms")
    return summary.withColumn("score", half_up(score))


def failure_histogram(rows: DataFrame) -> DataFrame:
    """Per strategy the kinds of its failures, most frequent first, as one array."""
    counted = rows.filter("failed").groupBy("strategy", "kind").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("kind"))))
    return counted.groupBy("strategy").agg(F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p["kind"], -p["k"])), ",").alias("histogram"))
