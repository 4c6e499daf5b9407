"""Scores, gates and lookups that turn aggregates into decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.scalars import clamp, fnv1a32, half_up

# fixed values: score and weight of each kind of outcome signal
SIGNALS = {
    "verified_success": (1.0, 3.0), "provisional_resolution": (0.72, 1.0), "technical_success_only": (0.5, 0.0), "residual_unresolved": (0.2, 1.5),
    "user_corrected": (0.0, 2.5), "authoritative_contradiction": (0.0, 3.0), "technical_failure": (0.15, 1.0),
}


def specialist_scores(signals: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence-weighted mean of signals (column ``signal``), shrunk to one half with weight 4, and its confidence."""
    pick = lambda i: F.create_map(*[F.lit(x) for name, v in SIGNALS.items() for x in (name, v[i])])[F.col("signal")]
    grouped = signals.groupBy(*keys).agg(F.sum(pick(0) * pick(1)).alias("won"), F.sum(pick(1)).alias("weight"))
    mean = F.when(F.col("weight") > 0, F.col("won") / F.col("weight")).otherwise(0.5)
    return grouped.select(
        *keys, half_up(F.col("weight")).alias("weight"), half_up(mean).alias("evidence_score"),
        half_up((mean * F.col("weight") + 2.0) / (F.col("weight") + 4.0)).alias("shrunk_score"), half_up(F.least(F.lit(1.0), F.col("weight") / 12)).alias("confidence"),
    )


def weight_budget(df: DataFrame, correlated: list[str], single: str) -> DataFrame:
    """Correlated bonuses scaled to .16 together, all bonuses to .20, all penalties to -.28."""
    total = lambda parts: sum(parts[1:], parts[0])
    gain = total([F.greatest(F.col(c), F.lit(0.0)) for c in correlated])
    loss = total([F.least(F.col(c), F.lit(0.0)) for c in [*correlated, single]])
    scaled = F.least(gain, F.lit(0.16)) + F.greatest(F.col(single), F.lit(0.0))
    return df.withColumn("budget", half_up(F.least(scaled, F.lit(0.20)) + F.greatest(loss, F.lit(-0.28))))


def clear_winner(df: DataFrame, group: str, name: str, score: str, margin: float) -> DataFrame:
    """Per group the best name if its score leads the next by the margin."""
    order = Window.partitionBy(group).orderBy(F.desc(score), name)
    ranked = df.withColumns({"place": F.row_number().over(order), "lead": half_up(F.col(score) - F.lead(score).over(order))})
    clear = F.coalesce(F.col("lead") >= margin, F.lit(True))
    return ranked.filter("place = 1").select(group, F.when(clear, F.col(name)).otherwise("no_clear_winner").alias("winner"), F.col("lead"))


def with_fallback(asked: DataFrame, known: DataFrame, key: str, detail: str, value: str) -> DataFrame:
    """``value`` for ``(key, detail)``, else for ``(key, '*')``."""
    exact = known.select(key, detail, F.col(value).alias("exact"))
    any_of = known.filter(F.col(detail) == "*").select(key, F.col(value).alias("general"))
    out = asked.join(exact, [key, detail], "left").join(any_of, key, "left")
    return out.select(key, detail, F.coalesce("exact", "general").alias(value), F.col("exact").isNotNull().alias("is_exact"))


def evidence_set(statements: DataFrame) -> DataFrame:
    """Per claim: statements, distinct families and values, conflict, and whether a search can stop."""
    out = statements.groupBy("claim").agg(
        F.count("*").alias("n"), F.count_distinct("family").alias("families"), F.count_distinct("value").alias("n_values"), half_up(F.avg("weight")).alias("mean_weight")
    )
    enough = (F.col("n") >= 3) & (F.col("families") >= 2) & (F.col("mean_weight") >= 0.62)
    return out.withColumns({"conflict": F.col("n_values") > 1, "enough": enough})


def explores(df: DataFrame, key: str, rate: float = 0.2) -> DataFrame:
    """Marks the share of requests, chosen by hash of their key, that explore."""
    return df.withColumn("explore", fnv1a32(F.col(key)) < int(rate * (1 << 32)))


def budgeted(calls: DataFrame, key: str, order: list[str], cost: str, max_calls: int, max_cost: float) -> DataFrame:
    """Calls in order with what was spent before them, and whether the budget still allowed them."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = calls.withColumns({"calls_before": F.count("*").over(before), "cost_before": F.coalesce(half_up(F.sum(cost).over(before), 2), F.lit(0.0))})
    return out.withColumn("allowed", (F.col("calls_before") < max_calls) & (F.col("cost_before") < max_cost))


def confidence_bucket(confidence: Column) -> Column:
    return F.when(confidence.isNull(), "missing").when(confidence >= 0.85, "certain").when(confidence >= 0.70, "likely").otherwise("doubtful")


def gate(confidence: Column, accept: float = 0.82, ask: float = 0.65) -> Column:
    return F.when(confidence >= accept, "accepted").when(confidence >= ask, "needs_check").otherwise("rejected")


def grid(cases: DataFrame, strategies: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Every case on every strategy with its result, or as missing; strategies are a small dimension."""
    return cases.crossJoin(F.broadcast(strategies)).join(results, keys, "left")


def contained(regions: DataFrame, group: str) -> DataFrame:
    """Pairs ``parent, child`` of a group's regions ``id, x, y, w, h``: the child's centre lies in the larger parent."""
    child = regions.select(group, F.col("id").alias("child"), (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"), (F.col("w") * F.col("h")).alias("c_area"))
    inside = (F.col("cx") >= F.col("x")) & (F.col("cx") <= F.col("x") + F.col("w")) & (F.col("cy") >= F.col("y")) & (F.col("cy") <= F.col("y") + F.col("h"))
    return regions.join(child, group).filter(inside & (F.col("id") != F.col("child")) & (F.col("w") * F.col("h") > F.col("c_area"))).select(group, F.col("id").alias("parent"), "child")


def category_coverage(counts: DataFrame, limit: float = 0.15) -> DataFrame:
    """Shares of categories ``category, n`` and which exceed the limit."""
    total = counts.agg(F.sum("n").alias("total"))
    share = half_up(F.col("n") / F.col("total"))
    return counts.crossJoin(F.broadcast(total)).select("category", "n", share.alias("share"), (share > limit).alias("too_large"))


def uncertainty(df: DataFrame) -> DataFrame:
    """Confidence lowered by counts of ``conflicts, unknown, uncertain, limitations``."""
    penalty = F.least(F.lit(0.55), 0.22 * F.col("conflicts") + 0.08 * F.col("unknown") + 0.045 * F.col("uncertain") + 0.035 * F.col("limitations"))
    over = (F.col("raw") >= 0.85) & (F.col("support") < 0.5)
    return df.withColumn("calibrated", half_up(clamp(F.col("raw") - F.when(over, F.greatest(penalty, F.lit(0.18))).otherwise(penalty))))


def routed(profiles: DataFrame, cohort: str) -> DataFrame:
    """Eligible providers ``provider, c, rel, lat, mem, priority`` ranked inside their cohort by capability, reliability, time, memory and priority."""
    c = F.col
    score = half_up(0.43 * c("c") + 0.24 * c("rel") + 0.14 * c("lat") + 0.09 * c("mem") + 0.05 * F.least(F.lit(1.0), c("priority") / 100))
    scored = profiles.select("provider", cohort, score.alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(cohort).orderBy(F.desc("score"), "provider")))
