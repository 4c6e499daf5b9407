"""Sources, claims, consensus and facts over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.scalars import clamp, half_up

# fixed values: base weight of each kind of source
SOURCE_BASE = {"government": 0.96, "official": 0.92, "professional_database": 0.86, "retailer": 0.74, "web": 0.58, "community": 0.42}
# fixed values: fit of each kind of source for a price question
PRICE_FIT = {"retailer": 1.0, "official": 0.82, "web": 0.7}


def source_kind(host: Column) -> Column:
    return (
        F.when(host.rlike(r"\.gov(\.|$)|\.org$"), "government").when(host.rlike(r"(^|\.)(blog|forum|reddit)\."), "community")
        .when(host.rlike(r"(^|\.)m\."), "professional_database").when(host.rlike(r"(^|\.)(shop|store)\.|\.com$"), "retailer")
        .when(host.rlike(r"\.net$"), "official").otherwise("web")
    )


def _lookup(values: dict[str, float], key: Column, default: float) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key], F.lit(default))


def source_quality(df: DataFrame, kind: str = "kind", credibility: float = 0.5, relevance: float = 0.7) -> DataFrame:
    """Score and tier of a source for a price question."""
    base, fit = _lookup(SOURCE_BASE, F.col(kind), 0.5), _lookup(PRICE_FIT, F.col(kind), 0.55)
    score = half_up(clamp(0.5 * base + 0.3 * fit + 0.1 * credibility + 0.1 * relevance))
    tier = F.when(F.col("score") >= 0.88, "A").when(F.col("score") >= 0.74, "B").when(F.col("score") >= 0.6, "C").when(F.col("score") >= 0.45, "D").otherwise("E")
    return df.withColumn("score", score).withColumn("tier", tier)


def value_support(statements: DataFrame) -> DataFrame:
    """``claim, value, family, weight`` to support per claim and value: best family plus a bonus for others."""
    families = statements.groupBy("claim", "value", "family").agg(F.max("weight").alias("weight"))
    merged = families.groupBy("claim", "value").agg(F.max("weight").alias("best"), F.count("*").alias("families"))
    return merged.withColumn("support", half_up(clamp(F.col("best") + F.least(F.lit(0.18), 0.07 * (F.col("families") - 1)))))


def consensus(support: DataFrame, margin: float = 0.16) -> DataFrame:
    """One row a claim: its leading value and whether it is agreed, resolved, a majority or open."""
    order = Window.partitionBy("claim").orderBy(F.desc("support"), F.desc("families"), "value")
    ranked = support.withColumns({
        "place": F.row_number().over(order), "rival": F.lead("support").over(order), "rival_families": F.lead("families").over(order),
        "values": F.count("*").over(Window.partitionBy("claim")),
    }).filter("place = 1")
    lead = half_up(F.col("support") - F.col("rival"))
    status = (
        F.when(F.col("values") == 1, "consensus").when((lead >= margin) & (F.col("best") >= 0.9), "resolved")
        .when((F.col("families") >= 2) & (F.col("families") > F.col("rival_families")) & (F.col("support") >= 0.72), "majority").otherwise("unresolved")
    )
    return ranked.select("claim", "value", "support", "families", F.col("values").alias("n_values"), status.alias("status"))


def current_facts(facts: DataFrame) -> DataFrame:
    """Per ``entity, type`` the value at the newest usable time; null and a conflict where values of that moment differ."""
    usable = facts.filter("usable").withColumn("newest", F.max("observed_at").over(Window.partitionBy("entity", "type")))
    near = usable.filter(F.col("observed_at") >= F.col("newest") - F.expr("interval 1 second"))
    out = near.groupBy("entity", "type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.max("newest").alias("observed_at"))
    return out.select("entity", "type", "observed_at", F.when(F.col("low") == F.col("high"), F.col("low")).alias("value"), (F.col("low") != F.col("high")).alias("conflict"))


def as_of(facts: DataFrame, times: DataFrame) -> DataFrame:
    """For rows ``entity, at`` the newest usable value observed at or before ``at``.

    Both sides are put on one line of time per entity and the last value is carried forward: one shuffle,
    no product of facts and times.
    """
    a = facts.filter("usable").select("entity", F.col("observed_at").alias("t"), F.struct("value", "observed_at").alias("v"), F.lit(0).alias("asks"), F.lit(None).cast("bigint").alias("id"))
    b = times.select("entity", F.col("at").alias("t"), F.lit(None).cast(a.schema["v"].dataType).alias("v"), F.lit(1).alias("asks"), "id")
    line = Window.partitionBy("entity").orderBy("t", "asks", F.col("v.value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("last", F.last("v", ignorenulls=True).over(line)).filter("asks = 1").select("id", "entity", F.col("t").alias("at"), "last.value", "last.observed_at")


def usability(df: DataFrame, now: Column, minimum: float = 0.5) -> DataFrame:
    """``reasons`` against using a row and ``usable``."""
    reasons = F.array_compact(F.array(
        F.when(F.col("state").isin("retracted", "superseded", "conflicted"), F.col("state")),
        F.when(F.col("valid_until") < now, F.lit("expired")), F.when(F.col("confidence") < minimum, F.lit("low_confidence")),
    ))
    return df.withColumn("reasons", F.array_join(reasons, ",")).withColumn("usable", F.col("reasons") == "")


def judge_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims ``id, refs`` against usable evidence ``ref``: known and unknown refs, and the status."""
    refs = claims.select("id", F.explode_outer("refs").alias("ref"))
    marked = refs.join(evidence.select("ref", F.lit(True).alias("known"), "usable"), "ref", "left")
    out = marked.groupBy("id").agg(
        F.count_if(F.col("known")).alias("known_refs"), F.count_if(F.col("ref").isNotNull() & F.col("known").isNull()).alias("unknown_refs"), F.count_if("usable").alias("usable_refs")
    )
    return out.withColumn("status", F.when(F.col("usable_refs") >= 2, "supported").when(F.col("usable_refs") == 1, "single_source").otherwise("unsupported"))


# fixed values: kinds of claims that need support, and those that need fresh support where a task asks for it
NEEDS_SUPPORT, NEEDS_FRESH = ("fact", "price", "safety"), ("fact", "price")


def judged_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims ``answer, id, type, status, refs, fresh_required`` against evidence ``ref, usable, search, fresh, qualified``: adds the judged status, the usable refs and the issues.

    Every issue here blocks its answer, so an answer is sound if none of its claims has one.
    """
    c = F.col
    own = ["type", "status", "fresh_required"]
    refs = claims.select("answer", "id", *own, F.explode_outer(F.array_distinct("refs")).alias("ref"))
    met = refs.join(evidence.withColumn("known", F.lit(True)).withColumnRenamed("fresh", "recent"), "ref", "left")
    good = c("known") & c("usable")
    rows = met.groupBy("answer", "id", *own).agg(
        F.count_if(c("ref").isNotNull() & c("known").isNull()).alias("unknown"), F.count_if(c("known") & ~c("usable")).alias("inactive"), F.count_if(good).alias("usable_refs"),
        F.count_if(good & c("search") & c("recent")).alias("fresh"), F.count_if(good & c("search") & c("recent") & c("qualified")).alias("qualified"),
    )
    needs, fresh = c("type").isin(*NEEDS_SUPPORT), c("fresh_required") & c("type").isin(*NEEDS_FRESH)
    stale, weak = fresh & (c("fresh") == 0), fresh & (c("fresh") > 0) & (c("qualified") == 0)
    unsupported = needs & (c("usable_refs") == 0)
    status = F.when(unsupported | stale | weak, "unsupported").when(needs & ~c("status").isin("supported", "partially_supported"), "supported").otherwise(c("status"))
    told = {"inactive_evidence_ref": c("inactive") > 0, "unknown_evidence_ref": c("unknown") > 0, "unsupported": unsupported, "freshness_evidence_missing": stale, "source_quality_insufficient": weak}
    issues = F.array_compact(F.array(*[F.when(on, F.concat(F.lit("unsupported_"), "type") if name == "unsupported" else F.lit(name)) for name, on in told.items()]))
    return rows.select("answer", "id", "type", status.alias("status"), "usable_refs", issues.alias("issues"))


def judged_answers(judged: DataFrame) -> DataFrame:
    """``(answer, claims, ok, issues)``: how many issues the claims of each answer have."""
    return judged.groupBy("answer").agg(F.count("*").alias("claims"), F.sum(F.size("issues")).alias("issues")).withColumn("ok", F.col("issues") == 0)
