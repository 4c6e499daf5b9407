"""Decisions on what to do next: answerability, verdicts on results, visual evidence to ask for, recovery, and ranked teachers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.scalars import clamp

# fixed values: what visual evidence is asked for, in order of priority: capability and target
REQUESTS = {
    "visual_grounding": "referenced_region", "specific_identity": "identity_marker", "anomaly_inspection": "anomaly_region", "component_parts": "component_region", "spatial_relationships": "relationship_view",
    "color_state": "state_indicator", "object_identity": "whole_object", "scene_context": "wider_scene",
}
# fixed values: weights of a teacher's components, and of its priority
WEIGHTS = {"task": 0.25, "capability": 0.20, "evidence": 0.15, "freshness": 0.10, "reliability": 0.10, "history": 0.10, "language": 0.05, "latency": 0.05}
PRIORITY = 0.001
# fixed values: worth of a latency class and of measured milliseconds
CLASSES = {"fast": 1.0, "medium": 0.7}
SLOW_CLASS, MEASURED, SLOWEST = 0.4, [(1500, 1.0), (4000, 0.8), (8000, 0.6), (15000, 0.4)], 0.2


def answerability(df: DataFrame) -> DataFrame:
    """Adds ``decision, reason, local_confidence, completeness`` to ``perception, known, unknown, limitations, has_target, freshness, risk, specialist, search, teachers, intent``."""
    c = F.col
    complete = clamp((c("known") + 1) / (c("known") + c("unknown") + 1) - F.least(F.lit(0.35), c("limitations") * 0.08))
    local = clamp(0.52 * clamp(c("perception")) + 0.33 * complete + 0.15 * F.when(c("has_target"), 1.0).otherwise(0.45))
    rows = df.withColumns({"completeness": complete, "local_confidence": local})
    pick = lambda decision, reason: F.struct(decision.alias("decision"), F.lit(reason).alias("reason"))
    asks = c("intent").rlike("identify|troubleshoot|solve|guide")
    choice = (
        F.when(c("risk").isin("R3", "HIGH"), pick(F.lit("HUMAN"), "HIGH_RISK_REQUIRES_PROTECTIVE_HANDOFF")).when(c("specialist"), pick(F.when(c("teachers") > 0, "TEACHER").otherwise("HUMAN"), "SPECIALIST_REQUIRED"))
        .when(c("freshness"), pick(F.when(c("search"), "SEARCH").otherwise("STOP"), "FRESHNESS_REQUIRES_RETRIEVAL")).when(~c("has_target") & F.coalesce(asks, F.lit(False)), pick(F.lit("CLARIFY"), "TARGET_NOT_GROUNDED"))
        .when(c("local_confidence") < 0.5, pick(F.when(c("search"), "SEARCH").when(c("teachers") > 0, "TEACHER").otherwise("CLARIFY"), "LOCAL_CONFIDENCE_LOW"))
        .when((c("completeness") < 0.5) & (c("unknown") > 0), pick(F.lit("CLARIFY"), "DECISIVE_EVIDENCE_MISSING")).otherwise(pick(F.lit("LOCAL"), "LOCAL_EVIDENCE_ADEQUATE"))
    )
    return rows.withColumn("_c", choice).withColumns({"decision": F.col("_c.decision"), "reason": F.col("_c.reason")}).drop("_c")


def verdict(route: Column, failed: Column, requires: Column, risk: Column, claims: Column, claims_ok: Column, conflict: Column, unresolved: Column, usable: Column) -> Column:
    """``struct(status, reason)`` of an execution's result: safety before conflicts, conflicts before missing evidence, evidence before acceptance."""
    pick = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    return (
        F.when(failed, pick("REJECT", "execution_failed")).when(~requires, pick("NOT_REQUIRED", "terminal_presentation_or_collection_action")).when(risk == "R3", pick("SAFETY_BLOCK", "r3_result_cannot_authorize_hazardous_action"))
        .when((claims > 0) & ~claims_ok & conflict, pick("CONFLICT", "claim_sources_conflict")).when((claims > 0) & ~claims_ok, pick("REJECT", "claim_support_failed"))
        .when(unresolved, pick("CONFLICT", "independent_high_quality_sources_disagree")).when((route == "SEARCH") & (usable == 0), pick("NEED_MORE_EVIDENCE", "no_qualified_external_evidence"))
        .when(claims > 0, pick("ACCEPT", "claims_supported_within_current_evidence_boundary")).when(route == "TEACHER", pick("ACCEPT_WITH_CAVEAT", "teacher_output_is_candidate_without_structured_claims"))
        .otherwise(pick("ACCEPT", "execution_result_passed_available_checks"))
    )


def next_evidence(missing: Column) -> Column:
    """``struct(capability, target)`` of the one capture to ask for: the missing capability of highest priority; null if none can be asked for."""
    first = F.get(F.filter(F.lit(list(REQUESTS)), lambda c: F.array_contains(missing, c)), 0)
    targets = F.create_map(*[F.lit(x) for kv in REQUESTS.items() for x in kv])
    return F.when(first.isNotNull(), F.struct(first.alias("capability"), targets[first].alias("target")))


def vision_recovery(flags: Column, missing: Column, score: Column, attempts: Column, low_power: Column, can_recapture: Column) -> Column:
    """``struct(actions, reasons, escalate)``: cheap repairs first, then what the user can do, a teacher after bounded attempts."""
    has, lacks = (lambda *names: F.arrays_overlap(flags, F.lit(list(names)))), (lambda *names: F.arrays_overlap(missing, F.lit(list(names))))
    dark, blurry, glare = has("underexposed", "low_contrast"), has("blurry_or_low_detail"), has("highlight_clipping", "overexposed")
    region, whole = lacks("specific_identity", "visual_grounding", "component_parts"), lacks("object_identity", "scene_context")
    target = F.when(lacks("specific_identity"), "CROP_OR_REGION:label_or_nameplate").otherwise("CROP_OR_REGION:referenced_region")
    steps = [
        (dark, "LOCAL_ENHANCE:adaptive_preprocess"), (blurry & (attempts == 0), "LOCAL_ENHANCE:light_sharpen"), (blurry & can_recapture, "RECAPTURE:steadier_and_closer"), (glare, "LOCAL_ENHANCE:highlight_recovery"),
        (glare & can_recapture, "RECAPTURE:other_angle"), (region, target), (whole & can_recapture, "RECAPTURE:whole_object"),
    ]
    cheap = dark | (blurry & (attempts == 0)) | glare | region
    escalate = (attempts >= 2) | (~can_recapture & ~cheap) | ((score < 0.55) & low_power & (attempts >= 1))
    actions = F.array_distinct(F.array_compact(F.array(*[F.when(on, step) for on, step in [*steps, (escalate, "TEACHER:external")]])))
    reasons = {"RECOVERABLE_EXPOSURE_OR_CONTRAST": dark, "BLUR_OR_LOW_DETAIL": blurry, "HIGHLIGHT_OR_GLARE": glare, "TARGET_REGION_DECISIVE": region, "WHOLE_OBJECT_CONTEXT_MISSING": whole}
    return F.struct(actions.alias("actions"), F.array_compact(F.array(*[F.when(on, name) for name, on in reasons.items()])).alias("reasons"), escalate.alias("escalate"))


def allowed(privacy: Column, local_only: Column, sensitive: Column, consent: Column) -> Column:
    """Whether a provider with these privacy modes may see a task."""
    local = F.array_contains(privacy, "local")
    return ~(local_only & ~local) & ~(sensitive & (consent == False) & ~local)  # noqa: E712


def latency_worth(measured: Column, kind: Column) -> Column:
    """By measured milliseconds if there are any, else by class."""
    by_class = F.coalesce(*[F.when(kind == c, F.lit(w)) for c, w in CLASSES.items()], F.lit(SLOW_CLASS))
    by_time = F.when(measured <= MEASURED[0][0], MEASURED[0][1])
    for limit, worth in MEASURED[1:]:
        by_time = by_time.when(measured <= limit, worth)
    return F.when(measured.isNull(), by_class).otherwise(by_time.otherwise(SLOWEST))


SIGNATURE = ["required", "language", "needs_evidence", "needs_freshness", "local_only", "sensitive", "consent"]
GROUPS = 64  # fixed value: groups of providers whose best bound what must be sorted


def ranked_teachers(tasks: DataFrame, providers: DataFrame, key: str, top: int) -> DataFrame:
    """``(key, place, provider, score)``: the best ``top`` providers of every task.

    Tasks ask in few ways; each way of asking (required capabilities, language and needs) is ranked once. Ways are sent to the providers, which are
    compared where they lie, and the best of each way to the tasks, so neither table is shuffled. A provider is sorted only if it reaches the score
    that ``top`` of the ``GROUPS`` groups of providers reach with their best.
    """
    ways = tasks.select(*SIGNATURE).distinct().withColumn("way", F.xxhash64(*SIGNATURE)).withColumn("capability", F.get("required", F.lit(0)))
    able = providers.filter("healthy").select("*", F.explode(F.array_distinct("capabilities.capability")).alias("capability"))
    fits = F.flatten(F.transform("required", lambda r: F.filter("capabilities", lambda x: x["capability"] == r)))
    met = able.join(F.broadcast(ways), "capability")  # a provider meets a way by the first capability that is required
    met = met.filter((F.size(fits) == F.size("required")) & allowed(F.col("privacy"), F.col("local_only"), F.col("sensitive"), F.col("consent")))
    rows = met.withColumn("fit", F.aggregate(fits, F.lit(0.0), lambda a, x: a + x["score"]) / F.size("required"))
    c = F.col
    speaks = (c("language") == "auto") | F.arrays_overlap("languages", F.array(F.lit("auto"), "language"))
    worth = {
        "task": c("fit"), "capability": c("fit"), "evidence": F.when(c("needs_evidence"), c("evidence")).otherwise(F.greatest(F.lit(0.5), "evidence")), "freshness": F.when(c("needs_freshness"), c("freshness")).otherwise(F.greatest(F.lit(0.6), "freshness")),
        "reliability": c("reliability"), "history": c("history"), "language": F.when(speaks, 1.0).otherwise(0.4), "latency": latency_worth(c("measured_ms"), c("latency_class")),
    }
    score = sum((worth[name] * weight for name, weight in WEIGHTS.items()), F.lit(0.0)) + c("priority") * PRIORITY
    scored = rows.select("way", "provider", score.alias("score"))
    firsts = scored.groupBy("way", F.pmod(F.hash("provider"), F.lit(GROUPS)).alias("g")).agg(F.max("score").alias("first"))
    least = firsts.groupBy("way").agg(F.get(F.sort_array(F.collect_list("first"), asc=False), F.lit(top - 1)).alias("least"))
    near = scored.join(F.broadcast(least), "way").filter("least is null or score >= least")
    place = F.row_number().over(Window.partitionBy("way").orderBy(F.desc("score"), "provider"))
    best = near.select("way", "provider", "score").withColumn("place", place).filter(F.col("place") <= top)
    return tasks.select(key, F.xxhash64(*SIGNATURE).alias("way")).join(F.broadcast(best), "way").select(key, "place", "provider", "score")
