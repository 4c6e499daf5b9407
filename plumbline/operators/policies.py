"""Decision tables over evidence, readings, goals and offers, as column expressions and small joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.scalars import canonical_key, clamp, half_up
from plumbline.operators.machine import Machine, stepped

# fixed values: patterns of source kinds, in the order they are tried
SOURCE_KINDS = [
    ("government", r"\.gov(\.|/|$)|\.gob\.mx(/|$)|government|gobierno|secretar[ií]a|instituto nacional"),
    ("community", r"reddit|forum|foro|community|comunidad"),
    ("professional_database", r"database|wikidata|gbif|open food facts|manualslib"),
    ("retailer", r"store|shop|tienda|dealer|distribuidor|retailer|mercado|walmart|amazon|homedepot|costco"),
    ("official", r"official|oficial|manufacturer|fabricante|brand|marca"),
]
# fixed values: patterns of task kinds
LEGAL, PRICE = r"law|legal|regulation|法规|法律|规定|移民|税", r"price|shopping|多少钱|价格|哪里买|购买"
SAFETY, MANUAL = r"medical|health|safety|医疗|健康|安全", r"manual|compatib|repair|maintenance|说明书|兼容|维修|保养|配件"
# fixed values: base worth of a source kind, and how it fits a task kind (default last)
BASE = {"government": 0.96, "official": 0.92, "professional_database": 0.86, "retailer": 0.74, "web": 0.58, "community": 0.42}
FIT = {
    "strict": ({"government": 1.0, "official": 0.8, "professional_database": 0.72}, 0.35), "price": ({"retailer": 1.0, "official": 0.82, "web": 0.7}, 0.55),
    "manual": ({"official": 1.0, "professional_database": 0.82, "government": 0.75, "web": 0.55}, 0.4), "general": ({"community": 0.55}, 0.85),
}
# fixed values: how much a kind of evidence decides a class of claim
AUTHORITY = {
    "barcode": {"barcode": 1, "official": 0.94, "retailer": 0.78, "ocr": 0.62, "vision": 0.35, "teacher": 0.55, "web": 0.5, "community": 0.25},
    "product_identity": {"barcode": 1, "official": 0.95, "ocr": 0.86, "professional_database": 0.84, "teacher": 0.72, "vision": 0.68, "retailer": 0.66, "web": 0.52, "community": 0.3},
    "model": {"barcode": 0.96, "official": 0.95, "ocr": 0.9, "professional_database": 0.82, "teacher": 0.74, "vision": 0.62, "retailer": 0.6, "web": 0.5, "community": 0.28},
    "size": {"ocr": 0.94, "barcode": 0.9, "official": 0.9, "professional_database": 0.82, "teacher": 0.7, "vision": 0.58, "retailer": 0.58, "web": 0.48, "community": 0.25},
    "variant": {"barcode": 0.94, "ocr": 0.9, "official": 0.9, "teacher": 0.74, "vision": 0.7, "professional_database": 0.7, "retailer": 0.6, "web": 0.48, "community": 0.25},
    "color": {"pixel": 0.96, "vision": 0.9, "ocr": 0.48, "teacher": 0.78, "official": 0.65, "web": 0.45, "community": 0.25},
    "text": {"ocr": 0.98, "teacher": 0.82, "vision": 0.55, "official": 0.5, "web": 0.4, "community": 0.2},
    "receipt_total": {"ocr": 0.92, "arithmetic": 0.98, "user": 0.95, "teacher": 0.72, "vision": 0.42, "web": 0.1, "community": 0.05},
    "current_price": {"retailer": 0.96, "official": 0.88, "web": 0.72, "teacher": 0.62, "community": 0.42, "ocr": 0.35, "vision": 0.2},
    "current_availability": {"retailer": 0.98, "official": 0.86, "web": 0.7, "teacher": 0.58, "community": 0.35},
    "law": {"government": 1, "official": 0.92, "professional_database": 0.78, "teacher": 0.7, "web": 0.52, "community": 0.18},
    "safety": {"government": 0.98, "official": 0.9, "professional_database": 0.86, "teacher": 0.72, "web": 0.5, "community": 0.2},
    "manual": {"official": 1, "professional_database": 0.82, "teacher": 0.72, "web": 0.56, "community": 0.34, "vision": 0.3},
}
DEFAULT_AUTHORITY = {
    "government": 0.9, "official": 0.86, "professional_database": 0.78, "barcode": 0.82, "ocr": 0.72, "pixel": 0.72, "vision": 0.66, "teacher": 0.66,
    "retailer": 0.64, "user": 0.6, "web": 0.5, "community": 0.3,
}
# fixed values: patterns of claim classes in order; those of the second list look at the field alone
CLAIM_CLASSES = [
    ("barcode", r"barcode|gtin|ean|upc", False), ("receipt_total", r"receipt.*total|total.*receipt|subtotal|importe|金额|总额", False), ("current_price", r"current.*price|price|shopping|多少钱|价格|哪里买", False),
    ("current_availability", r"availability|stock|in stock|库存|有货", False), ("law", LEGAL, False), ("safety", SAFETY, False), ("manual", r"manual|compatib|说明书|兼容", False),
    ("model", r"model|型号", True), ("size", r"size|capacity|容量|规格", True), ("variant", r"variant|flavor|sabor|款式|口味", True), ("color", r"color|颜色", True), ("text", r"text|ocr|文字", True),
    ("product_identity", r"brand|product|identity|商品|品牌", False),
]
# fixed values: what a question's words say about how fast its answer ages
LIVE = r"现在|当前|今天|今日|此刻|实时|库存|营业|开门|关门|汇率|天气|航班|路况|today|now|current|live|open now|in stock|exchange rate|weather|hoy|ahora|actual|abierto|existencia|tipo de cambio"
FAST = r"价格|多少钱|便宜|哪里买|最新|新闻|活动|优惠|折扣|法规|规定|政策|预约|票价|price|cost|cheapest|latest|news|sale|discount|law|regulation|policy|availability|precio|cuánto|barato|últim|noticia|oferta|ley|reglamento|disponibilidad"
SLOW = r"规格|参数|型号|说明书|兼容|成分|保修|spec|manual|model|compatib|warranty|especific|modelo|garantía"
#: Seconds that an answer of each class may be old.
MAX_AGE = {"LIVE": 900, "FAST_CHANGING": 86_400, "SLOW_CHANGING": 90 * 86_400}


def lookup(values: dict, key: Column, default: float | None = None) -> Column:
    found = F.create_map(*[F.lit(x if isinstance(x, str) else float(x)) for kv in values.items() for x in kv])[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def first_match(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    return F.coalesce(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in rules], F.lit(default))


def source_type(text: Column) -> Column:
    """Kind of source by the lower-case text of its address, publisher and title."""
    return first_match(text, SOURCE_KINDS, "web")


def task_fit(kind: Column, task: Column) -> Column:
    pick = lambda name: lookup(FIT[name][0], kind, FIT[name][1])
    return F.when(task.rlike(LEGAL) | task.rlike(SAFETY), pick("strict")).when(task.rlike(PRICE), pick("price")).when(task.rlike(MANUAL), pick("manual")).otherwise(pick("general"))


def source_score(kind: Column, task: Column, credibility: Column, relevance: Column) -> Column:
    return half_up(clamp(lookup(BASE, kind, 0.5) * 0.5 + task_fit(kind, task) * 0.3 + clamp(credibility) * 0.1 + clamp(relevance) * 0.1))


def source_tier(score: Column) -> Column:
    return F.when(score >= 0.88, "A").when(score >= 0.74, "B").when(score >= 0.6, "C").when(score >= 0.45, "D").otherwise("E")


def minimum_score(task: Column) -> Column:
    return F.when(task.rlike(r"law|legal|regulation|法规|法律|规定|medical|health|医疗|健康|安全"), 0.72).when(task.rlike(MANUAL), 0.65).when(task.rlike(PRICE), 0.58).otherwise(0.5)


def claim_class(field: Column, task: Column) -> Column:
    both = F.concat_ws(" ", field, task)
    return F.coalesce(*[F.when((field if alone else both).rlike(pattern), F.lit(name)) for name, pattern, alone in CLAIM_CLASSES], F.lit("generic"))


def authority(claim: Column, kind: Column) -> Column:
    table = F.coalesce(*[F.when(claim == name, lookup(values, kind)) for name, values in AUTHORITY.items()])
    return clamp(F.coalesce(table, lookup(DEFAULT_AUTHORITY, kind, 0.45)))


def authority_tier(value: Column) -> Column:
    return F.when(value >= 0.9, "decisive").when(value >= 0.78, "strong").when(value >= 0.6, "supporting").otherwise("weak")


def freshness_class(text: Column) -> Column:
    value = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(value.rlike(LIVE), "LIVE").when(value.rlike(FAST), "FAST_CHANGING").when(value.rlike(SLOW), "SLOW_CHANGING").otherwise("STATIC")


def is_fresh(at: Column, now: Column, seconds: Column) -> Column:
    """Whether a moment is at most so many seconds before ``now``; unknown moments are not, without a limit all known ones are."""
    age = F.unix_timestamp(now) - F.unix_timestamp(at.cast("timestamp"))
    return F.coalesce(seconds.isNull() | (age <= seconds), F.lit(False)) & at.isNotNull()


def issues(checks: dict[str, Column]) -> Column:
    """The names whose condition holds, in their order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks.items()]))


def difficulty(flags: Column, quality: Column) -> Column:
    """``struct(level, score)`` of an image from its flags and quality."""
    has = lambda *names: F.arrays_overlap(flags, F.array(*map(F.lit, names)))
    add = lambda c, n: F.when(c, n).otherwise(0)
    score = (
        add(has("underexposed", "overexposed"), 2) + add(has("low_contrast"), 2) + add(has("blurry_or_low_detail"), 2) + add(has("dark_clipping", "highlight_clipping"), 1)
        + add(F.coalesce(quality < 0.45, F.lit(False)), 2) - add(F.coalesce(quality >= 0.75, F.lit(False)) & (F.size(flags) == 0), 1)
    )
    return F.struct(F.when(score >= 4, "hard").when(score >= 2, "medium").otherwise("easy").alias("level"), score.alias("score"))


def ocr_recovery(df: DataFrame) -> DataFrame:
    """``flags, score, critical, conflicts, has_text, engines, attempts, can_recapture`` to reasons, ordered actions and whether to escalate."""
    has = lambda *names: F.arrays_overlap("flags", F.array(*map(F.lit, names)))
    c = F.col
    blur, glare, dark = has("blurry_or_low_detail"), has("highlight_clipping", "overexposed"), has("underexposed", "low_contrast")
    conflict, critical = c("conflicts") > 0, c("critical") < 1
    reasons = issues({
        "NO_TEXT_RECOVERED": ~c("has_text"), "LOW_CONTRAST_OR_DARK": dark, "BLUR_OR_LOW_DETAIL": blur, "GLARE_OR_OVEREXPOSURE": glare, "CRITICAL_FIELDS_MISSING": critical,
        "SEMANTIC_CONFLICT": conflict, "LOW_EVIDENCE_SCORE": (c("score") > 0) & (c("score") < 72),
    })
    cheap = ~c("has_text") | dark | (blur & (c("attempts") == 0)) | critical
    unresolved = (c("score") < 82) | critical | conflict | ~c("has_text")
    escalate = unresolved & ((c("attempts") >= 2) | (~c("can_recapture") & ~(cheap | ((c("engines") < 2) & conflict))))
    actions = issues({
        "TEXT_FOCUSED_CROP:label": ~c("has_text"), "ALTERNATE_PREPROCESS:contrast": dark, "ALTERNATE_PREPROCESS:sharpen": blur & (c("attempts") == 0), "RECAPTURE:closer": blur & c("can_recapture"),
        "RECAPTURE:angle": glare & c("can_recapture"), "TEXT_FOCUSED_CROP:summary": critical, "VERIFY_WITH_ALTERNATE_ENGINE": conflict, "TEACHER": escalate,
    })
    return df.withColumns({"reasons": reasons, "actions": actions, "needed": unresolved, "escalate": escalate})


def perception_gate(df: DataFrame) -> DataFrame:
    """``confidence, agreement, sensor, critical, rivals`` to a score and what becomes of the observation."""
    c = clamp(F.coalesce("confidence", F.lit(0.5)))
    score = half_up(0.5 * c + 0.25 * clamp(F.coalesce(F.col("agreement"), c)) + 0.25 * clamp(F.col("sensor")))
    limit = F.when(F.col("critical"), 0.84).otherwise(0.68)
    out = df.withColumn("score", score)
    verdict = F.when(F.col("rivals") > 0, "RECOVER_OR_ESCALATE").when(F.col("score") >= limit, "ACCEPT_AS_OBSERVATION").when(F.col("score") < 0.48, "REACQUIRE_INPUT").otherwise("RECOVER_OR_ESCALATE")
    return out.withColumn("disposition", verdict)


def resolution(goals: DataFrame, resolved: DataFrame, problems: DataFrame) -> DataFrame:
    """Problems ``problem, outcome, next_action`` with goals ``problem, goal, done`` and what evidence resolves ``problem, goal``."""
    hits = resolved.select("problem", "goal", F.lit(True).alias("hit")).distinct()
    marked = goals.join(hits, ["problem", "goal"], "left").withColumn("ok", F.coalesce("hit", F.lit(False)) | F.coalesce("done", F.lit(False)))
    counted = marked.groupBy("problem").agg(F.count("*").alias("goals"), F.count_if("ok").alias("closed"), F.array_join(F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("goal")))), ",").alias("open_goals"))
    out = problems.join(counted, "problem", "left").fillna(0, ["goals", "closed"])
    status = (
        F.when(F.col("outcome") == "resolved", "resolved").when(F.col("outcome") == "not_resolved", "investigating")
        .when((F.col("goals") > 0) & (F.col("goals") == F.col("closed")), "resolved_candidate").when(F.col("next_action").isNotNull(), "action_pending").otherwise("investigating")
    )
    ratio = F.when(F.col("goals") > 0, half_up(F.col("closed") / F.col("goals"))).otherwise(0.0)
    return out.select("problem", status.alias("status"), ratio.alias("ratio"), F.coalesce("open_goals", F.lit("")).alias("open_goals"))


def planning_need(text: Column, jobs: Column, rich: Column, residuals: Column, confidence: Column) -> Column:
    """``struct(score, signals)``: whether splitting a task needs a specialist (from .48)."""
    clauses = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?i)[，,；;。!?！？]|\b(?:and|then|also|plus)\b"), lambda x: x.rlike(r"\S")))
    signals = issues({"MULTI_INTENT": clauses >= 3, "MULTI_STAGE": jobs >= 3, "DEPENDENCY_RICH": rich, "MULTIPLE_RESIDUALS": residuals >= 3, "LOW_DECOMPOSITION_CONFIDENCE": confidence < 0.62})
    score = half_up(F.least(F.lit(1.0), F.size(signals) * 0.24 + F.when(clauses >= 4, 0.18).otherwise(0.0)))
    return F.struct(score.alias("score"), F.array_join(signals, ",").alias("signals"))


def retrieval_plan(df: DataFrame) -> DataFrame:
    """``blocked, required, left, recommendation, qualified, identity_sensitive, identity_confidence`` to an action and its reason."""
    c = F.col
    advice = F.coalesce(c("recommendation"), F.when(c("qualified") > 0, "single_source_caution").otherwise("insufficient_evidence"))
    pick = lambda action, reason: F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))
    out = (
        F.when(c("blocked"), pick("blocked", "identity_verification_required")).when(~c("required"), pick("stop", "search_not_required")).when(c("left") <= 0, pick("report", "search_budget_exhausted"))
        .when(advice == "accept_consensus", pick("stop", "sufficient_independent_consensus")).when(advice == "use_resolved_preference_with_caveat", pick("stop", "conflict_resolved_with_caveat"))
        .when(c("identity_sensitive") & (c("identity_confidence") < 0.82), pick("verify_identity", "identity_too_uncertain_for_more_search"))
        .when(advice == "search_more_or_report_disagreement", pick("search_more", "unresolved_independent_source_conflict"))
        .when(c("qualified") > 0, pick("search_more", "single_source_needs_corroboration")).otherwise(pick("search_more", "insufficient_qualified_evidence"))
    )
    return df.withColumn("plan", out).select("*", "plan.*").drop("plan")


def goal_satisfaction(df: DataFrame) -> DataFrame:
    """``failed, blocked, identity, search, compare, fresh, clear, final`` (all boolean, the last six: in order) to gaps and status."""
    c = F.col
    gaps = issues({
        "required_node_failed": c("failed"), "workflow_blocked": c("blocked"), "identity_not_resolved": ~c("identity"), "requested_retrieval_not_completed": ~c("search"),
        "requested_comparison_not_completed": ~c("compare"), "freshness_evidence_missing": ~c("fresh"), "unresolved_evidence_or_conflict": ~c("clear"), "usable_final_result_missing": ~c("final"),
    })
    status = F.when(c("blocked"), "blocked").when(c("failed") | ~c("final"), "unsatisfied").when(F.size("gaps") > 0, "partial").otherwise("satisfied")
    has = lambda name: F.array_contains("gaps", name)
    action = (
        F.when(c("status") == "satisfied", "present_result").when(c("status") == "blocked", "collect_requested_user_evidence")
        .when(has("freshness_evidence_missing") | has("requested_retrieval_not_completed"), "retrieve_or_refresh_evidence").when(has("identity_not_resolved"), "resolve_identity_before_identity_dependent_claims")
        .when(has("unresolved_evidence_or_conflict"), "resolve_conflict_or_report_bounded_uncertainty").otherwise("replan_or_state_current_limit")
    )
    return df.withColumn("gaps", gaps).withColumn("status", status).withColumn("next_action", action)


def exact_identity(df: DataFrame) -> DataFrame:
    """``codes`` (valid product codes), ``brand_text, brand_seen, brand_sure, model_text, model_seen, model_sure, size, variant`` to one identity."""
    c = F.col

    def chosen(field: str) -> tuple[Column, Column]:
        text, seen, sure = c(f"{field}_text"), c(f"{field}_seen"), c(f"{field}_sure")
        clash = F.coalesce(canonical_key(text) != canonical_key(seen), F.lit(False))
        # one name under two spellings takes the surer one; the text counts .9
        return F.when(text.isNull() | (sure > 0.9), F.coalesce(seen, text)).otherwise(text), clash

    (brand, brand_clash), (model, model_clash) = chosen("brand"), chosen("model")
    codes = F.array_distinct("codes")
    barcode = F.when(F.size(codes) == 1, codes[0])
    out = df.withColumns({"barcode": barcode, "brand": brand, "model": model, "conflicts": F.array_join(issues({"barcode": F.size(codes) > 1, "brand": brand_clash, "model": model_clash}), ",")})
    there = lambda name, w: F.when(c(name).isNotNull(), w).otherwise(0.0)
    confidence = half_up(F.least(F.lit(0.99), there("barcode", 0.55) + there("model", 0.3) + there("size", 0.2) + there("brand", 0.12) + there("variant", 0.1)), 3)
    signals = sum((c(n).isNotNull().cast("int") for n in ("barcode", "model", "size")), F.lit(0))
    exact = c("barcode").isNotNull() | (c("model").isNotNull() & (c("brand").isNotNull() | c("size").isNotNull())) | (signals >= 2)
    out = out.withColumns({"confidence": confidence, "exact": exact})
    return out.withColumn("status", F.when(c("conflicts") != "", "conflicted").when(c("exact") & (c("confidence") >= 0.72), "exact_candidate").otherwise("partial"))


# fixed values: what agreement of each field is worth; all but the brand refuse an offer when they differ
MATCH_WEIGHTS = {"barcode": 5, "model": 3, "size": 2, "variant": 2, "brand": 1}


def match_keys(df: DataFrame, fields: dict[str, Column], prefix: str) -> DataFrame:
    """Adds the canonical keys of an offer's or a target's fields, once a row and before they meet."""
    return df.withColumns({f"{prefix}{n}": canonical_key(fields[n]) for n in MATCH_WEIGHTS})


def offer_match(target: str, offer: str) -> Column:
    """``struct(ok, confidence, reasons)`` of the :func:`match_keys` with these prefixes."""
    t, o = ({n: F.col(f"{prefix}{n}") for n in MATCH_WEIGHTS} for prefix in (target, offer))
    same = {n: F.coalesce(t[n] == o[n], F.lit(False)) for n in t}
    differ = {n: t[n].isNotNull() & o[n].isNotNull() & (t[n] != o[n]) for n in t}
    weight = sum((F.when(t[n].isNotNull(), w).otherwise(0) for n, w in MATCH_WEIGHTS.items()), F.lit(0))
    score = sum((F.when(same[n], w).otherwise(0) for n, w in MATCH_WEIGHTS.items()), F.lit(0))
    confidence = F.coalesce(F.try_divide(score, weight), F.lit(0.0))
    hard = differ["barcode"] | differ["model"] | differ["size"] | differ["variant"]
    return F.struct((~hard & (confidence >= 0.55)).alias("ok"), half_up(confidence, 2).alias("confidence"), F.array_join(issues({f"{n.upper()}_MISMATCH": d for n, d in differ.items()}), ",").alias("reasons"))


def compared_offers(offers: DataFrame) -> DataFrame:
    """Offers ``product, offer, identity_ok, match_ok, availability, price, shipping, observed_at, quantity`` to verdict, cost, unit price and rank."""
    c = F.col
    cost = half_up(c("price") + F.coalesce(c("shipping"), F.lit(0.0)), 2)
    verdict = F.when(~c("identity_ok"), "EXACT_IDENTITY_REQUIRED").when(~c("match_ok"), "IDENTITY_MISMATCH").when(c("availability") == "out_of_stock", "OUT_OF_STOCK").when(c("price").isNull(), "PRICE_MISSING").otherwise("accepted")
    marked = offers.withColumn("verdict", verdict).withColumn("total_cost", F.when(c("verdict") == "accepted", cost))
    marked = marked.withColumn("unit_price", F.when(c("quantity") > 0, half_up(c("total_cost") / c("quantity"), 2)))
    order = Window.partitionBy("product").orderBy(c("total_cost").asc_nulls_last(), F.desc("observed_at"), "offer")
    return marked.withColumn("place", F.when(c("verdict") == "accepted", F.row_number().over(order)))


def offer_warnings(compared: DataFrame) -> DataFrame:
    """Per product its status and warnings, from accepted offers with ``member_only, promo_ends, shipping, channel``."""
    good = F.col("verdict") == "accepted"
    some = lambda cond: F.coalesce(F.bool_or(good & cond), F.lit(False))
    warn = {"MEMBER_PRICE_PRESENT": some(F.col("member_only")), "TIME_LIMITED_PROMOTION_PRESENT": some(F.col("promo_ends").isNotNull()), "ONLINE_SHIPPING_UNKNOWN": some(F.col("shipping").isNull() & (F.col("channel") == "online"))}
    grouped = compared.groupBy("product").agg(F.count_if(good).alias("accepted"), *[w.alias(n) for n, w in warn.items()])
    status = F.when(F.col("accepted") > 0, "ready").otherwise("no_comparable_offers")
    return grouped.select("product", status.alias("status"), "accepted", F.array_join(issues({n: F.col(n) for n in warn}), ",").alias("warnings"))


# fixed values: stages of an improvement candidate, and those that may follow each
STAGES = ["proposed", "offline_evaluated", "regression_passed", "approved", "promoted", "rejected"]
FOLLOWS = {"proposed": ["offline_evaluated", "rejected"], "offline_evaluated": ["regression_passed", "rejected"], "regression_passed": ["approved", "rejected"], "approved": ["promoted", "rejected"]}
#: A candidate's machine: moves are a wanted stage, twice as many with explicit approval; a refused step leaves the stage and gains 1.
CANDIDATE = Machine.of(STAGES, [(s, ok) for s in STAGES for ok in (False, True)], lambda m, now: (m[0], 0) if m[0] in FOLLOWS.get(now, []) and (m[1] or m[0] != "approved") else (now, 1))


def candidate_steps(events: DataFrame, key: str, order: str, stretch: Column) -> DataFrame:
    """``(key, order, came_from, state, refused)`` of requests ``(wanted, approval)`` to move candidates on; ``approved`` needs approval."""
    wanted = F.array_position(F.lit(STAGES), F.col("wanted")) - 1
    rows = stepped(events, CANDIDATE, key, order, stretch, wanted * 2 + F.coalesce("approval", F.lit(False)).cast("int"))
    return rows.select(key, order, "came_from", "state", (F.col("gain") > 0).alias("refused"))
