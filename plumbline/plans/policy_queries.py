"""Queries of decision tables, over rows that are drawn from whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scalars as fn
from plumbline.operators import policies
from plumbline.plans.registry import clamp, query, r
from plumbline.sources import bindings as bind


def pick(values: list[str], number: Column) -> Column:
    """The value at a number's remainder."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def pick_sql(values: list[str], number: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[(({number}) % {len(values)} + 1)::INT]"


def case_sql(key: str, values: dict, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {float(v)}::DOUBLE" for k, v in values.items()) + f" ELSE {default} END"


def flags_sql(checks: dict[str, str]) -> str:
    """Names whose condition holds, joined by commas."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in checks.items()) + ")"


def joined(column: str) -> Column:
    return F.array_join(column, ",")


# --- sources, claims, freshness ---------------------------------------------------------------------

PUBLISHERS = ["", "Gobierno de Mexico", "reddit thread", "Wikidata", "Tienda Centro", "Official manual", "someone's page", "manualslib"]
TASKS = ["price question", "legal regulation", "repair manual", "plain question", "health safety"]


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    hay = F.lower(F.concat_ws(" ", F.coalesce("url", F.lit("")), pick(PUBLISHERS, k)))
    rows = bind.table(spark, sf_dir, "pages").select("page_id", policies.source_type(hay).alias("kind"), pick(TASKS, F.floor(k / 8)).alias("task"), ((k % 10) / 10).alias("credibility"), ((k % 7) / 7).alias("relevance"))
    score = policies.source_score(F.col("kind"), F.col("task"), F.col("credibility"), F.col("relevance"))
    return rows.withColumn("score", score).withColumn("tier", policies.source_tier(F.col("score")))


_KINDS = "CASE " + " ".join(f"WHEN regexp_matches(hay, '{p}') THEN '{n}'" for n, p in policies.SOURCE_KINDS) + " ELSE 'web' END"
_FITS = (
    f"CASE WHEN regexp_matches(task, '{policies.LEGAL}') OR regexp_matches(task, '{policies.SAFETY}') THEN {case_sql('kind', policies.FIT['strict'][0], '0.35::DOUBLE')}"
    f" WHEN regexp_matches(task, '{policies.PRICE}') THEN {case_sql('kind', policies.FIT['price'][0], '0.55::DOUBLE')} WHEN regexp_matches(task, '{policies.MANUAL}') THEN {case_sql('kind', policies.FIT['manual'][0], '0.4::DOUBLE')}"
    f" ELSE {case_sql('kind', policies.FIT['general'][0], '0.85::DOUBLE')} END"
)
SOURCES = f"""h AS (SELECT page_id, lower(coalesce(url, '') || ' ' || {pick_sql(PUBLISHERS, 'page_id')}) AS hay, {pick_sql(TASKS, 'page_id // 8')} AS task, (page_id % 10) / 10 AS credibility, (page_id % 7) / 7 AS relevance FROM pages),
k AS (SELECT *, {_KINDS} AS kind FROM h),
s AS (SELECT page_id, kind, task, {r(clamp(f"({case_sql('kind', policies.BASE, '0.5::DOUBLE')}) * 0.5::DOUBLE + ({_FITS}) * 0.3::DOUBLE + credibility * 0.1::DOUBLE + relevance * 0.1::DOUBLE"))} AS score FROM k),
t AS (SELECT *, CASE WHEN score >= 0.88 THEN 'A' WHEN score >= 0.74 THEN 'B' WHEN score >= 0.6 THEN 'C' WHEN score >= 0.45 THEN 'D' ELSE 'E' END AS tier FROM s)"""


@query(f"WITH {SOURCES} SELECT page_id, kind, task, score, tier FROM t")
def m10_source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, task fit, score and tier of each page as a source."""
    return _pages(spark, sf_dir).select("page_id", "kind", "task", "score", "tier")


@query(f"WITH {SOURCES} SELECT task, page_id, row_number() OVER (PARTITION BY page_id // 40, task ORDER BY score DESC, page_id) AS place FROM t QUALIFY place <= 5")
def o1_ranked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best sources of each request (forty pages each) and task."""
    from plumbline.operators.papers import ranked_within

    rows = _pages(spark, sf_dir).withColumn("key", F.concat_ws("-", F.floor(F.col("page_id") / 40), "task"))
    return ranked_within(rows, "key", [F.desc("score"), F.col("page_id")], 5).select("task", "page_id", "place")


@query(f"""WITH {SOURCES}, m AS (SELECT *, CASE WHEN regexp_matches(task, 'law|legal|regulation|medical|health') THEN 0.72 WHEN regexp_matches(task, 'manual|compatib|repair|maintenance') THEN 0.65 WHEN regexp_matches(task, 'price|shopping') THEN 0.58 ELSE 0.5 END AS least FROM t)
SELECT task, count(*) AS pages, count(*) FILTER (score >= least) AS usable, count(DISTINCT kind) FILTER (score >= least) AS kinds, max(score) AS best FROM m GROUP BY task""")
def p5_usable_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results that reach their task's least score."""
    rows = _pages(spark, sf_dir).withColumn("ok", F.col("score") >= policies.minimum_score(F.col("task")))
    return rows.groupBy("task").agg(F.count("*").alias("pages"), F.count_if("ok").alias("usable"), F.count_distinct(F.when(F.col("ok"), F.col("kind"))).alias("kinds"), F.max("score").alias("best"))


CLAIMS = ["barcode", "model", "size", "variant", "color", "text", "brand", "total", "price", "stock", "notes"]
EVIDENCE = ["barcode", "ocr", "pixel", "vision", "arithmetic", "government", "official", "professional_database", "retailer", "teacher", "community", "user", "web"]
ABOUT = ["", "receipt", "legal", "safety", "manual"]
_CLASS_SQL = "CASE " + " ".join(f"WHEN regexp_matches({'field' if alone else 'both_of'}, '{p}') THEN '{n}'" for n, p, alone in policies.CLAIM_CLASSES) + " ELSE 'generic' END"
_AUTHORITY_ROWS = ", ".join(f"('{c}', '{k}', {float(v)}::DOUBLE)" for c, values in policies.AUTHORITY.items() for k, v in values.items())


@query(
    f"""WITH o AS (SELECT o_orderkey AS id, {pick_sql(CLAIMS, 'o_orderkey')} AS field, {pick_sql(EVIDENCE, 'o_custkey')} AS kind, {pick_sql(ABOUT, 'o_orderkey // 11')} AS task FROM orders),
c AS (SELECT *, field || ' ' || task AS both_of FROM o), d AS (SELECT *, {_CLASS_SQL} AS claim FROM c), a(claim, kind, value) AS (VALUES {_AUTHORITY_ROWS}),
e AS (SELECT d.id, d.claim, coalesce(a.value, {case_sql('d.kind', policies.DEFAULT_AUTHORITY, '0.45::DOUBLE')}) AS authority FROM d LEFT JOIN a ON d.claim = a.claim AND d.kind = a.kind)
SELECT *, CASE WHEN authority >= 0.9 THEN 'decisive' WHEN authority >= 0.78 THEN 'strong' WHEN authority >= 0.6 THEN 'supporting' ELSE 'weak' END AS tier FROM e"""
)
def m10_claim_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much a kind of evidence decides a class of claim."""
    k = F.col("o_orderkey")
    rows = bind.table(spark, sf_dir, "orders").select(k.alias("id"), pick(CLAIMS, k).alias("field"), pick(EVIDENCE, F.col("o_custkey")).alias("kind"), pick(ABOUT, F.floor(k / 11)).alias("task"))
    rows = rows.withColumn("claim", policies.claim_class(F.col("field"), F.col("task"))).withColumn("authority", policies.authority(F.col("claim"), F.col("kind")))
    return rows.select("id", "claim", "authority", policies.authority_tier(F.col("authority")).alias("tier"))


QUESTIONS = ["what is the weather now", "cheapest price of this", "compatible manual for a pump", "what does this word mean", "¿cuánto cuesta hoy?", "latest law"]


@query(
    f"""WITH q AS (SELECT event_id, {pick_sql(QUESTIONS, 'event_id')} AS question, ts FROM events),
c AS (SELECT *, CASE WHEN regexp_matches(question, 'now|today|hoy|weather') THEN 'LIVE' WHEN regexp_matches(question, 'price|cheapest|latest|law|cuánto') THEN 'FAST_CHANGING' WHEN regexp_matches(question, 'manual|compatib') THEN 'SLOW_CHANGING' ELSE 'STATIC' END AS kind FROM q),
m AS (SELECT *, CASE kind WHEN 'LIVE' THEN 900 WHEN 'FAST_CHANGING' THEN 86400 WHEN 'SLOW_CHANGING' THEN 7776000 END AS seconds, (SELECT max(ts) FROM events) AS newest FROM c)
SELECT kind, count(*) AS n, count(*) FILTER (seconds IS NULL OR floor(epoch(newest))::BIGINT - floor(epoch(ts))::BIGINT <= seconds) AS fresh FROM m GROUP BY kind"""
)
def x4_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by how fast their answers age, and which answers of that time are still fresh at the newest event."""
    rows = bind.table(spark, sf_dir, "events").select(F.col("ts"), policies.freshness_class(pick(QUESTIONS, F.col("event_id"))).alias("kind"))
    newest = rows.agg(F.max("ts").alias("newest"))
    fresh = policies.is_fresh(F.col("ts"), F.col("newest"), policies.lookup(policies.MAX_AGE, F.col("kind")))
    return rows.crossJoin(F.broadcast(newest)).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(fresh).alias("fresh"))  # one row


# --- readings ---------------------------------------------------------------------------------------

FLAGS = ["underexposed", "low_contrast", "blurry_or_low_detail", "dark_clipping", "highlight_clipping", "overexposed"]


def _flags(number: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.floor(number / (1 << i)) % 2 == 1, F.lit(f)) for i, f in enumerate(FLAGS)]))


_F = {f: f"((k // {1 << i}) % 2 = 1)" for i, f in enumerate(FLAGS)}


@query(
    f"""WITH x AS (SELECT o_orderkey AS id, o_orderkey AS k, (o_custkey % 100) / 100 AS q FROM orders),
s AS (SELECT id, 2 * ({_F['underexposed']} OR {_F['overexposed']})::INT + 2 * {_F['low_contrast']}::INT + 2 * {_F['blurry_or_low_detail']}::INT + ({_F['dark_clipping']} OR {_F['highlight_clipping']})::INT
  + 2 * (q < 0.45)::INT - (q >= 0.75 AND k % 64 = 0)::INT AS score FROM x)
SELECT id, score, CASE WHEN score >= 4 THEN 'hard' WHEN score >= 2 THEN 'medium' ELSE 'easy' END AS level FROM s"""
)
def g18_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bind.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), policies.difficulty(_flags(F.col("o_orderkey")), (F.col("o_custkey") % 100) / 100).alias("d"))
    return rows.select("id", "d.score", "d.level")


_REC = {
    "NO_TEXT_RECOVERED": "NOT has_text", "LOW_CONTRAST_OR_DARK": "dark", "BLUR_OR_LOW_DETAIL": "blur", "GLARE_OR_OVEREXPOSURE": "glare", "CRITICAL_FIELDS_MISSING": "critical < 1",
    "SEMANTIC_CONFLICT": "conflicts > 0", "LOW_EVIDENCE_SCORE": "score > 0 AND score < 72",
}
_ACT = {
    "TEXT_FOCUSED_CROP:label": "NOT has_text", "ALTERNATE_PREPROCESS:contrast": "dark", "ALTERNATE_PREPROCESS:sharpen": "blur AND attempts = 0", "RECAPTURE:closer": "blur AND again", "RECAPTURE:angle": "glare AND again",
    "TEXT_FOCUSED_CROP:summary": "critical < 1", "VERIFY_WITH_ALTERNATE_ENGINE": "conflicts > 0", "TEACHER": "escalate",
}


@query(
    f"""WITH x AS (SELECT o_orderkey AS id, o_orderkey AS k, o_custkey % 101 AS score, (o_custkey % 3) / 2 AS critical, (o_orderkey // 3) % 2 AS conflicts, o_orderkey % 13 <> 0 AS has_text, o_orderkey % 3 AS engines, o_custkey % 4 AS attempts, o_orderkey % 5 <> 0 AS again FROM orders),
y AS (SELECT *, {_F['underexposed']} OR {_F['low_contrast']} AS dark, {_F['blurry_or_low_detail']} AS blur, {_F['highlight_clipping']} OR {_F['overexposed']} AS glare FROM x),
z AS (SELECT *, score < 82 OR critical < 1 OR conflicts > 0 OR NOT has_text AS needed, NOT has_text OR dark OR (blur AND attempts = 0) OR critical < 1 AS cheap FROM y),
w AS (SELECT *, needed AND (attempts >= 2 OR (NOT again AND NOT (cheap OR (engines < 2 AND conflicts > 0)))) AS escalate FROM z)
SELECT id, {flags_sql(_REC)} AS reasons, {flags_sql(_ACT)} AS actions, needed, escalate FROM w"""
)
def g18_ocr_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = bind.table(spark, sf_dir, "orders").select(
        k.alias("id"), _flags(k).alias("flags"), (c % 101).alias("score"), (c % 3 / 2).alias("critical"), (F.floor(k / 3) % 2).alias("conflicts"), (k % 13 != 0).alias("has_text"), (k % 3).alias("engines"),
        (c % 4).alias("attempts"), (k % 5 != 0).alias("can_recapture"),
    )
    return policies.ocr_recovery(rows).select("id", joined("reasons").alias("reasons"), joined("actions").alias("actions"), "needed", "escalate")


@query(
    f"""WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_suppkey % 9 <> 0 THEN l_discount * 10 END AS confidence, CASE WHEN l_partkey % 4 <> 0 THEN l_quantity / 50 END AS agreement,
  (l_partkey % 10) / 10 AS sensor, l_linenumber = 1 AS critical, (l_suppkey % 17 = 0)::INT AS rivals FROM lineitem),
y AS (SELECT *, {clamp('coalesce(confidence, 0.5::DOUBLE)')} AS c FROM x),
z AS (SELECT *, {r(f"0.5::DOUBLE * c + 0.25::DOUBLE * {clamp('coalesce(agreement, c)')} + 0.25::DOUBLE * sensor")} AS score FROM y)
SELECT id, score, CASE WHEN rivals > 0 THEN 'RECOVER_OR_ESCALATE' WHEN score >= CASE WHEN critical THEN 0.84 ELSE 0.68 END THEN 'ACCEPT_AS_OBSERVATION' WHEN score < 0.48 THEN 'REACQUIRE_INPUT' ELSE 'RECOVER_OR_ESCALATE' END AS disposition FROM z"""
)
def g19_perception_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bind.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_suppkey") % 9 != 0, F.col("l_discount") * 10).alias("confidence"), F.when(F.col("l_partkey") % 4 != 0, F.col("l_quantity") / 50).alias("agreement"),
        ((F.col("l_partkey") % 10) / 10).alias("sensor"), (F.col("l_linenumber") == 1).alias("critical"), (F.col("l_suppkey") % 17 == 0).cast("int").alias("rivals"),
    )
    return policies.perception_gate(rows).select("id", "score", "disposition")


# --- goals, plans, identities, offers ---------------------------------------------------------------


@query(
    f"""WITH p AS (SELECT o_orderkey AS problem, CASE o_orderkey % 9 WHEN 0 THEN 'resolved' WHEN 1 THEN 'not_resolved' END AS outcome, CASE WHEN o_custkey % 3 = 0 THEN 'ask' END AS next_action FROM orders),
h AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.05),
g AS (SELECT l.l_orderkey AS problem, l.l_linenumber AS goal, l_linestatus = 'F' OR h.l_orderkey IS NOT NULL AS ok FROM lineitem l LEFT JOIN h USING (l_orderkey, l_linenumber)),
c AS (SELECT problem, count(*) AS goals, count(*) FILTER (ok) AS closed, string_agg(goal::VARCHAR, ',' ORDER BY goal) FILTER (NOT ok) AS open_goals FROM g GROUP BY 1)
SELECT problem, CASE WHEN outcome = 'resolved' THEN 'resolved' WHEN outcome = 'not_resolved' THEN 'investigating' WHEN coalesce(goals, 0) > 0 AND goals = closed THEN 'resolved_candidate' WHEN next_action IS NOT NULL THEN 'action_pending' ELSE 'investigating' END AS status,
  CASE WHEN coalesce(goals, 0) > 0 THEN {r('closed / goals')} ELSE 0.0::DOUBLE END AS ratio, coalesce(open_goals, '') AS open_goals FROM p LEFT JOIN c USING (problem)"""
)
def g21_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as problems, lines as goals, returned lines with a discount as evidence."""
    items = bind.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("problem"), F.col("l_linenumber").cast("string").alias("goal"), (F.col("l_linestatus") == "F").alias("done"), ((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05)).alias("hit"))
    k = F.col("o_orderkey")
    problems = bind.table(spark, sf_dir, "orders").select(k.alias("problem"), F.when(k % 9 == 0, "resolved").when(k % 9 == 1, "not_resolved").alias("outcome"), F.when(F.col("o_custkey") % 3 == 0, "ask").alias("next_action"))
    return policies.resolution(items.select("problem", "goal", "done"), items.filter("hit").select("problem", "goal"), problems)


_SIGNALS = {"MULTI_INTENT": "clauses >= 3", "MULTI_STAGE": "jobs >= 3", "DEPENDENCY_RICH": "rich", "MULTIPLE_RESIDUALS": "residuals >= 3", "LOW_DECOMPOSITION_CONFIDENCE": "confidence < 0.62"}


@query(
    f"""WITH x AS (SELECT conv_id, turn, len(list_filter(string_split_regex(coalesce(text, ''), '(?i)[，,；;。!?！？]|\\b(?:and|then|also|plus)\\b'), lambda t: regexp_matches(t, '\\S'))) AS clauses,
  turn % 5 AS jobs, conv_id % 3 = 0 AS rich, (conv_id + turn) % 5 AS residuals, (conv_id % 10) / 10 AS confidence FROM conversations),
y AS (SELECT *, {flags_sql(_SIGNALS)} AS signals, {" + ".join(f"({c})::INT" for c in _SIGNALS.values())} AS n FROM x)
SELECT conv_id, turn, signals, {r('least(1.0::DOUBLE, n * 0.24::DOUBLE + CASE WHEN clauses >= 4 THEN 0.18::DOUBLE ELSE 0.0::DOUBLE END)')} AS score FROM y"""
)
def g24_planning_need(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    rows = bind.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.array(policies.planning_need(F.col("text"), t % 5, c % 3 == 0, (c + t) % 5, (c % 10) / 10))).alias("n"))
    return rows.select("conv_id", "turn", "n.signals", "n.score")


ADVICE = ["accept_consensus", "use_resolved_preference_with_caveat", "search_more_or_report_disagreement"]


@query(
    """WITH x AS (SELECT o_orderkey AS id, o_orderkey % 19 = 0 AS blocked, o_custkey % 5 <> 0 AS required, 3 - o_orderkey % 5 AS left_over, CASE (o_custkey // 5) % 6 WHEN 0 THEN 'accept_consensus' WHEN 1 THEN 'use_resolved_preference_with_caveat' WHEN 2 THEN 'search_more_or_report_disagreement' END AS advice,
  o_orderkey % 3 AS qualified, o_custkey % 2 = 0 AS sensitive, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 100) / 100 END AS sure FROM orders),
y AS (SELECT id, CASE WHEN blocked THEN 'blocked:identity_verification_required' WHEN NOT required THEN 'stop:search_not_required' WHEN left_over <= 0 THEN 'report:search_budget_exhausted'
  WHEN advice = 'accept_consensus' THEN 'stop:sufficient_independent_consensus' WHEN advice = 'use_resolved_preference_with_caveat' THEN 'stop:conflict_resolved_with_caveat'
  WHEN sensitive AND sure < 0.82 THEN 'verify_identity:identity_too_uncertain_for_more_search' WHEN advice = 'search_more_or_report_disagreement' THEN 'search_more:unresolved_independent_source_conflict'
  WHEN qualified > 0 THEN 'search_more:single_source_needs_corroboration' ELSE 'search_more:insufficient_qualified_evidence' END AS p FROM x)
SELECT id, split_part(p, ':', 1) AS action, split_part(p, ':', 2) AS reason FROM y"""
)
def g11_retrieval_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    turn = F.floor(c / 5) % 6
    rows = bind.table(spark, sf_dir, "orders").select(
        k.alias("id"), (k % 19 == 0).alias("blocked"), (c % 5 != 0).alias("required"), (3 - k % 5).alias("left"), F.when(turn < 3, pick(ADVICE, turn)).alias("recommendation"), (k % 3).alias("qualified"),
        (c % 2 == 0).alias("identity_sensitive"), F.when(k % 7 != 0, k % 100 / 100).alias("identity_confidence"),
    )
    return policies.retrieval_plan(rows).select("id", "action", "reason")


_GOAL = {
    "required_node_failed": "failed", "workflow_blocked": "blocked", "identity_not_resolved": "NOT identity", "requested_retrieval_not_completed": "NOT search", "requested_comparison_not_completed": "NOT compare",
    "freshness_evidence_missing": "NOT fresh", "unresolved_evidence_or_conflict": "NOT clear", "usable_final_result_missing": "NOT final",
}


@query(
    f"""WITH x AS (SELECT o_orderkey AS id, bool_or(l_returnflag = 'R' AND l_discount > 0.08) AS failed, bool_or(l_quantity > 49) AS blocked, o_custkey % 4 <> 0 AS identity, o_orderkey % 5 <> 0 AS search, o_orderkey % 7 <> 0 AS compare,
  max(l_shipdate) >= o_orderdate + INTERVAL 60 DAY AS fresh, o_custkey % 6 <> 0 AS clear, bool_or(l_linestatus = 'F') OR o_orderkey % 3 <> 0 AS final FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate),
y AS (SELECT id, {flags_sql(_GOAL)} AS gaps, CASE WHEN blocked THEN 'blocked' WHEN failed OR NOT final THEN 'unsatisfied' WHEN NOT (identity AND search AND compare AND fresh AND clear) THEN 'partial' ELSE 'satisfied' END AS status, search AND fresh AS current, identity, clear FROM x)
SELECT id, gaps, status, CASE WHEN status = 'satisfied' THEN 'present_result' WHEN status = 'blocked' THEN 'collect_requested_user_evidence' WHEN NOT current THEN 'retrieve_or_refresh_evidence' WHEN NOT identity THEN 'resolve_identity_before_identity_dependent_claims'
  WHEN NOT clear THEN 'resolve_conflict_or_report_bounded_uncertainty' ELSE 'replan_or_state_current_limit' END AS next_action FROM y"""
)
def g15_goal_satisfaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as workflows, their lines as nodes."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    lines = bind.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.08)).alias("failed"), F.bool_or(F.col("l_quantity") > 49).alias("blocked"), F.max("l_shipdate").alias("last"), F.bool_or(F.col("l_linestatus") == "F").alias("done")
    )
    rows = bind.table(spark, sf_dir, "orders").join(lines, "o_orderkey").select(
        k.alias("id"), "failed", "blocked", (c % 4 != 0).alias("identity"), (k % 5 != 0).alias("search"), (k % 7 != 0).alias("compare"), (F.col("last") >= F.col("o_orderdate") + F.expr("interval 60 days")).alias("fresh"),
        (c % 6 != 0).alias("clear"), (F.col("done") | (k % 3 != 0)).alias("final"),
    )
    return policies.goal_satisfaction(rows).select("id", joined("gaps").alias("gaps"), "status", "next_action")


IDENTITY = f"""i0 AS (SELECT p_partkey AS product, CASE WHEN p_partkey % 3 <> 0 THEN 'C' || p_partkey END AS barcode, p_partkey % 41 = 0 AND p_partkey % 3 <> 0 AS twice,
  CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS bt, CASE WHEN p_partkey % 4 = 0 THEN 'Other' WHEN p_partkey % 4 = 1 THEN upper(p_brand) END AS bs, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS model,
  CASE WHEN p_size % 3 <> 0 THEN p_size::VARCHAR END AS size, CASE WHEN p_size % 7 = 0 THEN 'v' END AS variant, CASE WHEN p_partkey % 8 = 0 THEN 0.95 ELSE 0.6 END AS sure FROM part),
i1 AS (SELECT product, CASE WHEN NOT twice THEN barcode END AS barcode, CASE WHEN bt IS NULL OR sure > 0.9 THEN coalesce(bs, bt) ELSE bt END AS brand, model, size, variant,
  concat_ws(',', CASE WHEN twice THEN 'barcode' END, CASE WHEN bt IS NOT NULL AND bs IS NOT NULL AND p0 THEN 'brand' END) AS conflicts
  FROM (SELECT *, regexp_replace(lower(bt), '[^a-z0-9]', '', 'g') <> regexp_replace(lower(bs), '[^a-z0-9]', '', 'g') AS p0 FROM i0)),
i2 AS (SELECT *, {r('''least(0.99::DOUBLE, (barcode IS NOT NULL)::INT * 0.55::DOUBLE + (model IS NOT NULL)::INT * 0.3::DOUBLE + (size IS NOT NULL)::INT * 0.2::DOUBLE + (brand IS NOT NULL)::INT * 0.12::DOUBLE + (variant IS NOT NULL)::INT * 0.1::DOUBLE)''', 3)} AS confidence,
  barcode IS NOT NULL OR (model IS NOT NULL AND (brand IS NOT NULL OR size IS NOT NULL)) AS exact FROM i1),
i3 AS (SELECT *, CASE WHEN conflicts <> '' THEN 'conflicted' WHEN exact AND confidence >= 0.72 THEN 'exact_candidate' ELSE 'partial' END AS status FROM i2)"""


def _identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    code = F.concat(F.lit("C"), k)
    codes = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 41 == 0, F.array(code, F.lit("C0"))).otherwise(F.array(code, code))
    rows = bind.table(spark, sf_dir, "part").select(
        k.alias("product"), codes.alias("codes"), F.when(k % 5 != 0, F.col("p_brand")).alias("brand_text"), F.when(k % 4 == 0, "Other").when(k % 4 == 1, F.upper("p_brand")).alias("brand_seen"), F.when(k % 8 == 0, 0.95).otherwise(0.6).alias("brand_sure"),
        F.when(k % 2 == 0, F.col("p_type")).alias("model_text"), F.lit(None).cast("string").alias("model_seen"), F.lit(0.0).alias("model_sure"), F.when(s % 3 != 0, s.cast("string")).alias("size"), F.when(s % 7 == 0, "v").alias("variant"),
    )
    return policies.exact_identity(rows)


@query(f"WITH {IDENTITY} SELECT product, barcode, brand, model, size, variant, conflicts, confidence, exact, status FROM i3")
def g13_exact_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _identities(spark, sf_dir).select("product", "barcode", "brand", "model", "size", "variant", "conflicts", "confidence", "exact", "status")


OFFER = f"""{IDENTITY}, o AS (SELECT l_orderkey * 10 + l_linenumber AS offer, l_partkey AS product, CASE WHEN l_linenumber = 1 THEN 'C' || l_partkey WHEN l_linenumber = 2 THEN 'C1' END AS b, CASE WHEN l_suppkey % 3 = 0 THEN p_type END AS m, p_size::VARCHAR AS s, p_brand AS br,
  CASE WHEN l_returnflag = 'R' THEN 'out_of_stock' ELSE 'in_stock' END AS availability, CASE WHEN l_suppkey % 13 <> 0 THEN l_extendedprice END AS price, CASE WHEN l_suppkey % 4 <> 0 THEN l_tax * 100 END AS shipping, l_shipdate AS observed_at, l_quantity AS quantity,
  l_suppkey % 9 = 0 AS member_only, l_suppkey % 11 = 0 AS promo, CASE WHEN l_suppkey % 2 = 0 THEN 'online' ELSE 'physical' END AS channel FROM lineitem JOIN part ON p_partkey = l_partkey),
j AS (SELECT o.*, i3.status, CASE WHEN i3.barcode IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN i3.model IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN i3.size IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN i3.variant IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN i3.brand IS NOT NULL THEN 1 ELSE 0 END AS weight,
  (lower(b) = lower(i3.barcode)) AS sb, (lower(m) = lower(i3.model)) AS sm, (s = i3.size) AS ss, regexp_replace(lower(br), '[^a-z0-9]', '', 'g') = regexp_replace(lower(i3.brand), '[^a-z0-9]', '', 'g') AS sr FROM o JOIN i3 USING (product)),
k AS (SELECT *, coalesce((5 * coalesce(sb, false)::INT + 3 * coalesce(sm, false)::INT + 2 * coalesce(ss, false)::INT + coalesce(sr, false)::INT) / nullif(weight, 0), 0) AS conf FROM j),
v AS (SELECT *, CASE WHEN status <> 'exact_candidate' THEN 'EXACT_IDENTITY_REQUIRED' WHEN sb = false OR sm = false OR ss = false OR conf < 0.55 THEN 'IDENTITY_MISMATCH' WHEN availability = 'out_of_stock' THEN 'OUT_OF_STOCK' WHEN price IS NULL THEN 'PRICE_MISSING' ELSE 'accepted' END AS verdict FROM k),
w AS (SELECT *, CASE WHEN verdict = 'accepted' THEN {r('price + coalesce(shipping, 0)', 2)} END AS total_cost FROM v)"""


def _offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = bind.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_size", "p_brand")
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    rows = bind.table(spark, sf_dir, "lineitem").join(part, "l_partkey").select(
        (F.col("l_orderkey") * 10 + n).alias("offer"), F.col("l_partkey").alias("product"), F.when(n == 1, F.concat(F.lit("C"), "l_partkey")).when(n == 2, "C1").alias("o_barcode"), F.when(s % 3 == 0, F.col("p_type")).alias("o_model"),
        F.col("p_size").cast("string").alias("o_size"), F.col("p_brand").alias("o_brand"), F.when(F.col("l_returnflag") == "R", "out_of_stock").otherwise("in_stock").alias("availability"), F.when(s % 13 != 0, F.col("l_extendedprice")).alias("price"),
        F.when(s % 4 != 0, F.col("l_tax") * 100).alias("shipping"), F.col("l_shipdate").alias("observed_at"), F.col("l_quantity").alias("quantity"), (s % 9 == 0).alias("member_only"), F.when(s % 11 == 0, "soon").alias("promo_ends"),
        F.when(s % 2 == 0, "online").otherwise("physical").alias("channel"),
    )
    target = _identities(spark, sf_dir).select("product", "barcode", "brand", "model", "size", "variant", (F.col("status") == "exact_candidate").alias("identity_ok"))
    keyed = policies.match_keys(rows, {f: F.col(f"o_{f}") if f != "variant" else F.lit(None).cast("string") for f in policies.MATCH_WEIGHTS}, "ko_")
    target = policies.match_keys(target, {f: F.col(f) for f in policies.MATCH_WEIGHTS}, "kt_")
    matched = keyed.join(target, "product").withColumn("m", policies.offer_match("kt_", "ko_")).withColumns({"match_ok": F.col("m.ok"), "match_confidence": F.col("m.confidence")})
    return policies.compared_offers(matched)


@query(
    f"""WITH {OFFER} SELECT offer, product, verdict, {r('conf', 2)} AS match_confidence, total_cost, CASE WHEN quantity > 0 THEN {r('total_cost / quantity', 2)} END AS unit_price,
  CASE WHEN verdict = 'accepted' THEN row_number() OVER (PARTITION BY product ORDER BY total_cost NULLS LAST, observed_at DESC, offer) END AS place FROM w"""
)
def g12_compared_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of lines against the identity of their part: match (J12), cost, unit price (M9) and rank."""
    return _offers(spark, sf_dir).select("offer", "product", "verdict", "match_confidence", "total_cost", "unit_price", "place")


@query(
    f"""WITH {OFFER}, g AS (SELECT product, count(*) FILTER (verdict = 'accepted') AS accepted, bool_or(verdict = 'accepted' AND member_only) AS m, bool_or(verdict = 'accepted' AND promo) AS p, bool_or(verdict = 'accepted' AND shipping IS NULL AND channel = 'online') AS s FROM w GROUP BY 1)
SELECT product, accepted, CASE WHEN accepted > 0 THEN 'ready' ELSE 'no_comparable_offers' END AS status, concat_ws(',', CASE WHEN m THEN 'MEMBER_PRICE_PRESENT' END, CASE WHEN p THEN 'TIME_LIMITED_PROMOTION_PRESENT' END, CASE WHEN s THEN 'ONLINE_SHIPPING_UNKNOWN' END) AS warnings FROM g"""
)
def g12_offer_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.offer_warnings(_offers(spark, sf_dir))


_WANTED = ["offline_evaluated", "regression_passed", "approved", "promoted", "rejected", "offline_evaluated", "regression_passed", "approved"]
STEPS = f"""t AS (SELECT user_id * 1000 + day(ts) * 31 + hour(ts) AS candidate, event_id AS seq, {pick_sql(_WANTED, 'event_id')} AS wanted, value < 60 AS approval FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY seq) AS n FROM t),
w(candidate, n, seq, came_from, state) AS (SELECT DISTINCT candidate, 0::BIGINT, NULL::BIGINT, '', 'proposed' FROM t UNION ALL
  SELECT o.candidate, o.n, o.seq, state, CASE WHEN (state, wanted) IN ({", ".join(f"('{a}', '{b}')" for a, all_of in policies.FOLLOWS.items() for b in all_of)}) AND (wanted <> 'approved' OR approval) THEN wanted ELSE state END
  FROM w JOIN o ON o.candidate = w.candidate AND o.n = w.n + 1)"""


def _candidate_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests to move candidates on, folded day by day."""
    rows = bind.table(spark, sf_dir, "events").select(
        (F.col("user_id") * 1000 + F.dayofmonth("ts") * 31 + F.hour("ts")).alias("candidate"), F.col("event_id").alias("seq"), pick(_WANTED, F.col("event_id")).alias("wanted"), (F.col("value") < 60).alias("approval")
    )
    return policies.candidate_steps(rows, "candidate", "seq", F.floor(F.col("seq") / 1000))


@query(f"WITH RECURSIVE {STEPS} SELECT candidate, seq, came_from, state FROM w WHERE n > 0 AND came_from = state")
def g17_invalid_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that the order of stages or a missing approval refuses."""
    return _candidate_steps(spark, sf_dir).filter("refused").select("candidate", "seq", "came_from", "state")


@query(f"WITH RECURSIVE {STEPS}, l AS (SELECT candidate, arg_max(state, n) AS state FROM w GROUP BY candidate) SELECT state, count(*) AS candidates FROM l GROUP BY state")
def g17_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates stand at which stage."""
    last = _candidate_steps(spark, sf_dir).groupBy("candidate").agg(F.max_by("state", "seq").alias("state"))
    return last.groupBy("state").agg(F.count("*").alias("candidates"))
