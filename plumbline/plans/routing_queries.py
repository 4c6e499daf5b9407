"""Queries of normalised records and of decisions on what to do next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scalars as fn
from plumbline.operators import documents, evidence, normalise, privacy, routing, states
from plumbline.plans.graph_queries import CASE_SQL, golden_cases
from plumbline.plans.policy_queries import pick, pick_sql
from plumbline.plans.registry import clamp, query, r
from plumbline.sources import bindings as bind


@query(
    """WITH o AS (SELECT o_orderkey AS k, floor(o_totalprice * 100 + 0.5)::BIGINT AS t, o_orderpriority AS p, o_orderdate::DATE AS d FROM orders),
f AS (SELECT k, unnest([{'f': 'merchant', 'v': p, 's': 'confirmed'}, {'f': 'date', 'v': CASE WHEN k % 3 <> 0 THEN d::VARCHAR END, 's': CASE k % 3 WHEN 0 THEN 'unresolved' WHEN 1 THEN 'confirmed' ELSE 'reviewed' END},
  {'f': 'subtotal', 'v': NULL, 's': 'unresolved'}, {'f': 'tax', 'v': CASE WHEN k % 4 = 0 THEN '0' END, 's': CASE WHEN k % 4 = 0 THEN 'confirmed' ELSE 'unresolved' END}, {'f': 'discount', 'v': NULL, 's': 'unresolved'},
  {'f': 'total', 'v': t::VARCHAR, 's': 'confirmed'}, {'f': 'cash', 'v': NULL, 's': 'missing'}, {'f': 'change', 'v': NULL, 's': 'unresolved'}]) AS x FROM o)
SELECT k AS "case", x.f AS field, x.v AS value, x.s AS status FROM f"""
)
def p1_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth of orders written in several forms."""
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    date = F.when(k % 3 == 0, '"date": null').when(k % 3 == 1, F.concat(F.lit('"date": "'), day, F.lit('"'))).otherwise(F.concat(F.lit('"date": {"value": "'), day, F.lit('", "status": "reviewed"}')))
    tax = F.when(k % 4 == 0, '"tax": {"value": 0}').otherwise('"tax": {"rule": "none"}')
    total = F.concat(F.lit('"total": '), F.floor(F.col("o_totalprice") * 100 + 0.5).cast("bigint"))
    doc = F.concat(F.lit('{"merchant": "'), "o_orderpriority", F.lit('", '), total, F.lit(', "fields": {'), date, F.lit(", "), tax, F.lit(', "cash": {"status": "missing"}}}'))
    return normalise.ground_truth(bind.table(spark, sf_dir, "orders").select(k.alias("case"), doc.alias("doc")), "case", "doc")


@query(
    """SELECT l_orderkey * 10 + l_linenumber AS id, '' AS title, CASE WHEN l_linenumber % 2 = 0 THEN 'S' || l_suppkey ELSE 'P' || l_partkey END AS seller, CASE WHEN l_linenumber % 3 = 0 THEN l_extendedprice ELSE l_quantity END AS price,
  CASE l_suppkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'MXN' END AS currency, CASE WHEN l_orderkey % 5 = 0 THEN 'physical' ELSE 'online' END AS channel, 'unknown' AS availability, l_returnflag = 'R' AS member_only FROM lineitem"""
)
def p11_normal_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k, nothing = F.col("l_linenumber"), F.col("l_orderkey"), F.lit(None)
    rows = bind.table(spark, sf_dir, "lineitem").select(
        (k * 10 + n).alias("id"), nothing.cast("string").alias("title"), F.when(n % 2 == 0, F.concat(F.lit("S"), "l_suppkey")).alias("seller"), F.concat(F.lit("P"), "l_partkey").alias("publisher"),
        F.when(n % 3 == 0, F.col("l_extendedprice")).alias("price"), F.col("l_quantity").alias("claim_value"), F.when(F.col("l_suppkey") % 3 == 0, "EUR").alias("currency"), F.when(F.col("l_suppkey") % 3 == 1, "offer_price_mxn").otherwise("title").alias("claim_key"),
        nothing.cast("string").alias("channel"), F.when(k % 5 == 0, 3.5).alias("distance_km"), nothing.cast("string").alias("availability"), F.when(F.col("l_returnflag") == "R", True).alias("member_only"), nothing.cast("date").alias("observed_at"), F.col("l_shipdate").alias("accessed_at"),
    )
    return normalise.offers(rows).drop("observed_at")


@query(
    f"""WITH b AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, l_quantity, l_partkey, l_suppkey FROM lineitem)
SELECT page, n::INT AS place, CASE WHEN l_partkey % 3 = 0 THEN 'p' || l_partkey ELSE 'block-' || n END AS id, {r(clamp('l_quantity / 40'))} AS confidence, CASE WHEN l_suppkey % 2 = 0 THEN l_quantity ELSE 0.0::DOUBLE END AS x, 'script' AS kept, CASE WHEN page % 7 = 0 THEN 'OCR_RESULT_CONFIDENCE_RANGE' END AS problem FROM b"""
)
def p12_normal_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as blocks of a recognised page."""
    block = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    pages = bind.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.array_sort(F.collect_list(block)).alias("lines"))
    nan = F.lit(float("nan"))
    blocks = F.transform("lines", lambda b: F.struct(
        F.when(b["l_partkey"] % 3 == 0, F.concat(F.lit("p"), b["l_partkey"].cast("string"))).alias("id"), F.lit(None).cast("string").alias("text"), (b["l_quantity"] / 40).alias("confidence"),
        F.when(b["l_suppkey"] % 2 == 0, b["l_quantity"]).otherwise(nan).alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("width"), F.lit(3.0).alias("height"), b["l_linenumber"].alias("line"),
    ))
    raw = pages.select("page", F.lit(None).cast("string").alias("engine"), F.lit("t").alias("text"), F.when(F.col("page") % 7 == 0, 1.5).otherwise(0.5).alias("confidence"), blocks.alias("blocks"), F.create_map(F.lit("script"), F.lit("latin"), F.lit("apiKey"), F.lit("secret")).alias("diagnostics"))
    problem = normalise.ocr_problem(F.lit("e"), F.col("text"), F.col("confidence"), F.col("blocks"))
    made = normalise.ocr_results(raw.withColumn("problem", problem))
    each = made.select("page", F.posexplode("blocks").alias("at", "b"), F.array_join(F.map_keys("diagnostics"), ",").alias("kept"), "problem")
    return each.select("page", (F.col("at") + 1).alias("place"), "b.id", fn.half_up(F.col("b.confidence")).alias("confidence"), F.col("b.bbox.x").alias("x"), "kept", "problem")


@query(
    f"""WITH {CASE_SQL}, m AS (SELECT dataset, 'sha256:' || sha256('[' || string_agg(doc, ',' ORDER BY "case") || ']') AS content_hash, bool_and(k % 50 <> 7) AS ok FROM d GROUP BY dataset)
SELECT d.dataset, "case" AS id, CASE WHEN k % 3 = 0 THEN 'hard' ELSE 'easy' END AS difficulty, regexp_extract(doc, '"receiptType":"([^"]*)"', 1) AS receipt_type, regexp_extract(doc, '"fields":(.*),"receiptType"', 1) AS expected, content_hash FROM d JOIN m ON d.dataset = m.dataset WHERE ok"""
)
def p15_benchmark_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of the datasets whose manifest still fits."""
    cases = golden_cases(spark, sf_dir)
    made = documents.manifests(cases, "dataset", "case", "doc", [])
    tampered = cases.withColumn("doc", F.when(F.col("k") % 50 == 7, F.replace(F.col("doc"), F.lit('"qty": '), F.lit('"qty": 1'))).otherwise(F.col("doc")))
    return normalise.benchmark_cases(made, tampered, "dataset", "case", "doc")


@query(
    """SELECT p_partkey AS part, concat_ws('|', split_part(p_name, ' ', 1), CASE WHEN split_part(p_name, ' ', 2) <> split_part(p_name, ' ', 1) THEN split_part(p_name, ' ', 2) END, p_brand) AS labels,
  CASE WHEN p_size >= 43 THEN 'observed' ELSE 'candidate' END AS status, CASE WHEN p_partkey % 2 = 0 THEN 'state-1' ELSE 'own' END AS claim FROM part"""
)
def p19_visual_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of parts from several arrays (also the claims of P24)."""
    claim = F.array(F.struct(F.when(F.col("p_partkey") % 2 == 1, "own").alias("id"), F.lit(None).cast("string").alias("label"), F.col("p_brand").alias("value"), (F.col("p_size") / 50).alias("confidence"), F.lit(None).cast("string").alias("status")))
    words = F.split("p_name", " ")
    labels = normalise.visual_labels(words, F.array(F.concat(F.lit(" "), "p_brand"), F.lit("  "), F.lit(None).cast("string")), F.lit(None).cast("array<string>"))
    made = F.get(normalise.claims(claim, "state"), 0)
    return bind.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.array_join(labels, "|").alias("labels"), made["status"].alias("status"), made["id"].alias("claim"))


@query("SELECT o_orderpriority AS priority, count(*) AS cases, count(*) FILTER (o_orderkey % 4 <> 0) AS hits FROM orders GROUP BY o_orderpriority")
def t4_intent_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities as intents against other writings of them."""
    said = F.when(F.col("o_orderkey") % 4 == 0, "something else").otherwise(F.concat(F.lit("  "), F.lower(F.replace("o_orderpriority", F.lit("-"), F.lit(" - "))), F.lit("!")))
    rows = bind.table(spark, sf_dir, "orders").select("o_orderpriority", normalise.same_intent(F.col("o_orderpriority"), said).alias("hit"))
    return rows.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("cases"), F.sum("hit").alias("hits"))


CODES = ["USD", "mxn", "EUR", "JPY", "XXX", "CHF"]


@query(
    f"""WITH o AS (SELECT o_orderkey AS id, floor(o_totalprice * 100 + 0.5)::BIGINT * CASE WHEN o_orderkey % 10 = 0 THEN -1 ELSE 1 END AS v, {pick_sql(CODES, 'o_orderkey')} AS c FROM orders)
SELECT id, CASE WHEN v < 0 THEN '-' ELSE '' END || CASE c WHEN 'USD' THEN '$' WHEN 'XXX' THEN '$' WHEN 'mxn' THEN 'MX$' WHEN 'EUR' THEN '€' WHEN 'JPY' THEN '¥' ELSE c || chr(160) END
  || CASE WHEN c = 'JPY' THEN format('{{:,}}', floor(abs(v) / 100 + 0.5)::BIGINT) ELSE format('{{:,}}', abs(v) // 100) || '.' || lpad((abs(v) % 100)::VARCHAR, 2, '0') END AS shown FROM o"""
)
def m8_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    minor = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("bigint") * F.when(k % 10 == 0, -1).otherwise(1)
    return bind.table(spark, sf_dir, "orders").select(k.alias("id"), normalise.money(minor, pick(CODES, k)).alias("shown"))


INTENTS, RISKS = ["identify_and_explain", "translate", "troubleshoot", "compare"], ["LOW", "LOW", "R1", "R3", "LOW", "HIGH", "LOW"]

ANSWER_SQL = f"""q AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity / 50 AS perception, l_partkey % 6 AS known, l_suppkey % 5 AS unknown, l_orderkey % 5 AS lim, l_partkey % 3 > 0 AS has, l_orderkey % 11 = 0 AS fresh, {pick_sql(RISKS, 'l_partkey')} AS risk,
  l_suppkey % 13 = 0 AS spec, l_orderkey % 2 = 0 AS search, l_partkey % 2 AS teachers, {pick_sql(INTENTS, 'l_suppkey')} AS intent, l_returnflag, l_linestatus, l_linenumber FROM lineitem),
c AS (SELECT *, {clamp('(known + 1) / (known + unknown + 1)::DOUBLE - least(0.35::DOUBLE, lim * 0.08::DOUBLE)')} AS complete FROM q),
l AS (SELECT *, {clamp(f"0.52::DOUBLE * {clamp('perception')} + 0.33::DOUBLE * complete + 0.15::DOUBLE * CASE WHEN has THEN 1.0::DOUBLE ELSE 0.45::DOUBLE END")} AS loc FROM c)"""


@query(
    f"""WITH {ANSWER_SQL}, d AS (SELECT id, loc, CASE WHEN risk IN ('R3', 'HIGH') THEN 'HUMAN/HIGH_RISK_REQUIRES_PROTECTIVE_HANDOFF' WHEN spec THEN CASE WHEN teachers > 0 THEN 'TEACHER' ELSE 'HUMAN' END || '/SPECIALIST_REQUIRED'
  WHEN fresh THEN CASE WHEN search THEN 'SEARCH' ELSE 'STOP' END || '/FRESHNESS_REQUIRES_RETRIEVAL' WHEN NOT has AND intent IN ('identify_and_explain', 'troubleshoot') THEN 'CLARIFY/TARGET_NOT_GROUNDED'
  WHEN loc < 0.5::DOUBLE THEN CASE WHEN search THEN 'SEARCH' WHEN teachers > 0 THEN 'TEACHER' ELSE 'CLARIFY' END || '/LOCAL_CONFIDENCE_LOW' WHEN complete < 0.5::DOUBLE AND unknown > 0 THEN 'CLARIFY/DECISIVE_EVIDENCE_MISSING' ELSE 'LOCAL/LOCAL_EVIDENCE_ADEQUATE' END AS x FROM l)
SELECT id, split_part(x, '/', 1) AS decision, split_part(x, '/', 2) AS reason, {r('loc')} AS local_confidence FROM d"""
)
def g20_answerability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as questions with their evidence: what to do about them."""
    k, part, supp = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    rows = bind.table(spark, sf_dir, "lineitem").select(
        (k * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") / 50).alias("perception"), (part % 6).alias("known"), (supp % 5).alias("unknown"), (k % 5).alias("limitations"), (part % 3 > 0).alias("has_target"), (k % 11 == 0).alias("freshness"),
        pick(RISKS, part).alias("risk"), (supp % 13 == 0).alias("specialist"), (k % 2 == 0).alias("search"), (part % 2).alias("teachers"), pick(INTENTS, supp).alias("intent"),
    )
    return routing.answerability(rows).select("id", "decision", "reason", fn.half_up(F.col("local_confidence")).alias("local_confidence"))


ROUTES = ["LOCAL", "SEARCH", "TEACHER", "PLAN"]


@query(
    f"""WITH q AS (SELECT {pick_sql(ROUTES, 'l_partkey')} AS route, l_suppkey % 9 = 0 AS failed, l_partkey % 10 > 0 AS req, l_suppkey % 14 = 0 AS r3, l_linenumber % 3 AS claims, l_orderkey % 3 > 0 AS ok, l_orderkey % 2 = 0 AS conflict, l_partkey % 11 = 0 AS open, l_quantity::INT % 4 AS usable FROM lineitem),
d AS (SELECT CASE WHEN failed THEN 'REJECT/execution_failed' WHEN NOT req THEN 'NOT_REQUIRED/terminal_presentation_or_collection_action' WHEN r3 THEN 'SAFETY_BLOCK/r3_result_cannot_authorize_hazardous_action' WHEN claims > 0 AND NOT ok THEN CASE WHEN conflict THEN 'CONFLICT/claim_sources_conflict' ELSE 'REJECT/claim_support_failed' END
  WHEN open THEN 'CONFLICT/independent_high_quality_sources_disagree' WHEN route = 'SEARCH' AND usable = 0 THEN 'NEED_MORE_EVIDENCE/no_qualified_external_evidence' WHEN claims > 0 THEN 'ACCEPT/claims_supported_within_current_evidence_boundary'
  WHEN route = 'TEACHER' THEN 'ACCEPT_WITH_CAVEAT/teacher_output_is_candidate_without_structured_claims' ELSE 'ACCEPT/execution_result_passed_available_checks' END AS x, route FROM q)
SELECT route, split_part(x, '/', 1) AS status, split_part(x, '/', 2) AS reason, count(*) AS results FROM d GROUP BY ALL"""
)
def g20_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on results by route."""
    k, part, supp, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    route = pick(ROUTES, part)
    found = routing.verdict(route, supp % 9 == 0, part % 10 > 0, F.when(supp % 14 == 0, "R3").otherwise("LOW"), n % 3, k % 3 > 0, k % 2 == 0, part % 11 == 0, F.col("l_quantity").cast("int") % 4)
    rows = bind.table(spark, sf_dir, "lineitem").select(route.alias("route"), found.alias("v"))
    return rows.groupBy("route", F.col("v.status").alias("status"), F.col("v.reason").alias("reason")).agg(F.count("*").alias("results"))


_MISSING = ["scene_context", "object_identity", "color_state", "component_parts", "anomaly_inspection", "specific_identity", "visual_grounding", "made_up"]


@query(
    f"""WITH q AS (SELECT l_orderkey * 10 + l_linenumber AS id, {pick_sql(_MISSING, 'l_partkey')} AS a, {pick_sql(_MISSING, 'l_suppkey')} AS b, l_quantity % 5 = 0 AS dark, l_orderkey % 3 = 0 AS blur, l_partkey % 4 = 0 AS glare, l_linenumber % 4 AS attempts, l_discount * 10 AS score, l_returnflag = 'R' AS low, l_linestatus = 'O' AS can FROM lineitem),
p(c, k, target) AS (VALUES ('visual_grounding', 1, 'referenced_region'), ('specific_identity', 2, 'identity_marker'), ('anomaly_inspection', 3, 'anomaly_region'), ('component_parts', 4, 'component_region'), ('color_state', 6, 'state_indicator'), ('object_identity', 7, 'whole_object'), ('scene_context', 8, 'wider_scene')),
x AS (SELECT q.*, coalesce(pa.k, 99) AS ka, coalesce(pb.k, 99) AS kb, pa.target AS ta, pb.target AS tb, a IN ('specific_identity', 'visual_grounding', 'component_parts') OR b IN ('specific_identity', 'visual_grounding', 'component_parts') AS region, a = 'specific_identity' OR b = 'specific_identity' AS named,
  a IN ('object_identity', 'scene_context') OR b IN ('object_identity', 'scene_context') AS whole FROM q LEFT JOIN p pa ON pa.c = a LEFT JOIN p pb ON pb.c = b),
y AS (SELECT *, attempts >= 2 OR (NOT can AND NOT (dark OR (blur AND attempts = 0) OR glare OR region)) OR (score < 0.55::DOUBLE AND low AND attempts >= 1) AS esc FROM x)
SELECT id, CASE WHEN least(ka, kb) < 99 THEN CASE WHEN ka <= kb THEN ta ELSE tb END END AS target, esc AS escalate,
  concat_ws(',', CASE WHEN dark THEN 'LOCAL_ENHANCE:adaptive_preprocess' END, CASE WHEN blur AND attempts = 0 THEN 'LOCAL_ENHANCE:light_sharpen' END, CASE WHEN blur AND can THEN 'RECAPTURE:steadier_and_closer' END, CASE WHEN glare THEN 'LOCAL_ENHANCE:highlight_recovery' END, CASE WHEN glare AND can THEN 'RECAPTURE:other_angle' END,
    CASE WHEN named THEN 'CROP_OR_REGION:label_or_nameplate' WHEN region THEN 'CROP_OR_REGION:referenced_region' END, CASE WHEN whole AND can THEN 'RECAPTURE:whole_object' END, CASE WHEN esc THEN 'TEACHER:external' END) AS actions FROM y"""
)
def g27_visual_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What picture to ask for next, and how to recover a poor one."""
    k, part, supp, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    missing = F.array(pick(_MISSING, part), pick(_MISSING, supp))
    flags = F.array_compact(F.array(F.when(F.col("l_quantity") % 5 == 0, "low_contrast"), F.when(k % 3 == 0, "blurry_or_low_detail"), F.when(part % 4 == 0, "overexposed")))
    plan = routing.vision_recovery(flags, missing, F.col("l_discount") * 10, n % 4, F.col("l_returnflag") == "R", F.col("l_linestatus") == "O")
    rows = bind.table(spark, sf_dir, "lineitem").select((k * 10 + n).alias("id"), routing.next_evidence(missing).alias("e"), plan.alias("p"))
    return rows.select("id", F.col("e.target").alias("target"), F.col("p.escalate").alias("escalate"), F.array_join("p.actions", ",").alias("actions"))


@query(
    f"""WITH t AS (SELECT o_orderkey AS task, CASE WHEN o_orderkey % 3 = 0 THEN ['vision', 'search'] WHEN o_orderkey % 3 = 1 THEN ['reasoning'] ELSE ['vision'] END AS req, CASE o_custkey % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'es' ELSE 'zh' END AS lang, o_orderstatus = 'F' AS ev, o_custkey % 2 = 0 AS fr, o_orderkey % 9 = 0 AS loc, o_custkey % 5 = 0 AS sen, o_custkey % 4 > 0 AS con FROM orders),
p AS (SELECT s_suppkey AS provider, s_suppkey % 4 AS kind, 0.5 + (s_suppkey % 10) / 20 AS worth, s_suppkey % 3 = 0 AS es, s_suppkey % 7 = 0 AS auto, s_suppkey % 6 = 0 AS local, s_suppkey % 8 > 0 AS healthy, s_acctbal / 20000 + 0.5 AS rel, (s_suppkey % 5) / 5 AS ev, (s_suppkey % 7) / 7 AS fr, s_nationkey / 25 AS hist, s_suppkey % 3 AS lat, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 300 END AS ms, s_nationkey AS pri FROM supplier),
c AS (SELECT provider, unnest(CASE kind WHEN 0 THEN ['vision', 'search', 'reasoning'] WHEN 1 THEN ['vision'] WHEN 2 THEN ['reasoning', 'search'] ELSE ['vision', 'search'] END) AS cap FROM p),
w AS (SELECT DISTINCT req, lang, ev, fr, loc, sen, con FROM t),
m AS (SELECT w.*, p.provider, p.worth, ((0.0::DOUBLE + p.worth * 0.25::DOUBLE + p.worth * 0.2::DOUBLE + CASE WHEN w.ev THEN p.ev ELSE greatest(0.5::DOUBLE, p.ev) END * 0.15::DOUBLE + CASE WHEN w.fr THEN p.fr ELSE greatest(0.6::DOUBLE, p.fr) END * 0.1::DOUBLE + p.rel * 0.1::DOUBLE + p.hist * 0.1::DOUBLE
    + CASE WHEN w.lang = 'auto' OR p.auto OR (w.lang = 'es' AND p.es) THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END * 0.05::DOUBLE
    + CASE WHEN ms IS NULL THEN CASE lat WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END WHEN ms <= 1500 THEN 1.0::DOUBLE WHEN ms <= 4000 THEN 0.8::DOUBLE WHEN ms <= 8000 THEN 0.6::DOUBLE WHEN ms <= 15000 THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END * 0.05::DOUBLE) + pri * 0.001::DOUBLE) AS score
  FROM w JOIN p ON healthy AND (SELECT count(*) FROM c WHERE c.provider = p.provider AND list_contains(w.req, c.cap)) = len(w.req) WHERE NOT (loc AND NOT local) AND NOT (sen AND NOT con AND NOT local)),
k AS (SELECT *, row_number() OVER (PARTITION BY req, lang, ev, fr, loc, sen, con ORDER BY score DESC, provider) AS place FROM m)
SELECT task, place::INT AS place, provider, {r('score')} AS score FROM t JOIN k USING (req, lang, ev, fr, loc, sen, con) WHERE place <= 3"""
)
def g8_teacher_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best suppliers, as teachers, for every order, as a task (F9, F10)."""
    k, c, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("s_suppkey")
    text = lambda *names: F.lit(list(names))
    tasks = bind.table(spark, sf_dir, "orders").select(
        k.alias("task"), F.when(k % 3 == 0, text("vision", "search")).when(k % 3 == 1, text("reasoning")).otherwise(text("vision")).alias("required"), F.when(c % 3 == 0, "auto").when(c % 3 == 1, "es").otherwise("zh").alias("language"),
        (F.col("o_orderstatus") == "F").alias("needs_evidence"), (c % 2 == 0).alias("needs_freshness"), (k % 9 == 0).alias("local_only"), (c % 5 == 0).alias("sensitive"), (c % 4 > 0).alias("consent"),
    )
    worth = 0.5 + (s % 10) / 20
    caps = F.when(s % 4 == 0, text("vision", "search", "reasoning")).when(s % 4 == 1, text("vision")).when(s % 4 == 2, text("reasoning", "search")).otherwise(text("vision", "search"))
    providers = bind.table(spark, sf_dir, "supplier").select(
        s.alias("provider"), F.transform(caps, lambda x: F.struct(x.alias("capability"), worth.alias("score"))).alias("capabilities"), F.array_compact(F.array(F.when(s % 3 == 0, "es"), F.when(s % 7 == 0, "auto"))).alias("languages"),
        F.when(s % 6 == 0, text("local", "cloud")).otherwise(text("cloud")).alias("privacy"), (s % 8 > 0).alias("healthy"), (F.col("s_acctbal") / 20000 + 0.5).alias("reliability"), (s % 5 / 5).alias("evidence"), (s % 7 / 7).alias("freshness"),
        (F.col("s_nationkey") / 25).alias("history"), F.when(s % 3 == 0, "fast").when(s % 3 == 1, "medium").otherwise("slow").alias("latency_class"), F.when(s % 2 == 0, s * 300).alias("measured_ms"), F.col("s_nationkey").alias("priority"),
    )
    return routing.ranked_teachers(tasks, providers, "task", 3).select("task", "place", "provider", fn.half_up(F.col("score")).alias("score"))


@query(
    f"""WITH {bind.FACTS}, u AS (SELECT * FROM f WHERE usable), n AS (SELECT entity, type, max(observed_at) AS t FROM u GROUP BY ALL),
c AS (SELECT u.entity, u.type, count(*) AS claims, count(DISTINCT value) AS k, arg_max(id, row(observed_at, id)) AS id, arg_max(value, row(observed_at, id)) AS value, string_agg(DISTINCT value, ',' ORDER BY value) AS vals
  FROM u JOIN n ON u.entity = n.entity AND u.type = n.type AND epoch_ms(n.t) - epoch_ms(observed_at) <= 1000 GROUP BY ALL)
SELECT e.entity, e.type, CASE WHEN k IS NULL THEN 'none' WHEN k = 1 THEN 'current' ELSE 'conflicted' END AS status, CASE WHEN k = 1 THEN c.id END AS id, CASE WHEN k = 1 THEN c.value END AS value, coalesce(claims, 0) AS claims, coalesce(vals, '') AS "values"
FROM (SELECT DISTINCT entity, type FROM f) e LEFT JOIN c ON e.entity = c.entity AND e.type = c.type"""
)
def w4_current_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current fact of every entity and type, unless facts of the same second disagree."""
    return states.current_facts(bind.facts(spark, sf_dir)).select("entity", "type", "status", "id", "value", "claims", F.array_join("values", ",").alias("values"))


CLAIMS_SQL = f"""c AS (SELECT l_orderkey AS answer, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, {pick_sql(["fact", "price", "opinion", "safety"], 'l_partkey')} AS type, CASE WHEN l_suppkey % 3 = 0 THEN 'partially_supported' ELSE 'claimed' END AS status, l_orderkey % 4 = 0 AS fresh_required,
  unnest(list_distinct([l_suppkey, l_partkey % 130, CASE WHEN l_linenumber = 2 THEN l_suppkey END])) AS ref FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)),
e AS (SELECT s_suppkey AS ref, s_suppkey % 5 > 0 AS usable, s_suppkey % 2 = 0 AS search, s_nationkey % 3 > 0 AS fresh, s_acctbal > 2000 AS qualified FROM supplier),
m AS (SELECT answer, id, type, status, fresh_required, count(*) FILTER (c.ref IS NOT NULL AND e.ref IS NULL) AS unknown, count(*) FILTER (NOT usable) AS inactive, count(*) FILTER (usable) AS good, count(*) FILTER (usable AND search AND fresh) AS fresh, count(*) FILTER (usable AND search AND fresh AND qualified) AS qual
  FROM c LEFT JOIN e ON c.ref = e.ref GROUP BY ALL),
j AS (SELECT *, type <> 'opinion' AS needs, fresh_required AND type IN ('fact', 'price') AS ff FROM m),
k AS (SELECT *, needs AND good = 0 AS uns, ff AND fresh = 0 AS stale, ff AND fresh > 0 AND qual = 0 AS weak FROM j)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n, part, supp = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    claims = bind.table(spark, sf_dir, "lineitem").select(k, n, part, supp).distinct().select(
        k.alias("answer"), F.concat_ws("-", k, n, part, supp).alias("id"), pick(["fact", "price", "opinion", "safety"], part).alias("type"), F.when(supp % 3 == 0, "partially_supported").otherwise("claimed").alias("status"),
        F.array_compact(F.array(supp, part % 130, F.when(n == 2, supp))).alias("refs"), (k % 4 == 0).alias("fresh_required"),
    )
    s = F.col("s_suppkey")
    known = bind.table(spark, sf_dir, "supplier").select(s.alias("ref"), (s % 5 > 0).alias("usable"), (s % 2 == 0).alias("search"), (F.col("s_nationkey") % 3 > 0).alias("fresh"), (F.col("s_acctbal") > 2000).alias("qualified"))
    return evidence.judged_claims(claims, known)


@query(
    f"""WITH {CLAIMS_SQL} SELECT id, CASE WHEN uns OR stale OR weak THEN 'unsupported' WHEN needs AND status <> 'partially_supported' THEN 'supported' ELSE status END AS status, good AS usable_refs,
  concat_ws(',', CASE WHEN inactive > 0 THEN 'inactive_evidence_ref' END, CASE WHEN unknown > 0 THEN 'unknown_evidence_ref' END, CASE WHEN uns THEN 'unsupported_' || type END, CASE WHEN stale THEN 'freshness_evidence_missing' END, CASE WHEN weak THEN 'source_quality_insufficient' END) AS issues FROM k"""
)
def g10_claim_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as claims of an answer, suppliers as its evidence: status and issues of each."""
    return _judged(spark, sf_dir).select("id", "status", "usable_refs", F.array_join("issues", ",").alias("issues"))


@query(
    f"""WITH {CLAIMS_SQL}, a AS (SELECT answer, count(*) AS claims, sum((inactive > 0)::INT + (unknown > 0)::INT + uns::INT + stale::INT + weak::INT)::BIGINT AS issues FROM k GROUP BY answer) SELECT answer, claims, issues, issues = 0 AS ok FROM a"""
)
def g10_sound_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.judged_answers(_judged(spark, sf_dir))


def _redacted_sql(text: str) -> str:
    for kind, pattern in (("EMAIL", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"), ("PHONE", r"\b(?:\+?52\s*)?(?:\d[\s.-]?){10}\b"), ("CARD", r"\b(?:\d[ -]*?){13,19}\b"), ("RFC", r"(?i)\b[A-ZÑ&]{3,4}\d{6}[A-Z0-9]{3}\b")):
        text = f"regexp_replace({text}, '{pattern}', '[REDACTED_{kind}]', 'g')"
    return text


@query(
    f"""WITH t AS (SELECT conv_id, turn, {_redacted_sql("coalesce(text, '') || CASE WHEN turn % 2 = 0 THEN ' write to user' || conv_id || '@example.com or +52 55 1234 56' || lpad(conv_id::VARCHAR, 2, '0') || ', card 4539 5787 6362 1486, ABCD010203XY1' ELSE '' END")} AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)
SELECT conv_id, count(*) AS turns, sha256(string_agg(text, chr(10) ORDER BY turn)) AS digest, count(*) FILTER (contains(text, '[REDACTED_EMAIL]')) AS hidden FROM t WHERE k <= 4 GROUP BY conv_id"""
)
def p8_package_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last turns of conversations, with personal data put into some, as they may be sent with a task."""
    c = F.col("conv_id").cast("string")
    said = F.concat(F.lit(" write to user"), c, F.lit("@example.com or +52 55 1234 56"), F.lpad(c, 2, "0"), F.lit(", card 4539 5787 6362 1486, ABCD010203XY1"))
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 2 == 0, said).otherwise(""))
    sent = privacy.package_turns(bind.table(spark, sf_dir, "conversations").withColumn("text", text), "conv_id", "turn")
    hidden = F.size(F.filter("turns", lambda t: F.contains(t["text"], F.lit("[REDACTED_EMAIL]"))))
    return sent.select("conv_id", F.size("turns").cast("bigint").alias("turns"), F.sha2(F.array_join("turns.text", "\n"), 256).alias("digest"), hidden.cast("bigint").alias("hidden"))
