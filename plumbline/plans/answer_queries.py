"""Queries of answers, claims, identities, retrieval, visual and spoken evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import answers
from plumbline.plans.policy_queries import flags_sql, pick, pick_sql
from plumbline.plans.registry import clamp, query, r
from plumbline.sources import bindings as bind

KINDS = ["fact", "inference", "price", "rumour", "safety"]
STANDS = ["supported", "unsupported", "odd", "conflicted"]


@query(
    f"""WITH x AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN '  ' ELSE ' ' || o_orderpriority || ' ' END AS text, {pick_sql(KINDS, 'o_orderkey')} AS type, {pick_sql(STANDS, 'o_custkey')} AS status, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey / 100 END AS c FROM orders)
SELECT id, trim(text) AS text, CASE WHEN type = 'rumour' THEN 'unknown' ELSE type END AS type, CASE WHEN status = 'odd' THEN 'unknown' ELSE status END AS status, {clamp('coalesce(c, 0.0)')} AS confidence FROM x WHERE trim(text) <> ''"""
)
def p21_normal_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = bind.table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))).alias("text"), pick(KINDS, k).alias("type"), pick(STANDS, c).alias("status"), F.when(k % 4 != 0, c / 100).alias("confidence")
    )
    return answers.normal_claims(rows).select("id", "text", "type", "status", "confidence")


@query(
    """WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE o_orderstatus END AS answer, o_custkey % 6 = 0 AS odd FROM orders),
i AS (SELECT DISTINCT l_orderkey AS id, CASE WHEN l_discount > 0.09 THEN 'unsupported_claim' ELSE 'source_conflict_resolved:' || l_returnflag END AS issue FROM lineitem WHERE l_discount > 0.09 OR l_tax > 0.07),
u AS (SELECT id, issue FROM i UNION SELECT id, 'answer_missing' FROM a WHERE answer = '' UNION SELECT id, 'unknown_evidence_ref' FROM a WHERE odd),
g AS (SELECT id, string_agg(issue, ',' ORDER BY issue) AS issues, count(*) FILTER (starts_with(issue, 'source_conflict_resolved:')) AS warnings, count(*) AS n FROM u GROUP BY 1)
SELECT a.id, coalesce(issues, '') AS issues, coalesce(n = warnings, true) AS ok, coalesce(warnings, 0) AS warnings FROM a LEFT JOIN g USING (id) WHERE a.id IN (SELECT o_orderkey FROM orders)"""
)
def g23_checked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = bind.table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 9 == 0, "").otherwise(F.col("o_orderstatus")).alias("answer"), (F.col("o_custkey") % 6 == 0).cast("int").alias("unknown_refs"))
    bad = F.col("l_discount") > 0.09
    found = bind.table(spark, sf_dir, "lineitem").filter(bad | (F.col("l_tax") > 0.07)).select(F.col("l_orderkey").alias("id"), F.when(bad, "unsupported_claim").otherwise(F.concat(F.lit("source_conflict_resolved:"), "l_returnflag")).alias("issue"))
    return answers.checked_answers(rows, found)


_IDENTITY = {"identity_name_missing": "name = ''", "identity_confidence_too_low": "c < 0.82", "identity_evidence_missing": "len(refs) = 0", "identity_unknown_evidence_ref": "len(list_filter(refs, lambda x: NOT list_contains([1, 2, 3], x))) > 0", "identity_unresolved": "open"}


@query(
    f"""WITH x AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_name END AS name, (70 + p_partkey % 30) / 100 AS c, CASE WHEN p_size % 5 = 0 THEN [] ELSE [p_size % 4 + 1, 1] END AS refs, p_partkey % 17 = 0 AS open FROM part),
y AS (SELECT id, c, {flags_sql(_IDENTITY)} AS issues FROM x) SELECT id, issues, CASE WHEN issues <> '' THEN NULL WHEN c >= 0.9 THEN 'confirmed' ELSE 'probable' END AS becomes FROM y"""
)
def f12_identity_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    refs = F.when(s % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array((s % 4 + 1).cast("bigint"), F.lit(1).cast("bigint")))
    rows = bind.table(spark, sf_dir, "part").select(
        k.alias("id"), F.when(k % 13 == 0, "").otherwise(F.col("p_name")).alias("name"), ((k % 30 + 70) / 100).alias("confidence"), refs.alias("refs"),
        F.array(*[F.lit(x).cast("bigint") for x in (1, 2, 3)]).alias("allowed"), F.when(k % 17 == 0, "unresolved").alias("status"),
    )
    return answers.identity_issues(rows).select("id", "issues", "becomes")


@query(
    f"""WITH c AS (SELECT l_orderkey AS k, l_partkey::VARCHAR AS name, max(l_discount * 10) AS confidence, min(CASE WHEN l_partkey % 3 = 0 THEN 'Acme' WHEN l_partkey % 3 = 1 THEN 'ACME' ELSE CASE WHEN l_suppkey % 2 = 0 THEN 'Bolt' END END) AS brand FROM lineitem GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER w AS place, lead(confidence) OVER w AS second FROM c WINDOW w AS (PARTITION BY k ORDER BY confidence DESC, name)), f AS (SELECT k, count(DISTINCT lower(brand)) > 1 AS conflict FROM c GROUP BY 1),
s AS (SELECT n.k, name, conflict, CASE WHEN coalesce(confidence - second < 0.12, false) THEN least(confidence, 0.69) ELSE confidence END AS s FROM n JOIN f USING (k) WHERE place = 1),
t AS (SELECT k, name, conflict, {r('CASE WHEN conflict THEN least(s, 0.64) ELSE s END')} AS confidence FROM s)
SELECT k AS id, name, confidence, conflict, confidence < 0.75 OR conflict AS ask FROM t"""
)
def g14_resolved_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_partkey")
    brand = F.when(p % 3 == 0, "Acme").when(p % 3 == 1, "ACME").when(F.col("l_suppkey") % 2 == 0, "Bolt")
    rows = bind.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), p.cast("string").alias("name")).agg(F.max(F.col("l_discount") * 10).alias("confidence"), F.min(brand).alias("brand"))
    return answers.resolved_identity(rows, "id")


@query(
    f"""WITH x AS (SELECT l_orderkey AS k, l_suppkey % 4 AS domain, 0.5::DOUBLE + (l_partkey % 32) / 64 AS quality, l_quantity / 50 AS authority, l_orderkey % 3 AS least, l_orderkey % 2 = 0 AS cross_check FROM lineitem),
g AS (SELECT k, count(*) AS n, count(DISTINCT domain) AS domains, count(*) FILTER (authority >= 0.8) AS authoritative, {r('avg(quality)')} AS quality, max(least) AS least, bool_or(cross_check) AS c FROM x GROUP BY 1),
v AS (SELECT *, CASE WHEN n < least THEN 'insufficient_results' WHEN c AND domains < 2 AND authoritative < 2 THEN 'insufficient_cross_check' WHEN quality < 0.62 THEN 'low_source_quality' END AS reason FROM g)
SELECT k AS id, n, domains, authoritative, quality, reason, reason IS NULL AS can_answer FROM v"""
)
def a17_retrieval_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    rows = bind.table(spark, sf_dir, "lineitem").select(
        k.alias("id"), (F.col("l_suppkey") % 4).alias("domain"), (0.5 + F.col("l_partkey") % 32 / 64).alias("quality"), (F.col("l_quantity") / 50).alias("authority"), (k % 3).alias("least"), (k % 2 == 0).alias("cross")
    )
    return answers.retrieval_verdict(rows, "id")


_LEVELS = [*answers.LEVELS, "odd"]


@query(
    f"""WITH x AS (SELECT l_orderkey AS k, 'label-' || l_partkey AS label, {pick_sql(_LEVELS, 'l_suppkey')} AS level, l_discount * 10 AS c FROM lineitem WHERE l_linenumber <> 3),
y AS (SELECT *, CASE level {" ".join(f"WHEN '{k}' THEN {v}" for k, v in answers.LEVELS.items())} ELSE 2 END AS rank FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rank DESC, c DESC, label DESC) AS n FROM y)
SELECT k AS id, label, rank, {r('c')} AS confidence, rank >= 4 AND c >= 0.7 AS brand_known FROM z WHERE n = 1"""
)
def g26_strongest_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder of visual evidence."""
    from plumbline.functions.scalars import half_up

    rows = bind.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_linenumber") != 3, F.concat(F.lit("label-"), "l_partkey")).alias("label"), pick(_LEVELS, F.col("l_suppkey")).alias("level"), (F.col("l_discount") * 10).alias("confidence"))
    return answers.strongest_claim(rows, "id").withColumn("confidence", half_up(F.col("confidence")))


_CATEGORIES = [*answers.FAILURES, "other"]


@query(
    f"""WITH x AS (SELECT user_id AS k, {pick_sql(_CATEGORIES, 'event_id')} AS category, 'c' || (event_id % 7) AS code, event_type = 'error' AS blocking FROM events),
y AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY NOT blocking, CASE category {" ".join(f"WHEN '{c}' THEN {n}" for n, c in enumerate(answers.FAILURES))} ELSE 99 END, code) AS n FROM x) SELECT k AS execution, category, code, blocking FROM y WHERE n = 1"""
)
def o4_primary_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = bind.table(spark, sf_dir, "events").select(F.col("user_id").alias("execution"), pick(_CATEGORIES, e).alias("category"), F.concat(F.lit("c"), e % 7).alias("code"), (F.col("event_type") == "error").alias("blocking"))
    return answers.primary_failure(rows, "execution")


SAID = ["how to fix it, it is blinking", "what is this", "translate the noise", "第一个坏了", "昨天漏水, 重启过", "quiet"]
HEARD = [["intent:solve_or_guide", "symptom:blinking_indicator"], ["intent:identify"], ["intent:translate", "symptom:abnormal_sound"], ["reference:ordinal_1", "symptom:not_working"], ["action:power_cycle", "symptom:leak", "temporal:yesterday_context"], []]


@query(
    f"""WITH h(k, s) AS (VALUES {", ".join(f"({k}, '{s}')" for k, names in enumerate(HEARD) for s in names)}) SELECT event_id, split_part(s, ':', 1) AS kind, split_part(s, ':', 2) AS signal FROM events JOIN h ON event_id % {len(SAID)} = k"""
)
def p25_speech_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.speech_signals(bind.table(spark, sf_dir, "events").select("event_id", pick(SAID, F.col("event_id")).alias("text")), ["event_id"])


POINTS = ["what about it", "the one before", "the other one, please", "hello"]


@query(
    f"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'o' || ((conv_id + turn // 3) % 3) END AS seen, turn % 4 AS k FROM conversations), f AS (SELECT *, last_value(seen IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS focus FROM t),
g AS (SELECT *, CASE WHEN seen <> focus THEN focus END AS gone FROM f), b AS (SELECT *, last_value(gone IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g)
SELECT conv_id, turn, CASE k WHEN 0 THEN 'same_object' WHEN 1 THEN 'previous_object' ELSE 'other_object' END AS kind, CASE k WHEN 0 THEN focus WHEN 1 THEN coalesce(before, focus) ELSE before END AS object FROM b WHERE seen IS NULL AND k <> 3"""
)
def x5_pointed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, c = F.col("turn"), F.col("conv_id")
    rows = bind.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(t % 3 == 0, F.concat(F.lit("o"), (c + F.floor(t / 3)) % 3)).alias("seen"), pick(POINTS, t).alias("text"))
    return answers.pointed_objects(rows, "conv_id", "turn")


@query(
    """WITH x AS (SELECT l_orderkey AS k, l_suppkey AS provider, max(l_discount) AS score FROM lineitem GROUP BY 1, 2), y AS (SELECT *, k % 5 = 0 AS explore, 2 + k % 2 AS turn, row_number() OVER (PARTITION BY k ORDER BY score DESC, provider) AS place FROM x)
SELECT k AS request, provider, place, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN explore AND place = turn THEN 0 ELSE 1 END, place) AS chain FROM y"""
)
def g28_failover_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("request")
    rows = bind.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("request"), F.col("l_suppkey").alias("provider")).agg(F.max("l_discount").alias("score"))
    return answers.failover_chain(rows.withColumns({"explore": k % 5 == 0, "turn": 2 + k % 2}), "request").select("request", "provider", "place", "chain")


@query("""WITH g AS (SELECT conv_id, list(turn ORDER BY turn) AS t FROM conversations GROUP BY 1) SELECT conv_id, array_to_string(t[1:12], ',') AS evidence, array_to_string(t[1:8], ',') AS facts, array_to_string(t[1:5], ',') AS media FROM g""")
def p8_sanitised_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = bind.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.col("turn"))).alias("t"))
    cut = answers.sanitised_package(turns.select("conv_id", *[F.transform("t", lambda x: x.cast("string")).alias(n) for n in ("evidence", "facts", "media")]), "conv_id", {"evidence": 12, "facts": 8, "media": 5})
    return cut.select("conv_id", *[F.array_join(n, ",").alias(n) for n in ("evidence", "facts", "media")])


@query("SELECT c_custkey AS id, 'name=' || c_name || ',segment=' || c_mktsegment AS kept FROM customer")
def p10_without_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint fields without media and secrets."""
    fields = F.create_map(F.lit("name"), F.col("c_name"), F.lit("apiKey"), F.lit("k"), F.lit("segment"), F.col("c_mktsegment"), F.lit("imageBase64"), F.lit("x"), F.lit("access_token"), F.lit("t"))
    kept = F.array_sort(F.transform(F.map_entries(answers.without_secrets(fields)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return bind.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array_join(kept, ",").alias("kept"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'E' || p_size ELSE 'E' || p_size || ',F12' END AS codes FROM part")
def t21_error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    text = F.concat(F.lit("panel shows ERR: e"), s, F.lit(" and error E"), s, F.when(s % 2 == 0, " end").otherwise(", then f12."))
    return bind.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(answers.error_codes(text), ",").alias("codes"))


_READY = {"CORPUS_MANIFEST_INVALID": "bad > 0", "CORPUS_IMAGES_MISSING": "missing > 0", "CORPUS_IMAGE_HASH_MISMATCH": "wrong > 0", "NO_REAL_OCR_STRATEGY_AVAILABLE": "lang = 'fr'"}


@query(
    f"""WITH g AS (SELECT lang, count(*) AS cases, count(*) FILTER (n_chars <> length(text)) AS bad, count(*) FILTER (doc_id % 50 = 7) AS missing, count(*) FILTER (doc_id % 90 = 8) AS wrong FROM documents GROUP BY lang)
SELECT lang, cases, {flags_sql(_READY)} AS reasons, {flags_sql(_READY)} = '' AS ready FROM g"""
)
def c6_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as corpora: is a benchmark over them ready?"""
    d = F.col("doc_id")
    rows = bind.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("cases"), F.count_if(F.col("n_chars") != F.length("text")).alias("bad"), F.count_if(d % 50 == 7).alias("missing"), F.count_if(d % 90 == 8).alias("wrong"))
    reasons = answers.preflight({"CORPUS_MANIFEST_INVALID": F.col("bad") > 0, "CORPUS_IMAGES_MISSING": F.col("missing") > 0, "CORPUS_IMAGE_HASH_MISMATCH": F.col("wrong") > 0, "NO_REAL_OCR_STRATEGY_AVAILABLE": F.col("lang") == "fr"})
    return rows.select("lang", "cases", reasons.alias("reasons"), (reasons == "").alias("ready"))
