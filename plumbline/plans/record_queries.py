"""Queries of record projections and ordered folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import scalars as fn
from plumbline.operators import benchmark, records
from plumbline.plans.policy_queries import case_sql, pick, pick_sql
from plumbline.plans.registry import clamp, query, r
from plumbline.sources import bindings as bind

KINDS = ["observation", "user_report", "tool_result", "gossip"]
SOURCES = ["photo", "user", "ocr", "teacher", "tool", "other"]
GIVEN = ["active", "superseded", "retracted", "odd"]


@query(
    f"""WITH x AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN {pick_sql(KINDS, 'o_orderkey // 3')} END AS given, o_custkey % 7 = 0 AS has_url, {pick_sql(SOURCES, 'o_custkey')} AS source, {pick_sql(GIVEN, 'o_orderkey')} AS state,
  CASE WHEN o_orderkey % 5 = 0 THEN o_custkey / 500 END AS sure FROM orders),
y AS (SELECT *, CASE WHEN given IS NOT NULL THEN CASE WHEN given = 'gossip' THEN 'inference' ELSE given END WHEN has_url THEN 'external_source' ELSE CASE source WHEN 'photo' THEN 'observation' WHEN 'user' THEN 'user_report' WHEN 'ocr' THEN 'ocr_extraction' WHEN 'teacher' THEN 'teacher_result' WHEN 'tool' THEN 'tool_result' ELSE 'inference' END END AS kind FROM x)
SELECT id, kind, CASE WHEN state = 'odd' THEN 'active' ELSE state END AS state, {clamp(f"coalesce(sure, {case_sql('kind', records.KIND_CONFIDENCE, 'NULL')})")} AS confidence FROM y"""
)
def p7_evidence_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = bind.table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 3 == 0, pick(KINDS, F.floor(k / 3))).alias("given_kind"), F.when(c % 7 == 0, "http://a").alias("url"), pick(SOURCES, c).alias("source"), pick(GIVEN, k).alias("given_state"), F.when(k % 5 == 0, c / 500).alias("given_confidence")
    )
    return records.evidence_semantics(rows).select("id", "kind", "state", "confidence")


@query(
    f"""WITH {bind.RECEIPTS}, x AS (SELECT receipt, unnest(['subtotal', 'tax', 'discount', 'total']) AS field, unnest([subtotal, CASE WHEN receipt % 3 <> 0 THEN tax END, CASE WHEN receipt % 4 <> 0 THEN discount END, total]) AS value FROM r)
SELECT receipt, field, value, CASE WHEN value IS NULL THEN 'unresolved' ELSE 'resolved' END AS status, CASE WHEN value IS NULL THEN 0.0 ELSE 0.92 END::DOUBLE AS confidence FROM x"""
)
def p4_field_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of receipts as evidence, unpivoted (P14)."""
    k = F.col("receipt")
    rows = bind.receipts(spark, sf_dir).withColumns({"tax": F.when(k % 3 != 0, F.col("tax")), "discount": F.when(k % 4 != 0, F.col("discount"))})
    long = rows.select("receipt", "subtotal", "tax", "discount", "total").unpivot(["receipt"], ["subtotal", "tax", "discount", "total"], "field", "value")
    return long.select("receipt", "field", records.field_evidence(F.col("value"), F.lit(0.92)).alias("e")).select("receipt", "field", "e.*")


@query(
    """SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'MX' END, CASE WHEN c_custkey % 2 = 0 THEN 'US' END) AS region, coalesce(CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END, 'es') AS language,
array_to_string(list_concat(CASE WHEN c_custkey % 7 = 0 THEN [] ELSE ['base'] END, CASE WHEN c_custkey % 4 = 0 THEN ['patch', 'more'] ELSE [] END), ',') AS evidence FROM customer"""
)
def p18_merged_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = bind.table(spark, sf_dir, "customer")
    base = c.select(k.alias("id"), F.when(k % 2 == 0, "US").alias("region"), F.lit("es").alias("language"), F.when(k % 7 != 0, F.array(F.lit("base"))).alias("evidence"))
    patch = c.select(k.alias("id"), F.when(k % 3 == 0, "MX").alias("region"), F.when(k % 5 == 0, F.col("c_mktsegment")).alias("language"), F.when(k % 4 == 0, F.array(F.lit("patch"), F.lit("more"))).alias("evidence"))
    return records.merged_context(base, patch, "id", ["region", "language"], ["evidence"]).withColumn("evidence", F.array_join("evidence", ","))


@query("""WITH g AS (SELECT conv_id, list(turn ORDER BY turn) AS turns FROM conversations GROUP BY 1) SELECT conv_id, array_to_string(turns[greatest(len(turns) - 2, 1):], ',') AS kept FROM g""")
def p20_compact_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three turns of every conversation, as its state keeps them."""
    late = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    last = bind.table(spark, sf_dir, "conversations").select("conv_id", "turn", late.alias("late")).filter("late <= 3")
    return last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda t: t.cast("string")), ",").alias("kept"))


PLACES = ["from Mexico", "made in Japan", "for the UK and Spain", "nowhere", "in España, no: France"]
NOTES = ["10 USD", "5 MXN", "3 EUR", "8", "¥ 90"]


@query(
    f"""WITH x AS (SELECT p_partkey AS id, {pick_sql(PLACES, 'p_partkey')} AS place, {pick_sql(NOTES, 'p_partkey // 5')} AS note, CASE WHEN p_size % 2 = 0 THEN 'JP' END AS object_region FROM part),
y AS (SELECT *, CASE place WHEN 'from Mexico' THEN 'MX' WHEN 'made in Japan' THEN 'JP' WHEN 'for the UK and Spain' THEN 'ES,GB' WHEN 'nowhere' THEN '' ELSE 'ES,FR' END AS regions FROM x)
SELECT id, regions, CASE note WHEN '10 USD' THEN 'USD' WHEN '5 MXN' THEN 'MXN' WHEN '3 EUR' THEN 'EUR' ELSE CASE WHEN note = '¥ 90' AND object_region = 'JP' THEN 'JPY' ELSE
  CASE coalesce(nullif(split_part(regions, ',', 1), ''), object_region, 'BR') WHEN 'MX' THEN 'MXN' WHEN 'JP' THEN 'JPY' WHEN 'BR' THEN 'BRL' END END END AS currency FROM y"""
)
def t11_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = bind.table(spark, sf_dir, "part").select(k.alias("id"), pick(PLACES, k).alias("place"), pick(NOTES, F.floor(k / 5)).alias("note"), F.when(F.col("p_size") % 2 == 0, "JP").alias("object_region"))
    rows = rows.withColumn("regions", records.explicit_regions(F.col("place")))
    return rows.select("id", F.array_join("regions", ",").alias("regions"), records.currency_of(F.col("note"), F.get("regions", F.lit(0)), F.col("object_region"), F.lit("pt-BR")).alias("currency"))


@query(
    f"""WITH x AS (SELECT p_partkey AS id, list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda t: t <> '') AS e, list_filter(string_split_regex(lower(p_type), '[^a-z0-9]+'), lambda t: t <> '') AS p FROM part)
SELECT id, CASE WHEN len(e) = 0 THEN 0.0::DOUBLE ELSE {r("len(list_filter(e, lambda a: len(list_filter(p, lambda b: contains(a, b) OR contains(b, a))) > 0)) / len(e)")} END AS score FROM x"""
)
def t3_label_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = lambda c: F.split(c, "[^A-Za-z0-9]+")
    return bind.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), records.label_score(split("p_name"), split("p_type")).alias("score"))


@query(
    f"""WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_suppkey % 2 = 0 THEN l_discount ELSE l_discount * 1000 END AS x, CASE WHEN l_suppkey % 2 = 0 THEN l_tax ELSE l_tax * 500 END AS y, CASE WHEN l_suppkey % 2 = 0 THEN 0.5 ELSE 10 + l_quantity END AS w, CASE WHEN l_suppkey % 2 = 0 THEN 0.25 ELSE 20 + l_quantity END AS h FROM lineitem),
n AS (SELECT id, CASE WHEN greatest(x, y, w, h) <= 1.5 THEN x ELSE x / 640 END AS x, CASE WHEN greatest(x, y, w, h) <= 1.5 THEN y ELSE y / 480 END AS y, CASE WHEN greatest(x, y, w, h) <= 1.5 THEN w ELSE w / 640 END AS w, CASE WHEN greatest(x, y, w, h) <= 1.5 THEN h ELSE h / 480 END AS h FROM x),
c AS (SELECT id, {clamp('x')} AS x, {clamp('y')} AS y, {clamp('w')} AS w, {clamp('h')} AS h FROM n)
SELECT id, {r('x')} AS x, {r('y')} AS y, {r('w')} AS w, {r('h')} AS h, {r('x + w / 2')} AS cx, {r('y + h / 2')} AS cy FROM c"""
)
def m14_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("l_suppkey") % 2 == 0
    q = F.col("l_quantity")
    box = records.normal_box(F.when(even, F.col("l_discount")).otherwise(F.col("l_discount") * 1000), F.when(even, F.col("l_tax")).otherwise(F.col("l_tax") * 500), F.when(even, 0.5).otherwise(10 + q), F.when(even, 0.25).otherwise(20 + q), F.lit(640), F.lit(480))
    return bind.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), box.alias("b")).select("id", "b.*")


OBJECTS = "r AS (SELECT l_orderkey AS g, l_orderkey * 100000 + l_partkey * 10 + l_linenumber AS id, l_partkey % 97 + CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE 4 * l_linenumber END AS cx, CASE WHEN l_orderkey % 3 = 0 THEN 40 * l_linenumber ELSE l_suppkey % 11 END AS cy, l_quantity AS w, l_quantity / 2 AS h FROM lineitem)"


@query(
    f"""WITH {OBJECTS}, p AS (SELECT g, max(cx) - min(cx) AS dx, max(cy) - min(cy) AS dy, avg(w) AS aw, avg(h) AS ah FROM r GROUP BY 1),
a AS (SELECT g, CASE WHEN dx >= 1.6::DOUBLE * dy AND dx >= aw THEN 'x' WHEN dy >= 1.6::DOUBLE * dx AND dy >= ah THEN 'y' END AS axis FROM p)
SELECT id, axis, CASE WHEN axis IS NOT NULL THEN row_number() OVER (PARTITION BY r.g ORDER BY CASE axis WHEN 'x' THEN cx WHEN 'y' THEN cy END, id) END AS ordinal FROM r JOIN a ON r.g = a.g"""
)
def w11_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    rows = bind.table(spark, sf_dir, "lineitem").select(
        k.alias("g"), (k * 100000 + F.col("l_partkey") * 10 + n).alias("id"), (F.col("l_partkey") % 97 + F.when(k % 3 == 0, 0).otherwise(4 * n)).alias("cx"), F.when(k % 3 == 0, 40 * n).otherwise(F.col("l_suppkey") % 11).alias("cy"),
        F.col("l_quantity").alias("w"), (F.col("l_quantity") / 2).alias("h"),
    )
    return records.ordinals(rows, "g").select("id", "axis", "ordinal")


@query(
    """WITH i AS (SELECT conv_id, turn, role <> 'user' AS skipped FROM conversations)
SELECT conv_id, turn, coalesce(min(CASE WHEN NOT skipped THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), min(CASE WHEN NOT skipped THEN turn END) OVER (PARTITION BY conv_id)) AS next FROM i"""
)
def w15_ring_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = bind.table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("role") != "user").alias("skipped"))
    return records.ring_next(items, "conv_id", "turn").select("conv_id", "turn", "next")


SAID = ["please look", "later", "resume now", "funciona", "again broken", "sigue igual", "close this", "continue", "nothing"]
_SIG = {"pause": "later", "close": "close this"}


@query(
    f"""WITH RECURSIVE t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, {pick_sql(SAID, 'event_id // 3')} AS s FROM events),
w(user_id, n, status, generation) AS (SELECT DISTINCT user_id, 0::BIGINT, 'investigating', 0 FROM t UNION ALL
  SELECT t.user_id, t.n, CASE WHEN s = 'later' THEN 'paused' WHEN s = 'close this' THEN 'closed' WHEN status IN ('paused', 'closed') AND s IN ('resume now', 'continue') THEN 'investigating' WHEN status = 'resolved' AND s = 'again broken' THEN 'investigating'
    WHEN s = 'funciona' THEN 'resolved' WHEN s = 'sigue igual' THEN 'investigating' ELSE status END, generation + (status = 'resolved' AND s = 'again broken')::INT FROM w JOIN t ON t.user_id = w.user_id AND t.n = w.n + 1)
SELECT user_id, arg_max(status, n) AS status, max(generation) AS generation FROM w GROUP BY 1"""
)
def x6_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five states of a problem from what its user says."""
    rows = bind.table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), pick(SAID, F.floor(F.col("event_id") / 3)).alias("text"))
    return records.lifecycle(rows, "user_id", "at", F.to_date("at.ts"))


TURNS = ["show the red pump", "no red, but blue", "and then the price", "not Pump but filter", "a new question"]


@query(
    f"""WITH t AS (SELECT conv_id, turn, (turn // 1) % 5 AS k, {pick_sql(TURNS, 'turn')} AS text, role FROM conversations), u AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM t WHERE role = 'user'),
v AS (SELECT *, CASE k WHEN 1 THEN 'red' WHEN 3 THEN 'pump' END AS wrong, CASE k WHEN 1 THEN 'blue' WHEN 3 THEN 'filter' END AS right_one FROM u)
SELECT conv_id, turn, CASE WHEN wrong IS NOT NULL AND contains(lower(before), wrong) THEN 'correction' WHEN k = 2 THEN 'continuation' ELSE 'new_turn' END AS kind,
  CASE WHEN wrong IS NOT NULL AND contains(lower(before), wrong) THEN regexp_replace(before, '(?i)^(.*)' || wrong, '\\1' || right_one) ELSE text END AS resolved FROM v"""
)
def x7_corrected_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that correct the one before it, continue it, or are new."""
    rows = bind.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", pick(TURNS, F.col("turn")).alias("text"))
    return records.corrected_turns(rows, "conv_id", "turn")


@query(
    """WITH e AS (SELECT user_id AS u, CASE event_type WHEN 'view' THEN 'partial' WHEN 'purchase' THEN 'final' ELSE 'start' END AS type, epoch_us(ts) AS t FROM events)
SELECT u AS utterance, floor((min(t) FILTER (type = 'partial') - min(t)) / 1000)::BIGINT AS partial_ms, floor((min(t) FILTER (type = 'final') - min(t)) / 1000)::BIGINT AS final_ms FROM e GROUP BY u"""
)
def x10_speech_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "partial").when(F.col("event_type") == "purchase", "final").otherwise("start")
    return records.speech_latency(bind.table(spark, sf_dir, "events").select(F.col("user_id").alias("utterance"), kind.alias("type"), F.col("ts").alias("at")), "utterance")


@query(
    f"""WITH RECURSIVE {bind.BENCH}, m AS (SELECT device AS cohort, engine, count(*) AS cases, avg(quality) AS quality, avg(ok::INT) AS success, avg(latency_ms) AS p50, row_number() OVER (PARTITION BY device ORDER BY engine) AS n FROM b GROUP BY 1, 2),
w AS (SELECT cohort, n, engine, quality, success, p50 FROM m WHERE n = 1 UNION ALL
  SELECT m.cohort, m.n, CASE WHEN g THEN m.engine ELSE w.engine END, CASE WHEN g THEN m.quality ELSE w.quality END, CASE WHEN g THEN m.success ELSE w.success END, CASE WHEN g THEN m.p50 ELSE w.p50 END
  FROM w JOIN m ON m.cohort = w.cohort AND m.n = w.n + 1, LATERAL (SELECT CASE WHEN abs(m.quality - w.quality) > 0.02 THEN m.quality > w.quality WHEN abs(m.success - w.success) > 0.01 THEN m.success > w.success ELSE m.p50 < w.p50 END AS g))
SELECT cohort, arg_max(engine, n) AS winner FROM w GROUP BY 1"""
)
def o3_cohort_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bind.bench_rows(spark, sf_dir).groupBy(F.col("device").alias("cohort"), "engine").agg(
        F.count("*").alias("cases"), F.avg("quality").alias("quality"), F.avg(F.col("ok").cast("int")).alias("success"), F.avg("latency_ms").alias("p50")
    )
    return records.cohort_winner(rows, "cohort", "engine")


@query(
    f"""WITH p AS (SELECT o_orderkey AS photo, o_custkey AS s, CASE WHEN o_orderkey % 5 = 0 THEN 'S' || o_custkey WHEN o_orderkey % 35 = 1 THEN 'S0' END AS serial, CASE WHEN o_orderkey % 3 = 0 THEN 'm-' || o_custkey WHEN o_orderkey % 33 = 1 THEN 'other' END AS model, CASE WHEN o_orderkey % 2 = 0 THEN 'Acme' END AS brand, 'pump' AS label,
  (o_orderkey % 10) / 10 AS sure, o_orderkey % 7 = 0 AS cont FROM orders),
e AS (SELECT c_custkey AS s, c_custkey * 2 AS entity, 'S' || c_custkey AS serial, 'M' || c_custkey AS model, 'ACME' AS brand, 'Pump' AS label FROM customer WHERE c_acctbal > 1000 UNION ALL SELECT c_custkey, c_custkey * 2 + 1, NULL, NULL, 'Bolt', 'pump' FROM customer WHERE c_acctbal > 4000),
j AS (SELECT p.photo, e.entity, (p.serial IS NOT NULL AND e.serial IS NOT NULL AND lower(p.serial) <> lower(e.serial)) AS ds, (p.model IS NOT NULL AND e.model IS NOT NULL AND replace(lower(p.model), '-', '') <> lower(e.model)) AS dm,
  coalesce(lower(p.serial) = lower(e.serial), false) AS ss, coalesce(replace(lower(p.model), '-', '') = lower(e.model), false) AS sm, coalesce(lower(p.brand) = lower(e.brand), false) AS sb, coalesce(lower(p.brand) <> lower(e.brand), false) AS db, sure, cont FROM p LEFT JOIN e ON p.s = e.s),
k AS (SELECT *, CASE WHEN ds THEN 0.0::DOUBLE ELSE 0.18::DOUBLE + ss::INT * 0.75::DOUBLE END + sm::INT * 0.48::DOUBLE AS a FROM j),
l AS (SELECT *, {clamp('CASE WHEN dm THEN least(a, 0.05::DOUBLE) ELSE a END + CASE WHEN sb THEN 0.18::DOUBLE WHEN db THEN -0.2::DOUBLE ELSE 0.0::DOUBLE END + least(0.28::DOUBLE, sure * 0.25::DOUBLE) + cont::INT * 0.22::DOUBLE')} AS score FROM k),
m AS (SELECT photo, entity, CASE WHEN entity IS NOT NULL THEN score END AS score, ds OR dm AS conflict FROM l),
n AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS rival FROM m WINDOW w AS (PARTITION BY photo ORDER BY score DESC NULLS LAST, entity)),
o AS (SELECT *, CASE WHEN entity IS NULL THEN 'new_object' WHEN conflict THEN 'likely_new_object' WHEN score >= 0.82 AND (score - coalesce(rival, 0) >= 0.15 OR rival IS NULL) THEN 'same_object' WHEN score >= 0.58 THEN 'probably_same_object' WHEN score <= 0.22 THEN 'likely_new_object' ELSE 'unresolved' END AS status FROM n WHERE place = 1)
SELECT photo, status, CASE WHEN status IN ('same_object', 'probably_same_object') THEN entity END AS entity, {r('score')} AS score FROM o"""
)
def j11_photo_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as photos of a session (their customer), one or two known objects a session."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    photos = bind.table(spark, sf_dir, "orders").select(
        k.alias("photo"), c.alias("s"), F.when(k % 5 == 0, F.concat(F.lit("S"), c)).when(k % 35 == 1, "S0").alias("serial"), F.when(k % 3 == 0, F.concat(F.lit("m-"), c)).when(k % 33 == 1, "other").alias("model"), F.when(k % 2 == 0, "Acme").alias("brand"),
        F.lit("pump").alias("label"), (k % 10 / 10).alias("label_confidence"), (k % 7 == 0).alias("continues"),
    )
    n, cust = F.col("c_custkey"), bind.table(spark, sf_dir, "customer")
    one = cust.filter("c_acctbal > 1000").select(n.alias("s"), (n * 2).alias("id"), F.concat(F.lit("S"), n).alias("serial"), F.concat(F.lit("M"), n).alias("model"), F.lit("ACME").alias("brand"), F.lit("Pump").alias("label"))
    two = cust.filter("c_acctbal > 4000").select(n.alias("s"), (n * 2 + 1).alias("id"), F.lit(None).cast("string").alias("serial"), F.lit(None).cast("string").alias("model"), F.lit("Bolt").alias("brand"), F.lit("pump").alias("label"))
    return records.photo_entities(photos, one.union(two), "s")


@query(
    f"""WITH {bind.BENCH} SELECT engine AS provider, scenario AS capability, device, count(*) AS runs, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures, {r('avg(first_useful_ms)')} AS avg_load_ms, {r('avg(latency_ms)')} AS avg_inference_ms, {r('max(latency_ms)')} AS max_inference_ms,
  {r('count(*) FILTER (ok) / count(*)', 3)} AS success_rate FROM b GROUP BY 1, 2, 3"""
)
def s5_visual_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts, means and maxima per provider, capability and device (also S7)."""
    ok = F.col("ok")
    return bind.bench_rows(spark, sf_dir).groupBy(F.col("engine").alias("provider"), F.col("scenario").alias("capability"), "device").agg(
        F.count("*").alias("runs"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"), fn.half_up(F.avg("first_useful_ms")).alias("avg_load_ms"), fn.half_up(F.avg("latency_ms")).alias("avg_inference_ms"),
        fn.half_up(F.max("latency_ms")).alias("max_inference_ms"), fn.half_up(F.count_if(ok) / F.count("*"), 3).alias("success_rate"),
    )


NOTED = ["low-light crowd", "motion blur", "tiny label", "plain", "far distance, occluded", "night"]
NOTED_TAGS = [["low_light", "multi_object"], ["blur"], ["small_target", "text_interference"], ["ordinary"], ["far_distance", "occlusion"], ["low_light"]]
TAGGED = f"""WITH {bind.BENCH}, m(k, tag) AS (VALUES {", ".join(f"({k}, '{t}')" for k, tags in enumerate(NOTED_TAGS) for t in tags)}), t AS (SELECT engine, tag, count(*) AS cases, count(*) FILTER (NOT ok OR coalesce(quality, 0) < 0.75) AS failures,
  {r('avg((NOT ok OR coalesce(quality, 0) < 0.75)::INT)')} AS failure_rate FROM b JOIN m ON seq % {len(NOTED)} = k GROUP BY 1, 2)"""


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bind.bench_rows(spark, sf_dir).withColumn("tag", F.explode(benchmark.case_tags(pick(NOTED, F.col("seq")), "vision")))
    return benchmark.failure_patterns(rows, "tag")


@query(f"{TAGGED} SELECT * FROM t WHERE failures > 0")
def a8_tagged_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures by engine and by what the words of a case say about it."""
    return _tagged(spark, sf_dir).select("engine", "tag", "cases", "failures", "failure_rate")


@query(f"{TAGGED} SELECT tag, sum(cases)::BIGINT AS cases, sum(failures)::BIGINT AS failures, {r('sum(failures) / sum(cases)')} AS failure_rate FROM t WHERE failures > 0 GROUP BY tag")
def a8_tag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.tag_summary(_tagged(spark, sf_dir))
