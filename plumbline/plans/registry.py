"""Names of the library's queries, their callables and their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scalars as fn
from plumbline.operators import benchmark, corpus, decisions, evidence, graph, ocr, receipts, states, text, timeline
from plumbline.sources import bindings as bind

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query under its own name, with DuckDB SQL if there is some."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def r(x: str, digits: int = 4) -> str:
    return f"(floor(({x}) * {10.0**digits}::DOUBLE + 0.5) / {10.0**digits}::DOUBLE)"


def lo(x: str, p: float, where: str = "TRUE") -> str:
    """The sorted non-null value at index floor((n - 1) p)."""
    kept = f"list_sort(list({x}) FILTER ({where} AND {x} IS NOT NULL))"
    return f"{kept}[floor((len({kept}) - 1) * {p}::DOUBLE)::INT + 1]"


def clamp(x: str, low: str = "0.0", high: str = "1.0") -> str:
    return f"least({high}::DOUBLE, greatest({low}::DOUBLE, {x}))"


def falling(x: str, full: int, zero: int) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} <= {full} THEN 1.0 WHEN {x} >= {zero} THEN 0.0 ELSE ({zero} - {x}) / ({zero - full})::DOUBLE END"


# --- benchmark rows ---------------------------------------------------------------------------------


def _summary_sql(keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS cases, {r("avg(ok::INT)")} AS success_rate, {r("avg(quality) FILTER (ok)")} AS avg_quality,
    {r("avg((latency_ms > 5500)::INT)")} AS budget_exceeded_rate, {lo("latency_ms", 0.5, "ok")} AS p50_latency_ms, {lo("latency_ms", 0.95, "ok")} AS p95_latency_ms,
    {lo("first_useful_ms", 0.5, "ok")} AS p50_first_useful_ms, {lo("memory_mb", 0.95)} AS p95_memory_mb FROM b GROUP BY {keys}"""


@query(f"WITH {bind.BENCH} {_summary_sql('session, engine')}")
def a1_session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.session_summary(bind.bench_rows(spark, sf_dir), ["session", "engine"])


@query(f"WITH {bind.BENCH} {_summary_sql('engine, scenario')}")
def a2_arena_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.session_summary(bind.bench_rows(spark, sf_dir), ["engine", "scenario"])


@query(f"WITH {bind.BENCH} {_summary_sql('device')}")
def a3_lab_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.session_summary(bind.bench_rows(spark, sf_dir), ["device"])


REPORT = f"""s AS ({_summary_sql("session, engine")}),
t AS (SELECT engine, count(*) AS sessions, sum(cases)::BIGINT AS cases,
  {r("sum(success_rate * cases) / sum(cases) FILTER (success_rate IS NOT NULL)")} AS success_rate,
  {r("sum(avg_quality * cases) / sum(cases) FILTER (avg_quality IS NOT NULL)")} AS avg_quality,
  {r("median(p50_latency_ms)")} AS p50_ms, {r("median(p95_latency_ms)")} AS p95_ms FROM s GROUP BY engine)"""
GATE = """g AS (SELECT *, coalesce(success_rate >= 0.97, false) AS success_ok, coalesce(avg_quality >= 0.85, false) AS quality_ok,
  coalesce(p50_ms <= 1500, true) AS p50_ok, coalesce(p95_ms <= 4000, true) AS p95_ok,
  coalesce(success_rate >= 0.97, false) AND coalesce(avg_quality >= 0.85, false) AND coalesce(p50_ms <= 1500, true) AND coalesce(p95_ms <= 4000, true) AS released FROM t)"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.report(benchmark.session_summary(bind.bench_rows(spark, sf_dir), ["session", "engine"]), ["engine"])


@query(f"WITH {bind.BENCH}, {REPORT} SELECT * FROM t")
def a4_benchmark_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)


@query(f"WITH {bind.BENCH}, {REPORT}, {GATE} SELECT * FROM g")
def g1_release_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.release_gate(_report(spark, sf_dir))


COMPETITION = f"""base AS (SELECT engine AS baseline, avg_quality AS bq, success_rate AS bs, p50_ms AS bp FROM t ORDER BY avg_quality DESC, engine LIMIT 1),
c AS (SELECT g.*, baseline, {r("avg_quality - bq")} AS quality_delta, {r("success_rate - bs")} AS success_delta, {r("p50_ms / bp")} AS p50_ratio FROM g, base),
v AS (SELECT *, quality_delta < -0.03 OR success_delta < -0.02 OR p50_ratio > 1.35 AS bad,
  (quality_delta >= 0.03 AND p50_ratio <= 1.2) OR (p50_ratio <= 0.75 AND quality_delta >= -0.01) AS good FROM c),
e AS (SELECT * EXCLUDE (bad, good), CASE WHEN bad THEN 'REGRESSION' WHEN good THEN 'IMPROVEMENT' ELSE 'MIXED_OR_TIE' END AS verdict,
  cases >= 12 AND released AND NOT bad AS promoted,
  {r(f"0.5 * avg_quality + 0.2 * success_rate + 0.2 * ({falling('p50_ms', 700, 2500)}) + 0.1 * ({falling('p95_ms', 1400, 5000)})")} AS composite,
  row_number() OVER (ORDER BY avg_quality DESC, engine) AS rank FROM v)"""


@query(f"WITH {bind.BENCH}, {REPORT}, {GATE}, {COMPETITION} SELECT * FROM e")
def g2_competition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.competition(_report(spark, sf_dir))


flagship = g2_competition


#: The same rows of a quicker and better device, so that some engines are promoted.
GOOD_BENCH = bind.BENCH.replace("value * 20 AS latency_ms", "value * 4 AS latency_ms").replace("NOT (event_type = 'error' AND (props->>'$.k')::INT < 5 + 20 * (user_id % 5)) AS ok", "NOT (event_type = 'error' AND (props->>'$.k')::INT < 2 * (user_id % 5)) AS ok").replace("0.72::DOUBLE + 0.30::DOUBLE", "0.80::DOUBLE + 0.30::DOUBLE")
CANARY = f"""k AS (SELECT engine, {r(f"0.5 * avg_quality + 0.25 * success_rate + 0.15 * {clamp('1 - coalesce(p50_ms, 9999) / 1500')} + 0.10 * {clamp('1 - coalesce(p95_ms, 9999) / 4000')}")} AS score FROM e WHERE promoted),
o AS (SELECT *, {r("score - lead(score) OVER (ORDER BY score DESC, engine)")} AS gap, row_number() OVER (ORDER BY score DESC, engine) AS place FROM k),
n AS (SELECT engine, score, place, place = 1 AND coalesce(gap >= 0.04, true) AS chosen FROM o)"""


def _good_competition(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, k = F.pmod("user_id", F.lit(5)), F.get_json_object("props", "$.k").cast("int")
    rows = bind.bench_rows(spark, sf_dir)
    quick = bind.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), (~((F.col("event_type") == "error") & (k < 2 * u))).alias("ok"), (F.col("value") * 4).alias("latency_ms"), (0.80 + 0.30 * k / 99 - 0.03 * u).alias("quality"),
    )
    rows = rows.drop("ok", "latency_ms", "quality").join(quick, "seq")
    return benchmark.competition(benchmark.report(benchmark.session_summary(rows, ["session", "engine"]), ["engine"]))


@query(f"WITH {GOOD_BENCH}, {REPORT}, {GATE}, {COMPETITION}, {CANARY} SELECT * FROM n")
def g4_canary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only promoted engines are ranked; without one there is no row."""
    return benchmark.canary(_good_competition(spark, sf_dir))


@query(
    f"""WITH {GOOD_BENCH}, {REPORT}, {GATE}, {COMPETITION}, {CANARY}, latest AS (SELECT engine, max(recorded_at) AS newest FROM b GROUP BY 1), x AS (SELECT e.engine, verdict, promoted, cases, newest, (SELECT max(recorded_at) FROM b) AS now FROM e JOIN latest USING (engine)),
y AS (SELECT x.engine, CASE WHEN verdict = 'REGRESSION' THEN 'LAB_REGRESSION' WHEN coalesce(chosen, false) THEN 'PROMOTED_CANARY' WHEN promoted THEN 'PROMOTED_ELIGIBLE' ELSE 'NO_RUNTIME_PROMOTION' END AS reason FROM x LEFT JOIN n ON n.engine = x.engine
  WHERE cases >= 12 AND epoch(now) - epoch(newest) <= 30 * 86400)
SELECT engine, reason, CASE reason WHEN 'LAB_REGRESSION' THEN -0.22 WHEN 'PROMOTED_CANARY' THEN 0.16 WHEN 'PROMOTED_ELIGIBLE' THEN 0.06 ELSE 0.0 END::DOUBLE AS adjustment FROM y"""
)
def g5_runtime_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regressions are avoided, the canary is preferred, promoted engines get a little; old or few rows say nothing."""
    newest = bind.bench_rows(spark, sf_dir).groupBy("engine").agg(F.max("recorded_at").alias("newest"))
    return benchmark.runtime_policy(_good_competition(spark, sf_dir).join(newest, "engine"))


PATTERNS = f"""f AS (SELECT engine, coalesce(scenario, 'ordinary') AS tag, count(*) AS cases, sum((NOT ok OR coalesce(quality, 0) < 0.75)::INT)::BIGINT AS failures,
  {r("avg(coalesce(quality, 0))")} AS avg_quality, {r("avg((NOT ok OR coalesce(quality, 0) < 0.75)::INT)")} AS failure_rate FROM b GROUP BY 1, 2 HAVING sum((NOT ok OR coalesce(quality, 0) < 0.75)::INT) > 0)"""


@query(f"WITH {bind.BENCH}, {PATTERNS} SELECT * FROM f")
def a8_failure_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.failure_patterns(bind.bench_rows(spark, sf_dir))


@query(
    f"""WITH {bind.BENCH}, {PATTERNS} SELECT *, CASE WHEN failure_rate >= 0.5 THEN 'high' ELSE 'medium' END AS severity FROM f
WHERE cases >= 2 AND failure_rate >= 0.25 ORDER BY failure_rate DESC, avg_quality, engine, tag LIMIT 12"""
)
def a9_remediation_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.remediation_hints(a8_failure_patterns(spark, sf_dir))


@query(
    f"""WITH {bind.BENCH}, {PATTERNS}, e AS (SELECT * FROM f WHERE cases >= 12),
k AS (SELECT *, count(*) OVER (PARTITION BY tag) AS n, row_number() OVER w AS place, lead(avg_quality) OVER w AS q2, lead(failure_rate) OVER w AS f2
  FROM e WINDOW w AS (PARTITION BY tag ORDER BY avg_quality DESC, failure_rate, engine))
SELECT engine, {r(clamp("sum(CASE WHEN place = 1 AND (" + r("avg_quality - q2") + " >= 0.08 OR " + r("f2 - failure_rate") + " >= 0.12) THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN failure_rate >= 0.5 THEN -0.08::DOUBLE ELSE 0.0::DOUBLE END)", "-0.12", "0.12"))} AS adjustment,
  count(*) AS scenarios FROM k WHERE n >= 2 GROUP BY engine"""
)
def g6_scenario_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.scenario_evidence(a8_failure_patterns(spark, sf_dir))


COUNTERS = """c AS (SELECT engine, device, count(*) AS attempts, sum((NOT ok)::INT)::BIGINT AS failures, count(*) FILTER (scenario IN ('view', 'purchase')) AS signals,
  count(*) FILTER (scenario = 'view' AND quality < 0.8) AS corrections, count(*) FILTER (scenario = 'purchase') AS confirmed FROM b GROUP BY 1, 2)"""


@query(f"WITH {bind.BENCH}, {COUNTERS} SELECT * FROM c")
def s4_outcome_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("scenario")
    return bind.bench_rows(spark, sf_dir).groupBy("engine", "device").agg(
        F.count("*").alias("attempts"), F.count_if(~F.col("ok")).alias("failures"), F.count_if(s.isin("view", "purchase")).alias("signals"),
        F.count_if((s == "view") & (F.col("quality") < 0.8)).alias("corrections"), F.count_if(s == "purchase").alias("confirmed"),
    )


@query(
    f"""WITH {bind.BENCH}, {COUNTERS} SELECT *, {r(clamp('''CASE WHEN attempts < 8 THEN 0.0::DOUBLE WHEN failures / attempts >= 0.35 THEN -0.10::DOUBLE WHEN failures / attempts >= 0.2 THEN -0.05::DOUBLE ELSE 0.0::DOUBLE END
 + CASE WHEN signals < 5 THEN 0.0::DOUBLE WHEN corrections / signals >= 0.4 THEN -0.12::DOUBLE WHEN corrections / signals >= 0.25 THEN -0.06::DOUBLE WHEN corrections / signals <= 0.1 AND confirmed >= 5 THEN 0.04::DOUBLE ELSE 0.0::DOUBLE END''', "-0.16", "0.06"))} AS adjustment FROM c"""
)
def a10_outcome_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.outcome_adjustment(s4_outcome_counters(spark, sf_dir))


@query(
    f"""WITH {bind.BENCH}, i AS (SELECT *, sum(ok::INT) OVER (PARTITION BY engine ORDER BY seq) AS island FROM b),
j AS (SELECT engine, island, sum((NOT ok)::INT)::BIGINT AS fails, sum(ok::INT)::BIGINT AS oks FROM i GROUP BY 1, 2)
SELECT engine, sum(fails + oks)::BIGINT AS runs, sum(oks)::BIGINT AS successes, {r("(sum(oks) + 3) / (sum(fails + oks) + 4)", 3)} AS smoothed_rate,
  max(fails) AS longest_failures, arg_max(fails, island) AS consecutive_failures FROM j GROUP BY engine"""
)
def s6_failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.failure_runs(bind.bench_rows(spark, sf_dir))


@query(
    f"""WITH {bind.BENCH}, g AS (SELECT engine, seq, epoch_us(recorded_at) - lag(epoch_us(recorded_at)) OVER (PARTITION BY engine ORDER BY recorded_at, seq) AS gap FROM b)
SELECT engine, CASE WHEN gap IS NULL THEN 'cold' WHEN gap <= 300000000 THEN 'hot' ELSE 'warm' END AS start, count(*) AS n FROM g GROUP BY 1, 2"""
)
def w6_start_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.start_kinds(bind.bench_rows(spark, sf_dir)).groupBy("engine", "start").agg(F.count("*").alias("n"))


@query(f"WITH {bind.BENCH} SELECT engine, seq, row_number() OVER (PARTITION BY engine ORDER BY recorded_at DESC, seq DESC) AS place FROM b QUALIFY place <= 12")
def w1_last_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.last_n(bind.bench_rows(spark, sf_dir), "engine", ["recorded_at", "seq"], 12).select("engine", "seq", "place")


@query(
    f"""WITH {bind.BENCH} SELECT device, engine, scenario, seq, {r("quality")} AS quality, recorded_at FROM b
QUALIFY row_number() OVER (PARTITION BY device, engine, scenario ORDER BY recorded_at DESC, seq DESC) = 1"""
)
def s3_latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark.latest_snapshot(bind.bench_rows(spark, sf_dir), ["device", "engine", "scenario"], ["recorded_at", "seq"], ["seq", "quality", "recorded_at"])
    return found.withColumn("quality", fn.half_up(F.col("quality")))


@query(
    f"""WITH {bind.BENCH} SELECT scenario, {", ".join(r(f"avg(quality) FILTER (engine = 'e{i}' AND ok)") + f" AS e{i}" for i in range(5))} FROM b GROUP BY scenario"""
)
def a26_scenario_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    engines = [f"e{i}" for i in range(5)]
    cells = bind.bench_rows(spark, sf_dir).filter("ok").groupBy("scenario").pivot("engine", engines).agg(F.avg("quality"))
    return cells.select("scenario", *[fn.half_up(F.col(e)).alias(e) for e in engines])


# --- strategy benchmarks ----------------------------------------------------------------------------


def _ocr_sql(keys: str) -> str:
    whole = lambda x: f"floor({x} + 0.5)::BIGINT"
    return f"""SELECT {keys}, count(*) AS cases, {r("avg(failed::INT)")} AS failure_rate, {whole("avg(elapsed_ms)")} AS avg_ms, {whole("quantile_disc(elapsed_ms, 0.5)")} AS p50_ms,
  {whole("quantile_disc(elapsed_ms, 0.95)")} AS p95_ms, {whole("avg(elapsed_ms) FILTER (cold)")} AS cold_ms, {whole("avg(elapsed_ms) FILTER (NOT cold)")} AS warm_ms,
  {r(f'{whole("avg(elapsed_ms) FILTER (cold)")} / nullif({whole("avg(elapsed_ms) FILTER (NOT cold)")}, 0)', 3)} AS warm_speedup,
  {", ".join(f"{r(f'avg({c}::INT)')} AS {name}" for name, c in ocr.RATES.items())} FROM o GROUP BY {keys}"""


@query(f"WITH {bind.OCR} {_ocr_sql('strategy')}")
def a5_ocr_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.aggregate(bind.ocr_rows(spark, sf_dir), ["strategy"])


@query(
    f"""WITH {bind.OCR}, c AS ({_ocr_sql("difficulty, kind, strategy")}) SELECT difficulty, kind, strategy, cases, failure_rate, avg_ms FROM c WHERE cases >= 5
QUALIFY row_number() OVER (PARTITION BY difficulty, kind ORDER BY failure_rate, avg_ms, strategy) = 1"""
)
def a6_ocr_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.leaders(bind.ocr_rows(spark, sf_dir))


@query(
    f"""WITH {bind.OCR}, c AS ({_ocr_sql("strategy")}) SELECT strategy, {r('''0.38::DOUBLE * field_accuracy + 0.28::DOUBLE * critical_accuracy + 0.16::DOUBLE * total_accuracy + 0.12::DOUBLE * date_accuracy
 + 0.03::DOUBLE * (1 - least(1.0::DOUBLE, avg_ms / 10000)) + 0.03::DOUBLE * (1 - least(1.0::DOUBLE, p95_ms / 10000))''')} AS score FROM c"""
)
def m6_promotion_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.promotion_score(a5_ocr_aggregate(spark, sf_dir)).select("strategy", "score")


@query(
    f"""WITH {bind.OCR}, c AS (SELECT strategy, kind, count(*) AS n FROM o WHERE failed GROUP BY 1, 2)
SELECT strategy, string_agg(kind || ':' || n, ',' ORDER BY n DESC, kind) AS histogram FROM c GROUP BY strategy"""
)
def o5_failure_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.failure_histogram(bind.ocr_rows(spark, sf_dir))


# --- receipts and offers ----------------------------------------------------------------------------


@query(
    f"""WITH {bind.RECEIPTS} SELECT receipt, subtotal, tax, discount, total, subtotal + tax - discount - total AS difference, abs(subtotal + tax - discount - total) <= 2 AS balanced,
CASE WHEN abs(subtotal + tax - discount - total) <= 2 THEN 0.97 ELSE 0.74 END AS confidence FROM r"""
)
def r4_receipt_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receipts.checks(bind.receipts(spark, sf_dir))


@query(
    f"""WITH {bind.RECEIPTS}, u AS (UNPIVOT r ON subtotal, tax, discount, total INTO NAME field VALUE value)
SELECT field, CASE WHEN value IS NULL THEN 'unresolved' WHEN value = 0 THEN 'empty' ELSE 'resolved' END AS status, count(*) AS n, sum(value)::BIGINT AS value FROM u GROUP BY 1, 2"""
)
def p3_receipt_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receipts.facts(bind.receipts(spark, sf_dir)).groupBy("field", "status").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


@query(
    f"""WITH {bind.OFFERS} SELECT offer, product, cost, row_number() OVER (PARTITION BY product ORDER BY cost, observed_at DESC, offer) AS place FROM f WHERE available AND cost IS NOT NULL"""
)
def o6_ranked_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receipts.ranked_offers(bind.offers(spark, sf_dir)).select("offer", "product", "cost", "place")


@query(
    f"""WITH {bind.OFFERS} SELECT offer, product, {r("((brand = 'Brand#7')::INT + 3 * (kind = 'LARGE')::INT + 2 * (size = 19)::INT) / 6")} AS confidence FROM f
WHERE size = 19 AND {r("((brand = 'Brand#7')::INT + 3 * (kind = 'LARGE')::INT + 2 * (size = 19)::INT) / 6")} >= 0.55"""
)
def j12_offer_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receipts.identity(bind.offers(spark, sf_dir), "Brand#7", "LARGE", 19).select("offer", "product", "confidence")


@query(
    """SELECT lower(trim(p_type)) AS name, lower(trim(p_brand)) AS brand, lower(trim(p_name)) AS model, max(p_retailprice / 2000) AS confidence,
string_agg(DISTINCT p_partkey::VARCHAR, ',' ORDER BY p_partkey::VARCHAR) AS refs, count(*) AS merged FROM part GROUP BY 1, 2, 3"""
)
def u6_merge_equivalent(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = bind.table(spark, sf_dir, "part").select(
        F.col("p_type").alias("name"), F.col("p_brand").alias("brand"), F.col("p_name").alias("model"), (F.col("p_retailprice") / 2000).alias("confidence"), F.col("p_partkey").cast("string").alias("ref")
    )
    return receipts.merge_equivalent(parts)


# --- evidence and facts -----------------------------------------------------------------------------

HOSTS = """h AS (SELECT page_id, regexp_replace(lower(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1), '')), '^www\\.', '') AS host FROM pages),
k AS (SELECT page_id, host, CASE WHEN regexp_matches(host, '\\.gov(\\.|$)|\\.org$') THEN 'government' WHEN regexp_matches(host, '(^|\\.)(blog|forum|reddit)\\.') THEN 'community'
  WHEN regexp_matches(host, '(^|\\.)m\\.') THEN 'professional_database' WHEN regexp_matches(host, '(^|\\.)(shop|store)\\.|\\.com$') THEN 'retailer' WHEN regexp_matches(host, '\\.net$') THEN 'official' ELSE 'web' END AS kind FROM h)"""
QUALITY = f"""q AS (SELECT *, {r(clamp('''0.5 * CASE kind WHEN 'government' THEN 0.96 WHEN 'official' THEN 0.92 WHEN 'professional_database' THEN 0.86 WHEN 'retailer' THEN 0.74 WHEN 'web' THEN 0.58 WHEN 'community' THEN 0.42 ELSE 0.5 END
 + 0.3 * CASE kind WHEN 'retailer' THEN 1.0 WHEN 'official' THEN 0.82 WHEN 'web' THEN 0.7 ELSE 0.55 END + 0.05 + 0.07'''))} AS score FROM k)"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = bind.table(spark, sf_dir, "pages").select("page_id", fn.host_of(F.col("url")).alias("host"))
    return evidence.source_quality(hosts.withColumn("kind", evidence.source_kind(F.col("host"))))


@query(
    f"""WITH {HOSTS}, {QUALITY} SELECT page_id, host, kind, score, CASE WHEN score >= 0.88 THEN 'A' WHEN score >= 0.74 THEN 'B' WHEN score >= 0.6 THEN 'C' WHEN score >= 0.45 THEN 'D' ELSE 'E' END AS tier FROM q"""
)
def m10_source_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark, sf_dir)


@query(f"WITH {HOSTS}, {QUALITY} SELECT kind, count(*) AS pages, count(DISTINCT host) AS hosts, {r('avg(score)')} AS score FROM q GROUP BY kind")
def a16_provenance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("pages"), F.count_distinct("host").alias("hosts"), fn.half_up(F.avg("score")).alias("score"))


SUPPORT = f"""m AS (SELECT claim, value, family, max(weight) AS weight FROM s GROUP BY ALL),
u AS (SELECT claim, value, max(weight) AS best, count(*) AS families, {r(clamp("max(weight) + least(0.18::DOUBLE, 0.07::DOUBLE * (count(*) - 1))"))} AS support FROM m GROUP BY ALL)"""


@query(f"WITH {bind.STATEMENTS}, {SUPPORT} SELECT claim, value, families, support FROM u")
def a13_value_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.value_support(bind.statements(spark, sf_dir)).drop("best")


@query(
    f"""WITH {bind.STATEMENTS}, {SUPPORT}, k AS (SELECT *, row_number() OVER w AS place, lead(support) OVER w AS rival, lead(families) OVER w AS rf, count(*) OVER (PARTITION BY claim) AS n_values
  FROM u WINDOW w AS (PARTITION BY claim ORDER BY support DESC, families DESC, value))
SELECT claim, value, support, families, n_values, CASE WHEN n_values = 1 THEN 'consensus' WHEN {r("support - rival")} >= 0.16 AND best >= 0.9 THEN 'resolved'
  WHEN families >= 2 AND families > rf AND support >= 0.72 THEN 'majority' ELSE 'unresolved' END AS status FROM k WHERE place = 1"""
)
def a14_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.consensus(evidence.value_support(bind.statements(spark, sf_dir)))


@query(
    f"""WITH {bind.FACTS}, w AS (SELECT *, max(observed_at) OVER (PARTITION BY entity, type) AS newest FROM f WHERE usable)
SELECT entity, type, max(newest) AS observed_at, CASE WHEN min(value) = max(value) THEN min(value) END AS value, min(value) <> max(value) AS conflict
FROM w WHERE observed_at >= newest - INTERVAL 1 SECOND GROUP BY ALL"""
)
def j17_current_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.current_facts(bind.facts(spark, sf_dir))


@query(
    f"""WITH {bind.FACTS}, u AS (SELECT entity, observed_at, max(value) AS value FROM f WHERE usable GROUP BY ALL),
q AS (SELECT o_orderkey AS id, o_custkey AS entity, o_orderdate + INTERVAL 30 DAY AS at FROM orders)
SELECT q.id, q.entity, q.at, u.value, u.observed_at FROM q ASOF LEFT JOIN u ON q.entity = u.entity AND q.at >= u.observed_at"""
)
def j17_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = bind.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("at"))
    return evidence.as_of(bind.facts(spark, sf_dir), asked)


@query(
    """WITH x AS (SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN 'retracted' WHEN 1 THEN 'superseded' ELSE 'active' END AS state,
  o_orderdate + INTERVAL 90 DAY AS valid_until, (o_orderkey % 10) / 10 AS confidence FROM orders),
y AS (SELECT id, concat_ws(',', CASE WHEN state <> 'active' THEN state END, CASE WHEN valid_until < TIMESTAMP '2000-01-01' THEN 'expired' END, CASE WHEN confidence < 0.5 THEN 'low_confidence' END) AS reasons FROM x)
SELECT id, reasons, reasons = '' AS usable FROM y"""
)
def f5_usability(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = bind.table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 9 == 0, "retracted").when(k % 9 == 1, "superseded").otherwise("active").alias("state"),
        (F.col("o_orderdate") + F.expr("interval 90 days")).alias("valid_until"), ((k % 10) / 10).alias("confidence"),
    )
    return evidence.usability(rows, F.lit("2000-01-01").cast("timestamp")).select("id", "reasons", "usable")


@query(
    """WITH c AS (SELECT o_orderkey AS id, unnest([o_custkey, o_custkey + 1, o_orderkey % 2000]) AS ref FROM orders),
m AS (SELECT id, c.ref, x.c_custkey IS NOT NULL AS known, x.c_acctbal > 0 AS usable FROM c LEFT JOIN customer x ON c.ref = x.c_custkey),
a AS (SELECT id, count(*) FILTER (known) AS known_refs, count(*) FILTER (NOT known) AS unknown_refs, count(*) FILTER (usable) AS usable_refs FROM m GROUP BY id)
SELECT *, CASE WHEN usable_refs >= 2 THEN 'supported' WHEN usable_refs = 1 THEN 'single_source' ELSE 'unsupported' END AS status FROM a"""
)
def g10_judge_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = bind.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array(F.col("o_custkey"), F.col("o_custkey") + 1, F.col("o_orderkey") % 2000).alias("refs"))
    known = bind.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ref"), (F.col("c_acctbal") > 0).alias("usable"))
    return evidence.judge_claims(claims, known)


# --- logs and spans ---------------------------------------------------------------------------------

FOLD = """t AS (SELECT execution, count(*) AS events, arg_min(type, row(moment, seq)) AS first_type, arg_max(type, row(moment, seq)) AS last_type,
  arg_max(seq, row(moment, seq)) FILTER (type = 'failed') AS last_failure FROM a GROUP BY execution)"""


@query(f"WITH {bind.AUDIT}, {FOLD} SELECT * FROM t")
def w13_status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.status_fold(bind.audit_events(spark, sf_dir))


@query(
    f"""WITH {bind.AUDIT}, {FOLD}, x AS (SELECT DISTINCT execution, type, code FROM a WHERE type IN ('failed', 'warned')),
c AS (SELECT execution, count(*) FILTER (type = 'failed') AS blocking, count(*) FILTER (type = 'warned') AS warnings FROM x GROUP BY 1),
j AS (SELECT execution, events, coalesce(blocking, 0) AS blocking, coalesce(warnings, 0) AS warnings, last_type = 'completed' AND coalesce(blocking, 0) = 0 AS solved FROM t LEFT JOIN c USING (execution))
SELECT *, greatest(0, least(100, CASE WHEN solved THEN 100 ELSE 72 END - 12 * blocking - 4 * warnings - least(15, 3 * warnings)))::INT AS score FROM j"""
)
def a18_audit_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.audit_evaluation(bind.audit_events(spark, sf_dir))


@query(
    f"""WITH {bind.AUDIT}, l AS (SELECT *, lag(moment) OVER (PARTITION BY execution, type ORDER BY moment, seq) AS before FROM a)
SELECT execution, type, seq FROM l WHERE before IS NULL OR epoch_us(moment) - epoch_us(before) > 600000000"""
)
def x1_first_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.first_within(bind.audit_events(spark, sf_dir), ["execution", "type"]).select("execution", "type", "seq")


@query(f"WITH {bind.AUDIT} SELECT execution, seq, type FROM a QUALIFY row_number() OVER (PARTITION BY execution ORDER BY moment DESC, seq DESC) <= 8")
def s9_last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.last_n(bind.audit_events(spark, sf_dir), "execution", ["at", "seq"], 8).select("execution", "seq", "type")


UNION = """c AS (SELECT *, max("end") OVER (PARTITION BY trace ORDER BY "start", "end", span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p),
i AS (SELECT *, sum(CASE WHEN "start" > coalesce(reach, -1) THEN 1 ELSE 0 END) OVER (PARTITION BY trace ORDER BY "start", "end", span) AS island FROM c),
m AS (SELECT trace, island, min("start") AS "start", max("end") AS "end", count(*) AS spans FROM i GROUP BY 1, 2)"""


@query(f'WITH {bind.SPANS}, {UNION} SELECT trace, "start", "end", spans FROM m')
def w7_interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.interval_union(bind.spans(spark, sf_dir)).drop("island")


@query(
    f"""WITH {bind.SPANS}, {UNION}, g AS (SELECT trace, sum("end" - "start")::BIGINT AS covered, max("end") - min("start") AS extent, count(*) AS islands FROM m GROUP BY 1),
l AS (SELECT trace, max("end" - "start") AS longest, count(*) AS spans FROM p GROUP BY 1)
SELECT trace, spans, islands, covered, extent, extent - covered AS unaccounted, longest, (extent - covered) > 0.2 * extent AS gap_warning FROM g JOIN l USING (trace)"""
)
def w10_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.coverage(bind.spans(spark, sf_dir))


@query(
    f"""WITH {bind.SPANS}, n AS (SELECT a.span AS s, b.span, b."start", b."end" FROM p a JOIN p b ON a.trace = b.trace AND b."start" >= a."start" AND b."end" <= a."end"
  AND (b."end" - b."start" < a."end" - a."start" OR (b."end" - b."start" = a."end" - a."start" AND b.span > a.span))),
c AS (SELECT *, max("end") OVER (PARTITION BY s ORDER BY "start", "end", span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM n),
i AS (SELECT *, sum(CASE WHEN "start" > coalesce(reach, -1) THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY "start", "end", span) AS island FROM c),
m AS (SELECT s, island, max("end") - min("start") AS d FROM i GROUP BY 1, 2), u AS (SELECT s, sum(d)::BIGINT AS used FROM m GROUP BY 1)
SELECT trace, span, "end" - "start" - coalesce(used, 0) AS exclusive, used IS NOT NULL AS has_nested FROM p LEFT JOIN u ON s = span"""
)
def w8_exclusive_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.exclusive_time(bind.spans(spark, sf_dir))


@query(f'WITH {bind.SPANS} SELECT trace, sum(greatest(0, least("end", 1200000) - greatest("start", 600000)))::BIGINT AS overlap FROM p GROUP BY 1')
def w9_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.overlap_with(bind.spans(spark, sf_dir), 600_000, 1_200_000).groupBy("trace").agg(F.sum("overlap").alias("overlap"))


# --- corpora, texts and turns -----------------------------------------------------------------------

RESULTS = """x AS (SELECT d.doc_id AS "case", d.lang AS task, (n_chars % 101)::INT AS score, n_chars % 101 >= 50 AS passed, 1.0 + l.toxic AS weight,
  ((n_chars * 7 + d.doc_id) % 101)::INT AS c_score, (n_chars * 7 + d.doc_id) % 101 >= 50 AS c_passed FROM documents d JOIN labels l USING (doc_id))"""


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = bind.table(spark, sf_dir, "documents").join(bind.table(spark, sf_dir, "labels"), "doc_id")
    common = [F.col("doc_id").alias("case"), F.col("lang").alias("task"), (1.0 + F.col("toxic")).alias("weight")]
    score = F.col("n_chars") % 101
    other = (F.col("n_chars") * 7 + F.col("doc_id")) % 101
    return rows.select(*common, score.cast("int").alias("score"), (score >= 50).alias("passed")), rows.select(*common, other.cast("int").alias("score"), (other >= 50).alias("passed"))


@query(
    f"""WITH {RESULTS} SELECT "case", task, c_score AS score, CASE WHEN c_score < score OR (passed AND NOT c_passed) THEN 'regression'
WHEN c_score > score OR (NOT passed AND c_passed) THEN 'improvement' ELSE 'same' END AS change FROM x"""
)
def j1_compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.compare_runs(*_runs(spark, sf_dir)).select("case", "task", "score", "change")


@query(f"WITH {RESULTS} SELECT task, count(*) AS cases, count(*) FILTER (passed) AS passed, floor(sum(score * weight) / sum(weight) + 0.5)::INT AS score FROM x GROUP BY task")
def a7_golden_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.weighted_report(_runs(spark, sf_dir)[0], ["task"])


@query(
    """WITH h AS (SELECT abs(doc_id) % 64 AS part, sha256(doc_id::VARCHAR || chr(31) || coalesce(text, '') || chr(31) || coalesce(lang, '') || chr(31) || coalesce(source, '')) AS h FROM documents)
SELECT part, count(*) AS rows, sha256(string_agg(h, '' ORDER BY h)) AS digest FROM h GROUP BY part"""
)
def c1_corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.manifest(bind.table(spark, sf_dir, "documents"), "doc_id", ["doc_id", "text", "lang", "source"])


FNV = """f AS (SELECT doc_id, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split('seed-1|' || doc_id, ''), lambda c: ord(c)::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)::BIGINT AS h FROM documents)"""


@query(
    f"""WITH {FNV}, k AS (SELECT doc_id, h, row_number() OVER (ORDER BY h, doc_id) AS place, count(*) OVER () AS n FROM f)
SELECT doc_id, h, place <= greatest(CASE WHEN n > 1 THEN 1 ELSE 0 END, floor(n * 0.2::DOUBLE + 0.5)) AS validation FROM k"""
)
def c3_corpus_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.split(bind.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "seed-1")


@query("""WITH x AS (SELECT doc_id, sha256(coalesce(text, '')) AS digest, n_chars FROM documents),
e AS (SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 13 = 0 THEN 'altered' ELSE digest END AS digest FROM x WHERE doc_id % 7 <> 0), f AS (SELECT doc_id::VARCHAR AS path, digest FROM x WHERE doc_id % 5 <> 0)
SELECT path, CASE WHEN f.digest IS NULL THEN 'missing' WHEN e.digest IS NULL THEN 'unexpected' WHEN e.digest = f.digest THEN 'ok' ELSE 'mismatched' END AS status FROM e FULL JOIN f USING (path)""")
def j3_verify_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bind.table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    expected = docs.filter("doc_id % 7 <> 0").withColumn("digest", F.when(F.col("doc_id") % 13 == 0, "altered").otherwise(F.col("digest")))
    return corpus.verify_assets(expected, docs.filter("doc_id % 5 <> 0"))


@query("""WITH x AS (SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents),
e AS (SELECT doc_id::VARCHAR AS path, digest FROM x), f AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'moved/' || doc_id ELSE doc_id::VARCHAR END AS path, digest FROM x WHERE doc_id % 5 <> 0),
g AS (SELECT digest, min(path) AS other FROM f GROUP BY 1)
SELECT e.path, coalesce(f.path, g.other) AS bound, CASE WHEN f.path IS NOT NULL THEN 'path' WHEN g.other IS NOT NULL THEN 'digest' ELSE 'none' END AS "by" FROM e LEFT JOIN f ON e.path = f.path LEFT JOIN g ON e.digest = g.digest""")
def j4_bind_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bind.table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    found = docs.filter("doc_id % 5 <> 0").withColumn("path", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")))
    return corpus.bind_assets(docs.select("path", "digest"), found.select("path", "digest"))


@query(
    """SELECT doc_id, concat_ws(',', CASE WHEN NOT coalesce(length(text) >= 200, false) THEN 'short' END, CASE WHEN NOT coalesce(lang IN ('en', 'de', 'fr'), false) THEN 'language' END,
CASE WHEN NOT coalesce(n_chars = length(text), false) THEN 'length' END) AS issues, concat_ws(',', CASE WHEN NOT coalesce(length(text) >= 200, false) THEN 'short' END, CASE WHEN NOT coalesce(lang IN ('en', 'de', 'fr'), false) THEN 'language' END,
CASE WHEN NOT coalesce(n_chars = length(text), false) THEN 'length' END) = '' AS valid FROM documents"""
)
def f6_validate_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    docs = bind.table(spark, sf_dir, "documents")
    return corpus.validate(docs, {"short": n >= 200, "language": F.col("lang").isin("en", "de", "fr"), "length": F.col("n_chars") == n}).select("doc_id", "issues", "valid")


@query(
    r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[REDACTED_EMAIL]', 'g'), '\b[0-9]{13,19}\b', '[REDACTED_CARD]', 'g'),
  '\+?[0-9][0-9 ().-]{8,14}[0-9]', '[REDACTED_PHONE]', 'g') AS clean FROM documents)
SELECT doc_id, sha256(clean) AS digest, ((length(clean) - length(replace(clean, '[REDACTED_', ''))) / 10)::INT AS redactions FROM c"""
)
def t9_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.redact(bind.table(spark, sf_dir, "documents")).select("doc_id", F.sha2("clean", 256).alias("digest"), "redactions")


@query(
    r"""SELECT doc_id, CASE WHEN regexp_matches(text, '\p{Han}') THEN 'zh' WHEN regexp_matches(text, '[ぁ-ヿ]') THEN 'ja'
WHEN regexp_matches(text, '[áéíóúñ¿¡]') OR regexp_matches(lower(text), '\b(que|para|con|una|los|las)\b') THEN 'es' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS detected FROM documents"""
)
def t10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.table(spark, sf_dir, "documents").select("doc_id", fn.language_of(F.col("text")).alias("detected"))


@query("SELECT p_partkey, regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9áéíóúñ]+', '', 'g') AS key FROM part")
def t18_canonical_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.table(spark, sf_dir, "part").select("p_partkey", fn.canonical_key(F.concat_ws(" ", "p_name", "p_brand")).alias("key"))


@query(
    """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations)
SELECT conv_id, count(*) AS kept, count(*) FILTER (role = 'user') AS user_turns, max(turn) AS last_turn, sum(length(text))::BIGINT AS chars FROM t WHERE place <= 8 GROUP BY conv_id"""
)
def w1_last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = benchmark.last_n(bind.table(spark, sf_dir, "conversations"), "conv_id", ["turn"], 8)
    return kept.groupBy("conv_id").agg(F.count("*").alias("kept"), F.count_if(F.col("role") == "user").alias("user_turns"), F.max("turn").alias("last_turn"), F.sum(F.length("text").cast("bigint")).alias("chars"))


@query(f"WITH c AS (SELECT role, count(*) AS n FROM conversations GROUP BY role) SELECT role, n, {r('n / (SELECT sum(n) FROM c)')} AS share FROM c")
def a19_count_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.share_of(bind.table(spark, sf_dir, "conversations"), "role")


U_BASE = "o AS (SELECT c_custkey AS id, c_acctbal AS v FROM customer WHERE c_acctbal < 6000), n AS (SELECT c_custkey AS id, c_acctbal + 1 AS v FROM customer WHERE c_acctbal >= 3000)"


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = bind.table(spark, sf_dir, "customer")
    return c.filter("c_acctbal < 6000").selectExpr("c_custkey as id", "c_acctbal as v"), c.filter("c_acctbal >= 3000").selectExpr("c_custkey as id", "c_acctbal + 1 as v")


@query(f"WITH {U_BASE} SELECT * FROM n UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM n)")
def u1_merge_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.merge_last(*_two(spark, sf_dir), ["id"])


@query(f"WITH {U_BASE} SELECT * FROM o UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM o)")
def u2_merge_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.merge_first(*_two(spark, sf_dir), ["id"])


# --- task graphs ------------------------------------------------------------------------------------


@query(
    f"""WITH {bind.GRAPH}, m AS (SELECT d.id, bool_and(coalesce(n.state = 'completed' OR (n.optional AND n.state IN ('failed', 'skipped')), false)) AS met FROM d LEFT JOIN n ON d.dep = n.id GROUP BY d.id)
SELECT n.id FROM n LEFT JOIN m USING (id) WHERE state = 'pending' AND coalesce(met, true)"""
)
def j18_ready_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ready_nodes(bind.nodes(spark, sf_dir), bind.edges(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {bind.GRAPH}, w(id, level) AS (SELECT id, 0 FROM n WHERE id NOT IN (SELECT id FROM d) UNION SELECT d.id, level + 1 FROM d JOIN w ON d.dep = w.id)
SELECT id, max(level)::INT AS level FROM w GROUP BY id"""
)
def n2_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.levels(bind.nodes(spark, sf_dir), bind.edges(spark, sf_dir))


@query(f"WITH RECURSIVE {bind.GRAPH}, w(id) AS (SELECT '0-1' UNION SELECT d.id FROM d JOIN w ON d.dep = w.id) SELECT id FROM w")
def n3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.descendants(bind.edges(spark, sf_dir), "0-1")


@query(f"WITH {bind.GRAPH} SELECT state, count(*) AS n FROM n GROUP BY state")
def n5_graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.nodes(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


# --- decisions and ordered folds --------------------------------------------------------------------

SIGNAL_OF = {"purchase": "verified_success", "view": "provisional_resolution", "click": "technical_success_only", "error": "technical_failure", "signup": "user_corrected"}


def _case(column: str, values: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


@query(
    f"""WITH {bind.BENCH}, s AS (SELECT engine, {_case("scenario", {k: f"{decisions.SIGNALS[v][0]}::DOUBLE" for k, v in SIGNAL_OF.items()})} AS s, {_case("scenario", {k: f"{decisions.SIGNALS[v][1]}::DOUBLE" for k, v in SIGNAL_OF.items()})} AS w FROM b),
g AS (SELECT engine, sum(s * w) AS won, sum(w) AS weight FROM s GROUP BY 1)
SELECT engine, {r("weight")} AS weight, {r("won / weight")} AS evidence_score, {r("(won / weight * weight + 2.0) / (weight + 4.0)")} AS shrunk_score, {r("least(1.0::DOUBLE, weight / 12)")} AS confidence FROM g"""
)
def a11_specialist_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in SIGNAL_OF.items() for x in kv])
    return decisions.specialist_scores(bind.bench_rows(spark, sf_dir).withColumn("signal", names[F.col("scenario")]), ["engine"])


@query(
    f"""WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_discount - 0.02 AS a, l_tax - 0.03 AS b, (l_quantity - 25) / 200 AS c, l_discount - l_tax AS d FROM lineitem)
SELECT id, {r("least(0.20::DOUBLE, least(0.16::DOUBLE, greatest(a, 0) + greatest(b, 0) + greatest(c, 0)) + greatest(d, 0)) + greatest(-0.28::DOUBLE, least(a, 0) + least(b, 0) + least(c, 0) + least(d, 0))")} AS budget FROM x"""
)
def m7_weight_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bind.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber as id", "l_discount - 0.02d as a", "l_tax - 0.03d as b", "(l_quantity - 25) / 200 as c", "l_discount - l_tax as d"
    )
    return decisions.weight_budget(rows, ["a", "b", "c"], "d").select("id", "budget")


@query(
    f"""WITH {bind.BENCH}, {PATTERNS}, k AS (SELECT tag, engine, row_number() OVER w AS place, {r("avg_quality - lead(avg_quality) OVER w")} AS lead FROM f WINDOW w AS (PARTITION BY tag ORDER BY avg_quality DESC, engine))
SELECT tag, CASE WHEN coalesce(lead >= 0.04, true) THEN engine ELSE 'no_clear_winner' END AS winner, lead FROM k WHERE place = 1"""
)
def w2_clear_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.clear_winner(a8_failure_patterns(spark, sf_dir), "tag", "engine", "avg_quality", 0.04)


@query(
    f"""WITH {bind.BENCH}, k AS (SELECT engine, scenario, {r("avg(quality)")} AS score FROM b WHERE scenario IN ('view', 'click') GROUP BY 1, 2),
g AS (SELECT engine, {r("avg(quality)")} AS score FROM b GROUP BY 1)
SELECT q.engine, q.scenario, coalesce(k.score, g.score) AS score, k.score IS NOT NULL AS is_exact FROM (SELECT DISTINCT engine, scenario FROM b) q LEFT JOIN k USING (engine, scenario) LEFT JOIN g ON g.engine = q.engine"""
)
def j10_fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bind.bench_rows(spark, sf_dir)
    score = fn.half_up(F.avg("quality")).alias("score")
    exact = rows.filter(F.col("scenario").isin("view", "click")).groupBy("engine", "scenario").agg(score)
    general = rows.groupBy("engine").agg(score).select("engine", F.lit("*").alias("scenario"), "score")
    return decisions.with_fallback(rows.select("engine", "scenario").distinct(), exact.union(general), "engine", "scenario", "score")


@query(
    f"""WITH {bind.STATEMENTS}, g AS (SELECT claim, count(*) AS n, count(DISTINCT family) AS families, count(DISTINCT value) AS n_values, {r("avg(weight)")} AS mean_weight FROM s GROUP BY 1)
SELECT *, n_values > 1 AS conflict, n >= 3 AND families >= 2 AND mean_weight >= 0.62 AS enough FROM g"""
)
def a15_evidence_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.evidence_set(bind.statements(spark, sf_dir))


@query(
    """WITH f AS (SELECT event_id, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split('q-' || event_id, ''), lambda c: ord(c)::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)::BIGINT AS h FROM events)
SELECT event_id, h < 858993459 AS explore FROM f"""
)
def g9_exploration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bind.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("q-"), "event_id").alias("request"))
    return decisions.explores(rows, "request").select("event_id", "explore")


@query(
    f"""WITH c AS (SELECT user_id, event_id, count(*) OVER w AS calls_before, coalesce({r("sum(value) OVER w", 2)}, 0) AS cost_before FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT *, calls_before < 40 AND cost_before < 1500 AS allowed FROM c"""
)
def g25_call_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = bind.table(spark, sf_dir, "events")
    return decisions.budgeted(events, "user_id", ["ts", "event_id"], "value", 40, 1500.0).select("user_id", "event_id", "calls_before", "cost_before", "allowed")


@query(
    """WITH x AS (SELECT CASE WHEN c IS NULL THEN 'missing' WHEN c >= 0.85 THEN 'certain' WHEN c >= 0.70 THEN 'likely' ELSE 'doubtful' END AS bucket,
  CASE WHEN c >= 0.82 THEN 'accepted' WHEN c >= 0.65 THEN 'needs_check' ELSE 'rejected' END AS gate FROM (SELECT CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE (p_size * 2) / 100 END AS c FROM part))
SELECT bucket, gate, count(*) AS n FROM x GROUP BY 1, 2"""
)
def p22_confidence_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.when(F.col("p_partkey") % 17 != 0, F.col("p_size") * 2 / 100)
    rows = bind.table(spark, sf_dir, "part").select(decisions.confidence_bucket(c).alias("bucket"), decisions.gate(c).alias("gate"))
    return rows.groupBy("bucket", "gate").agg(F.count("*").alias("n"))


@query(
    f"""WITH {bind.OCR}, k AS (SELECT DISTINCT kind FROM o), s AS (SELECT DISTINCT strategy FROM o), g AS (SELECT kind, strategy, count(*) AS n FROM o WHERE failed AND cold GROUP BY 1, 2)
SELECT kind, strategy, coalesce(n, 0) AS n, n IS NULL AS missing FROM k CROSS JOIN s LEFT JOIN g USING (kind, strategy)"""
)
def j6_case_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bind.ocr_rows(spark, sf_dir)
    counted = rows.filter("failed and cold").groupBy("kind", "strategy").agg(F.count("*").alias("n"))
    out = decisions.grid(rows.select("kind").distinct(), rows.select("strategy").distinct(), counted, ["kind", "strategy"])
    return out.select("kind", "strategy", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))


REGIONS = "r AS (SELECT l_orderkey AS g, l_linenumber AS id, l_discount * 100 AS x, l_tax * 100 AS y, l_quantity AS w, l_quantity / 2 AS h FROM lineitem)"


@query(
    f"""WITH {REGIONS} SELECT p.g, p.id AS parent, c.id AS child FROM r p JOIN r c ON p.g = c.g AND p.id <> c.id AND p.w * p.h > c.w * c.h
  AND c.x + c.w / 2 BETWEEN p.x AND p.x + p.w AND c.y + c.h / 2 BETWEEN p.y AND p.y + p.h"""
)
def j14_contained_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = bind.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as g", "l_linenumber as id", "l_discount * 100 as x", "l_tax * 100 as y", "l_quantity as w", "l_quantity / 2 as h")
    return decisions.contained(regions, "g")


@query(
    f"""WITH c AS (SELECT p_type AS category, count(*) AS n FROM part GROUP BY 1) SELECT category, n, {r("n / (SELECT sum(n) FROM c)")} AS share, {r("n / (SELECT sum(n) FROM c)")} > 0.15 AS too_large FROM c"""
)
def a20_category_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.category_coverage(bind.table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("category")).agg(F.count("*").alias("n")))


UNCERTAIN = "x AS (SELECT o_orderkey AS id, (o_orderkey % 100) / 100 AS raw, (o_custkey % 10) / 10 AS support, o_orderkey % 3 AS conflicts, o_custkey % 4 AS unknown, o_orderkey % 5 AS uncertain, o_custkey % 2 AS limitations FROM orders)"
PENALTY = "least(0.55::DOUBLE, 0.22::DOUBLE * conflicts + 0.08::DOUBLE * unknown + 0.045::DOUBLE * uncertain + 0.035::DOUBLE * limitations)"


@query(f"WITH {UNCERTAIN} SELECT id, {r(clamp(f'raw - CASE WHEN raw >= 0.85 AND support < 0.5 THEN greatest({PENALTY}, 0.18::DOUBLE) ELSE {PENALTY} END'))} AS calibrated FROM x")
def a28_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bind.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id", "(o_orderkey % 100) / 100 as raw", "(o_custkey % 10) / 10 as support", "o_orderkey % 3 as conflicts", "o_custkey % 4 as unknown", "o_orderkey % 5 as uncertain", "o_custkey % 2 as limitations"
    )
    return decisions.uncertainty(rows).select("id", "calibrated")


@query(
    f"""WITH {bind.AUDIT}, l AS (SELECT execution, type, lag(type) OVER w AS one, lag(type, 2) OVER w AS two FROM a WINDOW w AS (PARTITION BY execution ORDER BY moment, seq))
SELECT execution, count(*) AS n, count(*) FILTER (coalesce(type = one, false)) AS repeats, bool_or(coalesce(type = one AND one = two, false)) AS loops FROM l GROUP BY 1"""
)
def g22_repeated_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.repeated_routes(bind.audit_events(spark, sf_dir), "execution", "type", ["at", "seq"])


@query(
    f"""WITH {bind.AUDIT}, l AS (SELECT execution, seq, code, max(code) OVER (PARTITION BY execution ORDER BY moment, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS shown FROM a)
SELECT execution, seq, code FROM l WHERE shown IS NULL OR code >= shown"""
)
def x9_progressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.progressive(bind.audit_events(spark, sf_dir), "execution", "code", ["at", "seq"]).select("execution", "seq", "code")


@query(
    f"""WITH {bind.AUDIT}, e AS (SELECT *, lag(type) OVER (PARTITION BY execution ORDER BY moment, seq) AS before FROM a WHERE type IN ('started', 'completed'))
SELECT execution, count(*) FILTER (type = 'started' AND before = 'completed') AS reopened, arg_max(type, row(moment, seq)) = 'started' AS is_open FROM e GROUP BY 1"""
)
def x6_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.generations(bind.audit_events(spark, sf_dir), "execution", "type", "started", "completed", ["at", "seq"])


@query(
    f"""WITH {bind.FACTS}, k AS (SELECT *, row_number() OVER (PARTITION BY entity, type ORDER BY observed_at DESC, id DESC) AS place,
  arg_max(id, row(observed_at, id)) FILTER (usable) OVER (PARTITION BY entity, type) AS newest FROM f) SELECT id, place, coalesce(newest = id, false) AS is_current FROM k"""
)
def w4_fact_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.history(bind.facts(spark, sf_dir)).select("id", "place", "is_current")


TOKENS = "list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t <> ''))"


@query(
    f"""WITH t AS (SELECT conv_id, turn, {TOKENS} AS own, lag({TOKENS}) OVER (PARTITION BY conv_id ORDER BY turn) AS other FROM conversations)
SELECT conv_id, turn, CASE WHEN other IS NULL OR len(own) = 0 THEN 0 ELSE {r("len(list_intersect(own, other)) / len(own)")} END AS overlap FROM t"""
)
def t20_turn_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.turn_overlap(bind.table(spark, sf_dir, "conversations"))


@query(None)
def t2_word_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between the test items and the same texts with every seventh word left out."""
    items = bind.table(spark, sf_dir, "benchmark")
    heard = F.array_join(F.filter(F.split("text", " "), lambda _, i: i % 7 != 6), " ")
    return items.select("item_id", fn.half_up(states.word_error_rate(F.col("text"), heard)).alias("wer"))


BIGRAMS = "CASE WHEN length({0}) < 2 THEN [] ELSE list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))) END"


@query(
    f"""WITH x AS (SELECT p_partkey, {BIGRAMS.format("lower(p_name)")} AS a, {BIGRAMS.format("lower(p_type)")} AS b FROM part)
SELECT p_partkey, CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE {r("2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b))")} END AS similarity FROM x"""
)
def t5_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.table(spark, sf_dir, "part").select("p_partkey", fn.half_up(fn.dice(F.lower("p_name"), F.lower("p_type"))).alias("similarity"))


@query(
    """WITH c AS (SELECT p_partkey, lpad((p_partkey * 7919)::VARCHAR, 13, '0') AS code FROM part),
d AS (SELECT p_partkey, code, list_sum(list_transform(range(1, 14), lambda i: substr(code, i, 1)::INT * CASE WHEN (13 - i) % 2 = 1 THEN 3 ELSE 1 END)) AS s FROM c) SELECT p_partkey, code, s % 10 = 0 AS valid FROM d"""
)
def t15_gtin(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.lpad((F.col("p_partkey") * 7919).cast("string"), 13, "0")
    return bind.table(spark, sf_dir, "part").select("p_partkey", code.alias("code"), fn.gtin_valid(code).alias("valid"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, floor(l_extendedprice * 100 + 0.5)::BIGINT AS amount FROM lineitem""")
def m1_parsed_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written with points for thousands and a comma for cents, and read back."""
    written = F.concat(F.lit("$ "), F.translate(F.format_number("l_extendedprice", 2), ".,", ",."))
    return bind.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), states.parsed_amount(written).alias("amount"))


@query(
    """WITH d AS (SELECT o_orderkey, day(o_orderdate) + o_orderkey % 4 AS d, month(o_orderdate) AS m, year(o_orderdate) AS y FROM orders)
SELECT o_orderkey, try_cast(lpad(y::VARCHAR, 4, '0') || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(d::VARCHAR, 2, '0') AS DATE)::VARCHAR AS parsed FROM d"""
)
def m2_parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates moved by up to three days without carrying, so that some do not exist."""
    day = F.dayofmonth("o_orderdate") + F.col("o_orderkey") % 4
    return bind.table(spark, sf_dir, "orders").select("o_orderkey", states.parsed_date(F.concat_ws("/", day, F.month("o_orderdate"), F.year("o_orderdate"))).cast("string").alias("parsed"))


LOOPS = """x(id, dep) AS (SELECT id, dep FROM d UNION ALL VALUES ('0-5', 'zz'), ('loop-a', 'loop-b'), ('loop-b', 'loop-c'), ('loop-c', 'loop-a'), ('behind', 'loop-a')), m(id) AS (SELECT id FROM n UNION ALL VALUES ('0-1'), ('loop-a'), ('loop-b'), ('loop-c'), ('behind'))"""


@query(
    f"""WITH RECURSIVE {bind.GRAPH}, {LOOPS}, w(id) AS (SELECT 'loop-a' UNION SELECT x.id FROM x JOIN w ON x.dep = w.id)
SELECT id, 'unknown_dependency' AS issue FROM x WHERE dep NOT IN (SELECT id FROM m) UNION SELECT id, 'duplicate_id' FROM m GROUP BY id HAVING count(*) > 1 UNION SELECT id, 'cycle' FROM w"""
)
def n1_graph_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph with a node twice, a dependency that does not exist, a cycle and a node behind it."""
    more = [("0-1", "completed", False), *((x, "pending", False) for x in ("loop-a", "loop-b", "loop-c", "behind"))]
    steps = [("0-5", "zz"), ("loop-a", "loop-b"), ("loop-b", "loop-c"), ("loop-c", "loop-a"), ("behind", "loop-a")]
    nodes = bind.nodes(spark, sf_dir).union(spark.createDataFrame(more, "id string, state string, optional boolean"))
    return graph.issues(nodes, bind.edges(spark, sf_dir).union(spark.createDataFrame(steps, "id string, dep string")))


# --- texts of receipts, classes, routing ------------------------------------------------------------


@query(f"WITH {bind.RECEIPTS} SELECT receipt, subtotal, tax + 100 AS tax, CASE WHEN receipt % 4 <> 0 THEN discount END AS discount, total FROM r")
def r1_parsed_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts written as text, with two tax lines, a misleading total and some without discount, and parsed again."""
    money = lambda c: F.format_number(F.col(c) / 100, 2)
    lines = F.concat_ws(
        "\n", F.concat(F.lit("Shop 12, ticket "), "receipt"), F.concat(F.lit("SUBTOTAL $ "), money("subtotal")), F.concat(F.lit("IVA 16% "), money("tax")), F.lit("Tax extra 1.00"),
        F.when(F.col("receipt") % 4 != 0, F.concat(F.lit("Descuento -"), money("discount"))), F.lit("TOTAL 9.99"), F.concat(F.lit("Total: $"), money("total")), F.lit("TOTAL DE ARTICULOS 3"),
    )
    return text.receipt_fields(bind.receipts(spark, sf_dir).select("receipt", lines.alias("text")), "receipt")


# fixed values: class, pattern, weight
RULES = [("license", "License", 3.0), ("license", "Licensed under|All rights reserved", 2.0), ("list", " [|] ", 4.0), ("shout", "[A-Z]!!", 5.0), ("contact", "@", 2.0), ("contact", "[+]1 [(]", 2.0)]


def _class_sql() -> str:
    names = list(dict.fromkeys(n for n, _, _ in RULES))
    total = lambda n: " + ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for m, p, w in RULES if m == n)
    rows = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS name, {total(n)} AS s FROM documents" for n in names)
    return f"""WITH c AS ({rows}), k AS (SELECT *, s - lead(s) OVER w AS margin, row_number() OVER w AS place FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY s DESC, name))
    SELECT doc_id, s AS score, margin, CASE WHEN s >= 3 THEN name ELSE 'unknown' END AS class FROM k WHERE place = 1"""


@query(_class_sql())
def r8_text_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.classified(bind.table(spark, sf_dir, "documents").select("doc_id", "text"), RULES).select("doc_id", "score", "margin", "class")


@query("SELECT p_partkey, CASE WHEN length(p_name) <= 4 THEN p_name ELSE repeat('*', length(p_name) - 4) || right(p_name, 4) END AS masked FROM part")
def t17_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.table(spark, sf_dir, "part").select("p_partkey", text.masked(F.col("p_name")).alias("masked"))


@query("""WITH t AS (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS corrects FROM conversations)
SELECT conv_id, turn, corrects FROM t WHERE role = 'user' AND regexp_matches(lower(text), '^(th|no|a)')""")
def x7_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.corrections(bind.table(spark, sf_dir, "conversations"), "^(th|no|a)").select("conv_id", "turn", "corrects")


@query(f"""WITH {bind.BENCH}, s AS ({_summary_sql("device")}) SELECT device, concat_ws(',', CASE WHEN success_rate < 0.95 THEN 'success' END, CASE WHEN avg_quality < 0.8 THEN 'quality' END,
CASE WHEN p95_latency_ms > CASE device WHEN 0 THEN 4200 WHEN 1 THEN 3500 ELSE 4000 END THEN 'p95' END) AS failures FROM s""")
def g7_mobile_reality(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = F.when(F.col("device") == 0, 4200).when(F.col("device") == 1, 3500).otherwise(4000)
    summary = a3_lab_summary(spark, sf_dir)
    checked = corpus.validate(summary, {"success": F.col("success_rate") >= 0.95, "quality": F.col("avg_quality") >= 0.8, "p95": F.col("p95_latency_ms") <= limit})
    return checked.select("device", F.col("issues").alias("failures"))


@query(f"""WITH p AS (SELECT s_suppkey AS provider, s_nationkey AS cohort, (s_suppkey % 11) / 10 AS c, 0.6::DOUBLE + (s_suppkey % 5) / 10 AS rel, (s_suppkey % 7) / 6 AS lat, (s_suppkey % 4) / 3 AS mem, s_suppkey % 130 AS priority FROM supplier),
s AS (SELECT provider, cohort, {r("0.43::DOUBLE * c + 0.24::DOUBLE * rel + 0.14::DOUBLE * lat + 0.09::DOUBLE * mem + 0.05::DOUBLE * least(1.0::DOUBLE, priority / 100)")} AS score FROM p WHERE rel >= 0.75)
SELECT provider, cohort, score, row_number() OVER (PARTITION BY cohort ORDER BY score DESC, provider) AS rank FROM s""")
def g8_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as providers, ranked inside their nation; those below .75 of reliability are not eligible (F3)."""
    k = F.col("s_suppkey")
    profiles = bind.table(spark, sf_dir, "supplier").select(
        k.alias("provider"), F.col("s_nationkey").alias("cohort"), (k % 11 / 10).alias("c"), (0.6 + k % 5 / 10).alias("rel"), (k % 7 / 6).alias("lat"), (k % 4 / 3).alias("mem"), (k % 130).alias("priority")
    )
    return decisions.routed(profiles.filter("rel >= 0.75"), "cohort")


@query(f"""WITH {bind.RECEIPTS}, o AS (SELECT receipt, subtotal, tax, discount + (receipt % 3) AS discount, CASE WHEN receipt % 5 = 0 THEN NULL ELSE total END AS total FROM r),
a AS (UNPIVOT r ON subtotal, tax, discount, total INTO NAME field VALUE v), b AS (SELECT receipt, field, w FROM o UNPIVOT INCLUDE NULLS (w FOR field IN (subtotal, tax, discount, total)))
SELECT field, count(*) AS n, {r("avg(coalesce(v = w, false)::INT)")} AS accuracy FROM a JOIN b USING (receipt, field) GROUP BY field""")
def a24_field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = bind.receipts(spark, sf_dir)
    seen = truth.withColumns({"discount": F.col("discount") + F.col("receipt") % 3, "total": F.when(F.col("receipt") % 5 != 0, F.col("total"))})
    pairs = receipts.facts(truth).select("receipt", "field", "value").join(receipts.facts(seen).select("receipt", "field", F.col("value").alias("seen")), ["receipt", "field"])
    return pairs.groupBy("field").agg(F.count("*").alias("n"), fn.half_up(F.avg(F.coalesce((F.col("value") == F.col("seen")).cast("int"), F.lit(0)))).alias("accuracy"))


@query("""WITH g AS (SELECT l_orderkey, list_sort(list_distinct(list(l_linenumber))) AS got FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_filter([1, 3, 5, 7], lambda x: list_contains(got, x)), ',') AS resolved, array_to_string(list_filter([1, 3, 5, 7], lambda x: NOT list_contains(got, x)), ',') AS remaining FROM g""")
def j19_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(*[F.lit(x) for x in (1, 3, 5, 7)])
    got = bind.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("got"))
    return got.select("l_orderkey", F.array_join(F.array_intersect(wanted, "got"), ",").alias("resolved"), F.array_join(F.array_except(wanted, "got"), ",").alias("remaining"))


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def u5_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bind.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return docs.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


@query("""WITH a AS (SELECT CASE WHEN date_diff('day', o_orderdate::DATE, DATE '2000-06-01') < 0 THEN NULL ELSE date_diff('day', o_orderdate::DATE, DATE '2000-06-01') END AS age FROM orders)
SELECT CASE WHEN age IS NULL THEN 0.5 WHEN age <= 1 THEN 1.0 WHEN age <= 7 THEN 0.9 WHEN age <= 30 THEN 0.8 WHEN age <= 180 THEN 0.65 WHEN age <= 365 THEN 0.55 ELSE 0.4 END::DOUBLE AS weight, count(*) AS n FROM a GROUP BY 1""")
def m3_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.date_diff(F.lit("2000-06-01").cast("date"), F.col("o_orderdate").cast("date"))
    return bind.table(spark, sf_dir, "orders").groupBy(fn.recency_weight(F.when(age >= 0, age)).alias("weight")).agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT event_id AS id, event_type AS kind FROM events), k AS (SELECT * FROM o WHERE kind NOT IN ('view', 'click') UNION ALL SELECT id, 'seen' AS kind FROM o WHERE kind = 'view')
SELECT kind, count(*) AS n FROM k GROUP BY kind""")
def p17_replaced_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of two kinds taken out and others put in their place, counted by kind."""
    seen = bind.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    fresh = seen.filter("kind = 'view'").withColumn("kind", F.lit("seen"))
    return seen.filter(~F.col("kind").isin("view", "click")).unionByName(fresh).groupBy("kind").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT l_returnflag AS strategy, k, sum(v) AS v FROM (SELECT l_returnflag, unnest(['load', 'run']) AS k, unnest([floor(l_quantity)::BIGINT, floor(l_discount * 100 + 0.5)::BIGINT]) AS v FROM lineitem) GROUP BY 1, 2)
SELECT strategy, string_agg(k || '=' || v::BIGINT, ',' ORDER BY k) AS timings FROM t GROUP BY 1""")
def a29_stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of stage to time, summed key by key."""
    maps = bind.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("strategy"), F.create_map(F.lit("load"), F.floor("l_quantity").cast("bigint"), F.lit("run"), F.floor(F.col("l_discount") * 100 + 0.5).cast("bigint")).alias("m")
    )
    summed = maps.select("strategy", F.explode("m").alias("k", "v")).groupBy("strategy", "k").agg(F.sum("v").alias("v"))
    return summed.groupBy("strategy").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "k", "v"))), ",").alias("timings"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# these modules register queries of their own
from plumbline.plans import answer_queries, corpus_queries, graph_queries, plan_queries, policy_queries, receipt_queries, record_queries, routing_queries, store_queries  # noqa: E402, F401
