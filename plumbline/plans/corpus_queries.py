"""Queries of golden cases, corpora, annotations, personal data and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scalars as fn
from plumbline.operators import golden, privacy
from plumbline.plans.policy_queries import flags_sql, pick, pick_sql
from plumbline.plans.registry import query, r
from plumbline.sources import bindings as bind

GOLDEN = """g AS (SELECT o_orderkey AS "case", o_orderpriority AS task, o_orderkey % 10 = 0 AS critical, 1 + o_orderkey % 3 AS weight, o_orderstatus = 'F' AS c1, count(*) IN (1, 2, 3) AS c2,
  bool_or(l_returnflag = 'R') AND bool_or(l_returnflag = 'A') AS c3, o_totalprice > 100000 AS c4 FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderstatus, o_totalprice),
h AS (SELECT *, concat_ws(',', CASE WHEN NOT c3 THEN '$.flags' END, CASE WHEN NOT c2 THEN '$.lines' END, CASE WHEN NOT c1 THEN '$.status' END, CASE WHEN NOT c4 THEN '$.total.large' END) AS failures,
  floor((c1::INT + c2::INT + c3::INT + c4::INT) / 4 * 100 + 0.5)::INT AS score FROM g)"""


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = bind.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.sort_array(F.collect_set("l_returnflag")).alias("flags"))
    k = F.col("o_orderkey")
    actual = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), "lines", "flags", F.struct((F.col("o_totalprice") > 100000).alias("large")).alias("total")))
    wanted = '{"status":"F","lines":{"$oneOf":[1,2,3]},"flags":{"$includes":["R","A"]},"total":{"large":true}}'
    rows = bind.table(spark, sf_dir, "orders").join(lines, "o_orderkey").select(k.alias("case"), F.lit(wanted).alias("expected"), actual.alias("actual"))
    return golden.compared(rows, "case")


@query(f'WITH {GOLDEN} SELECT "case", 4 AS checks, score, failures = \'\' AS passed, failures FROM h')
def m13_compare_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON against a tree with values, ``$oneOf`` and ``$includes``."""
    return _compared(spark, sf_dir)


@query(
    f"""WITH {GOLDEN} SELECT task, count(*) AS cases, count(*) FILTER (failures = '') AS passed, floor(sum(score * weight) / sum(weight) + 0.5)::INT AS weighted_score, floor(avg(score) + 0.5)::INT AS score,
  count(*) FILTER (failures <> '' AND critical) AS critical_failures, min("case") FILTER (failures <> '' AND critical) AS first_critical FROM h GROUP BY task"""
)
def a7_golden_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    meta = bind.table(spark, sf_dir, "orders").select(k.alias("case"), F.col("o_orderpriority").alias("task"), (k % 10 == 0).alias("critical"), (1 + k % 3).alias("weight"))
    return golden.report(_compared(spark, sf_dir).join(meta, "case"), ["task"])


# --- personal data ----------------------------------------------------------------------------------


@query(None)
def t8_pii_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document by kind; cards by their check digit."""
    found = bind.table(spark, sf_dir, "documents").select("doc_id", F.explode(privacy.findings("text")).alias("f"))
    return found.groupBy("doc_id", F.col("f.type").alias("type")).agg(F.count("*").alias("n"), F.min("f.start").alias("first"), F.max("f.end").alias("last"))


@query(None)
def t9_spliced_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = bind.table(spark, sf_dir, "documents").select("doc_id", privacy.redacted("text").alias("clean"))
    return clean.select("doc_id", F.sha2("clean", 256).alias("digest"))


@query(None)
def t22_safe_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = bind.table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    return privacy.safe_queries(turns, "conv_id", "turn").select("conv_id", F.size("queries").alias("n"), F.array_join("queries", "\n").alias("queries"))


# --- corpora ----------------------------------------------------------------------------------------

MODALITIES = ["vision", "voice", "multimodal", "smell"]
MANIFEST = f"""c AS (SELECT CASE WHEN p_partkey % 23 <> 0 THEN p_partkey // 2 END AS id, p_partkey AS row, {pick_sql(MODALITIES, 'p_partkey')} AS modality, CASE WHEN p_partkey % 7 <> 0 THEN 'asset' END AS asset, CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS category,
  CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS text FROM part)"""


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return bind.table(spark, sf_dir, "part").select(
        F.when(k % 23 != 0, F.floor(k / 2)).alias("id"), k.alias("row"), pick(MODALITIES, k).alias("modality"), F.when(k % 7 != 0, "asset").alias("asset"), F.when(k % 5 != 0, F.col("p_type")).alias("category"), F.when(k % 3 != 0, F.col("p_name")).alias("text")
    )


_ERRORS = {"MISSING_ID": "id IS NULL", "DUPLICATE_CASE_ID": "turn > 1", "INVALID_MODALITY": "modality NOT IN ('vision', 'voice', 'multimodal')", "MISSING_ASSET_REF": "asset IS NULL", "MISSING_CATEGORY": "modality = 'vision' AND category IS NULL"}
_WARNINGS = {"NO_TRANSCRIPT": "modality = 'voice' AND text IS NULL", "NO_TARGET": "modality = 'multimodal' AND text IS NULL"}


@query(f"WITH {MANIFEST}, n AS (SELECT *, CASE WHEN id IS NOT NULL THEN row_number() OVER (PARTITION BY id ORDER BY row) ELSE 1 END AS turn FROM c) SELECT row, {flags_sql(_ERRORS)} AS errors, {flags_sql(_WARNINGS)} AS warnings FROM n")
def f7_manifest_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and warnings of each case of a manifest; the first of equal ids is sound."""
    first = _manifest(spark, sf_dir).groupBy("id").agg(F.min("row").alias("first_row"))  # equal ids without a window over all null ids
    rows = _manifest(spark, sf_dir).join(first.filter("id is not null"), "id", "left")
    c = F.col
    again = c("id").isNotNull() & (c("row") != c("first_row"))
    bad = {
        "MISSING_ID": c("id").isNull(), "DUPLICATE_CASE_ID": again, "INVALID_MODALITY": ~c("modality").isin(*MODALITIES[:3]), "MISSING_ASSET_REF": c("asset").isNull(),
        "MISSING_CATEGORY": (c("modality") == "vision") & c("category").isNull(),
    }
    soft = {"NO_TRANSCRIPT": (c("modality") == "voice") & c("text").isNull(), "NO_TARGET": (c("modality") == "multimodal") & c("text").isNull()}
    return rows.select("row", F.array_join(policies_issues(bad), ",").alias("errors"), F.array_join(policies_issues(soft), ",").alias("warnings"))


def policies_issues(checks: dict[str, Column]) -> Column:
    from plumbline.operators.policies import issues

    return issues(checks)


@query(
    f"""WITH {MANIFEST}, i AS (SELECT modality, CASE WHEN modality = 'vision' AND category IS NULL THEN 'VISION_LABELS_EMPTY' WHEN modality = 'voice' AND text IS NULL THEN 'VOICE_TRANSCRIPT_EMPTY' WHEN modality = 'multimodal' AND text IS NULL THEN 'MULTIMODAL_TARGET_EMPTY' END AS blocking,
  CASE WHEN modality = 'multimodal' AND category IS NULL THEN 'MULTIMODAL_INTENT_EMPTY' END AS warning FROM c)
SELECT modality, count(*) AS cases, count(blocking) AS blocking, count(warning) AS warnings, count(blocking) = 0 AS usable FROM i GROUP BY modality"""
)
def f8_ground_truth_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    m = c("modality")
    blocking = ((m == "vision") & c("category").isNull()) | (m.isin("voice", "multimodal") & c("text").isNull())
    rows = _manifest(spark, sf_dir).groupBy("modality").agg(F.count("*").alias("cases"), F.count_if(blocking).alias("blocking"), F.count_if((m == "multimodal") & c("category").isNull()).alias("warnings"))
    return rows.withColumn("usable", c("blocking") == 0)


_CASE_ERRORS = {
    "INVALID_DIFFICULTY": "difficulty NOT IN ('easy', 'medium', 'hard', 'unknown')", "REVIEWER_REQUIRED": "status = 'reviewed' AND reviewer IS NULL", "REVIEW_REQUIRED_FOR_BENCHMARK": "status <> 'reviewed'",
    "CONSENT_REQUIRED_FOR_BENCHMARK": "NOT consent", "REDACTION_REQUIRED_FOR_BENCHMARK": "NOT redacted",
}
LEVELS, STATES = ["easy", "medium", "hard", "unknown", "odd"], ["draft", "submitted", "reviewed", "reviewed"]
CASES = f"""{bind.RECEIPTS}, q AS (SELECT receipt, subtotal, tax, discount, total, {pick_sql(LEVELS, 'receipt')} AS difficulty, {pick_sql(STATES, 'receipt // 5')} AS status, CASE WHEN receipt % 3 <> 0 THEN 'r' END AS reviewer, receipt % 8 <> 0 AS consent, receipt % 11 <> 0 AS redacted FROM r)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("receipt")
    return bind.receipts(spark, sf_dir).select(
        "receipt", "subtotal", "tax", "discount", "total", pick(LEVELS, k).alias("difficulty"), pick(STATES, F.floor(k / 5)).alias("status"), F.when(k % 3 != 0, "r").alias("reviewer"), (k % 8 != 0).alias("consent"), (k % 11 != 0).alias("redacted")
    )


@query(f"WITH {CASES} SELECT receipt, {flags_sql(_CASE_ERRORS)} AS errors, {flags_sql({'ARITHMETIC_GROUND_TRUTH_CONFLICT': 'abs(subtotal + tax - discount - total) > 2'})} AS warnings FROM q")
def f6_receipt_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipt cases under the strict rules."""
    c = F.col
    bad = {
        "INVALID_DIFFICULTY": ~c("difficulty").isin("easy", "medium", "hard", "unknown"), "REVIEWER_REQUIRED": (c("status") == "reviewed") & c("reviewer").isNull(), "REVIEW_REQUIRED_FOR_BENCHMARK": c("status") != "reviewed",
        "CONSENT_REQUIRED_FOR_BENCHMARK": ~c("consent"), "REDACTION_REQUIRED_FOR_BENCHMARK": ~c("redacted"),
    }
    off = F.abs(c("subtotal") + c("tax") - c("discount") - c("total")) > 2
    return _cases(spark, sf_dir).select("receipt", F.array_join(policies_issues(bad), ",").alias("errors"), F.array_join(policies_issues({"ARITHMETIC_GROUND_TRUTH_CONFLICT": off}), ",").alias("warnings"))


@query(
    f"""WITH {CASES}, s AS (SELECT *, CASE WHEN status = 'draft' THEN 'annotation' WHEN status = 'submitted' THEN 'review' WHEN reviewer IS NOT NULL AND consent AND redacted AND difficulty <> 'odd' THEN 'eligible' ELSE 'review' END AS stage FROM q)
SELECT stage, count(*) AS n, count(*) FILTER (stage = 'eligible') AS exported, min(receipt) AS first FROM s GROUP BY stage"""
)
def c4_annotation_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of the annotation workflow with its gates; only eligible cases are exported (C2)."""
    c = F.col
    sound = c("reviewer").isNotNull() & c("consent") & c("redacted") & (c("difficulty") != "odd")
    stage = F.when(c("status") == "draft", "annotation").when(c("status") == "submitted", "review").when(sound, "eligible").otherwise("review")
    return _cases(spark, sf_dir).groupBy(stage.alias("stage")).agg(F.count("*").alias("n"), F.count_if(stage == "eligible").alias("exported"), F.min("receipt").alias("first"))


@query(
    f"""WITH {CASES}, p AS (SELECT receipt, (subtotal > 0)::INT + (tax % 3 <> 0)::INT + (discount > 0)::INT + (total % 2 = 0)::INT AS confirmed, concat_ws(',', CASE WHEN subtotal <= 0 THEN 'subtotal' END, CASE WHEN tax % 3 = 0 THEN 'tax' END, CASE WHEN discount <= 0 THEN 'discount' END,
  CASE WHEN total % 2 <> 0 THEN 'total' END) AS unresolved FROM q) SELECT receipt, confirmed, {r('confirmed / 8')} AS ratio, unresolved FROM p"""
)
def a23_annotation_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed fields of eight, and which of the money fields are open."""
    c = F.col
    done = {"subtotal": c("subtotal") > 0, "tax": c("tax") % 3 != 0, "discount": c("discount") > 0, "total": c("total") % 2 == 0}
    n = sum((d.cast("int") for d in done.values()), F.lit(0))
    return _cases(spark, sf_dir).select("receipt", n.alias("confirmed"), fn.half_up(n / 8).alias("ratio"), F.array_join(policies_issues({k: ~d for k, d in done.items()}), ",").alias("unresolved"))


# fixed values: categories of a balanced picture corpus and their weights
WORLD = {
    "everyday_objects": 0.12, "products_models": 0.12, "plants_animals": 0.12, "devices_components": 0.12, "scenes_places": 0.10, "food_materials": 0.08, "vehicles_transport": 0.08, "signs_symbols": 0.08,
    "anomaly_visual": 0.10, "documents_receipts": 0.08,
}
_WORLD_LIST = [*list(WORLD)[:9], "documents_receipts", "unlisted"]


@query(
    f"""WITH w(category, weight) AS (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in WORLD.items())}), c AS (SELECT {pick_sql(_WORLD_LIST, 'p_partkey // 3')} AS category, p_retailprice / 2000 AS score FROM part),
g AS (SELECT w.category, weight, count(c.category) AS n, avg(score) AS score FROM w LEFT JOIN c USING (category) GROUP BY 1, 2)
SELECT category, n, {r('n / (SELECT count(*) FROM c)')} AS share, n = 0 AS missing, {r('(SELECT sum(score * weight) / sum(weight) FILTER (score IS NOT NULL) FROM g)')} AS world_score FROM g"""
)
def a20_world_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, shares and gaps of the categories, and the score weighted over those that have one."""
    dim = spark.createDataFrame(list(WORLD.items()), "category string, weight double")
    cases = bind.table(spark, sf_dir, "part").select(pick(_WORLD_LIST, F.floor(F.col("p_partkey") / 3)).alias("category"), (F.col("p_retailprice") / 2000).alias("score"))
    counted = cases.groupBy("category").agg(F.count("*").alias("n"), F.avg("score").alias("score"))
    joined = dim.join(F.broadcast(counted), "category", "left").fillna(0, ["n"])  # one row a category on both sides
    total = joined.agg((F.sum(F.col("score") * F.col("weight")) / F.sum(F.when(F.col("score").isNotNull(), F.col("weight")))).alias("world")).crossJoin(counted.agg(F.sum("n").alias("all")))
    return joined.crossJoin(F.broadcast(total)).select("category", "n", fn.half_up(F.col("n") / F.col("all")).alias("share"), (F.col("n") == 0).alias("missing"), fn.half_up(F.col("world")).alias("world_score"))


SCENES = ["identify_with_reference", "state_or_problem", "read_or_translate", "followup_reference", "unspecified"]
TONGUES = ["zh-CN", "yue", "es_MX", "en", "EN-us", "fr"]


@query(
    f"""WITH c AS (SELECT {pick_sql(SCENES, 'event_id')} AS scene, {pick_sql(TONGUES, 'user_id')} AS tongue, event_type = 'view' AS noisy FROM events),
f AS (SELECT scene, CASE WHEN split_part(replace(lower(tongue), '_', '-'), '-', 1) IN ('cmn', 'yue') THEN 'zh' ELSE split_part(replace(lower(tongue), '_', '-'), '-', 1) END AS family, noisy FROM c)
SELECT family, scene, count(*) AS n, count(*) FILTER (noisy) AS noisy, count(*) < 3 AS low FROM f GROUP BY 1, 2"""
)
def a21_corpus_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by language family (T12) and scene, those with noise, and which cells are too small."""
    rows = bind.table(spark, sf_dir, "events")
    base = F.split(F.lower(pick(TONGUES, F.col("user_id"))), "[-_]")[0]
    family = F.when(base.isin("cmn", "yue"), "zh").otherwise(base)
    return rows.groupBy(family.alias("family"), pick(SCENES, F.col("event_id")).alias("scene")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "view").alias("noisy")).withColumn("low", F.col("n") < 3)


@query(f"WITH {MANIFEST}, t(modality, need) AS (VALUES ('vision', 30), ('voice', 20), ('multimodal', 10)) SELECT t.modality, need, count(c.modality) AS have, count(c.modality) >= need AS ready FROM t LEFT JOIN c ON t.modality = c.modality AND c.asset IS NOT NULL GROUP BY 1, 2")
def a22_pilot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    need = spark.createDataFrame([("vision", 30), ("voice", 20), ("multimodal", 10)], "modality string, need int")
    have = _manifest(spark, sf_dir).filter("asset is not null").groupBy("modality").agg(F.count("*").alias("have"))
    return need.join(have, "modality", "left").fillna(0, ["have"]).withColumn("ready", F.col("have") >= F.col("need"))


_PARTS = {"intent": 0.25, "reference": 0.30, "target": 0.30, "state": 0.15}


@query(
    f"""WITH x AS (SELECT o_orderkey AS id, [CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderpriority) = lower(o_orderpriority) END, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus = 'F' END, CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 4 = 0 END, CASE WHEN o_custkey % 5 = 0 THEN false END] AS c FROM orders),
y AS (SELECT id, (c[1] IS NOT NULL)::INT * 0.25::DOUBLE + (c[2] IS NOT NULL)::INT * 0.30::DOUBLE + (c[3] IS NOT NULL)::INT * 0.30::DOUBLE + (c[4] IS NOT NULL)::INT * 0.15::DOUBLE AS w,
  coalesce(c[1], false)::INT * 0.25::DOUBLE + coalesce(c[2], false)::INT * 0.30::DOUBLE + coalesce(c[3], false)::INT * 0.30::DOUBLE + coalesce(c[4], false)::INT * 0.15::DOUBLE AS s FROM x)
SELECT id, CASE WHEN w > 0 THEN {r('s / w')} END AS score FROM y"""
)
def a25_grounding_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean over the parts that a case asks for."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    norm = lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
    pairs = {
        "intent": (F.when(k % 2 == 0, F.col("o_orderpriority")), F.concat(F.lit("  "), F.lower("o_orderpriority"))), "reference": (F.when(k % 3 == 0, F.lit("f")), F.col("o_orderstatus")),
        "target": (F.when(c % 2 == 0, F.lit("even")), F.when(c % 4 == 0, "even").otherwise("odd")), "state": (F.when(c % 5 == 0, F.lit("on")), F.lit("off")),
    }
    weight = sum((F.when(e.isNotNull(), w).otherwise(0.0) for (e, _), w in zip(pairs.values(), _PARTS.values(), strict=True)), F.lit(0.0))
    score = sum((F.when(norm(e) == norm(a), w).otherwise(0.0) for (e, a), w in zip(pairs.values(), _PARTS.values(), strict=True)), F.lit(0.0))
    return bind.table(spark, sf_dir, "orders").select(k.alias("id"), fn.half_up(F.try_divide(score, weight)).alias("score"))


@query(
    """WITH x AS (SELECT doc_id, 'img/' || doc_id AS image, sha256(coalesce(text, '')) AS digest, length(text) AS size FROM documents),
f AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'img/x' || doc_id ELSE image END AS path, digest, size FROM x WHERE doc_id % 6 <> 0)
SELECT x.image, f.path IS NOT NULL AS present, f.size, f.digest FROM x LEFT JOIN f ON x.image = f.path"""
)
def j2_package_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that a corpus names, with the file that is there."""
    docs = bind.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("img/"), "doc_id").alias("image"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.length("text").alias("size"))
    files = docs.filter("doc_id % 6 <> 0").select(F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("img/x"), "doc_id")).otherwise(F.col("image")).alias("image"), "digest", "size", F.lit(True).alias("there"))
    return docs.select("image").join(files, "image", "left").select("image", F.coalesce("there", F.lit(False)).alias("present"), "size", "digest")


@query(
    f"""WITH {bind.BENCH}, p AS (SELECT s_suppkey AS provider, 'e' || (s_suppkey % 7) AS engine, s_acctbal > 5000 AS heavy FROM supplier), g AS (SELECT engine, avg(quality) AS q, avg(ok::INT) AS s, count(*) AS n FROM b GROUP BY 1),
j AS (SELECT provider, heavy, n, {r('0.6::DOUBLE * q + 0.4::DOUBLE * s')} AS score FROM p LEFT JOIN g USING (engine))
SELECT provider, coalesce(n, 0) AS runs, score, CASE WHEN heavy THEN 'avoid_heavy' WHEN score IS NULL THEN 'unknown' WHEN score >= 0.85 THEN 'preferred' WHEN score >= 0.6 THEN 'usable' ELSE 'avoid' END AS recommendation FROM j"""
)
def j9_provider_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Providers with what their engine measured, and whether to use them (F11)."""
    measured = bind.bench_rows(spark, sf_dir).groupBy("engine").agg(F.avg("quality").alias("q"), F.avg(F.col("ok").cast("int")).alias("s"), F.count("*").alias("n"))
    providers = bind.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("provider"), F.concat(F.lit("e"), F.col("s_suppkey") % 7).alias("engine"), (F.col("s_acctbal") > 5000).alias("heavy"))
    rows = providers.join(measured, "engine", "left").withColumn("score", fn.half_up(0.6 * F.col("q") + 0.4 * F.col("s")))
    advice = F.when(F.col("heavy"), "avoid_heavy").when(F.col("score").isNull(), "unknown").when(F.col("score") >= 0.85, "preferred").when(F.col("score") >= 0.6, "usable").otherwise("avoid")
    return rows.select("provider", F.coalesce("n", F.lit(0)).alias("runs"), "score", advice.alias("recommendation"))


@query(
    f"""WITH c AS (SELECT l_orderkey AS obs, l_quantity::INT % 3 AS value, l_returnflag AS modality, max(l_discount) * 10 AS sure FROM lineitem GROUP BY 1, 2, 3),
v AS (SELECT obs, value, count(*) AS modalities, sum(sure) AS support FROM c GROUP BY 1, 2), t AS (SELECT obs, sum(support) AS total FROM v GROUP BY 1)
SELECT v.obs, value, modalities, {r('support')} AS support, {r('total - support')} AS oppose, modalities >= 2 AND {r('2 * support - total')} >= 1.2 AS verified FROM v JOIN t USING (obs)"""
)
def j16_modal_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that several kinds of observation support, against those that oppose them."""
    seen = bind.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("obs"), (F.col("l_quantity").cast("int") % 3).alias("value"), F.col("l_returnflag").alias("modality"), F.col("l_discount").alias("d"))
    best = seen.groupBy("obs", "value", "modality").agg((F.max("d") * 10).alias("sure"))
    by_value = best.groupBy("obs", "value").agg(F.count("*").alias("modalities"), F.sum("sure").alias("support"))
    total = by_value.groupBy("obs").agg(F.sum("support").alias("total"))
    s, t = F.col("support"), F.col("total")
    return by_value.join(total, "obs").select("obs", "value", "modalities", fn.half_up(s).alias("support"), fn.half_up(t - s).alias("oppose"), ((F.col("modalities") >= 2) & (fn.half_up(2 * s - t) >= 1.2)).alias("verified"))
