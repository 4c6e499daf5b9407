"""Queries of grounded references, plans and their proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scalars as fn
from plumbline.operators import grounding, task_plans
from plumbline.plans.policy_queries import pick, pick_sql
from plumbline.plans.registry import query, r
from plumbline.sources import bindings as bind

KINDS = ["right_side", "left_side", "upper_area", "lower_area", "displayed_code", "red_indicator", "green_indicator", "this_object", "this_region", "ordinal_1", "ordinal_2", "ordinal_4"]

REGIONS_SQL = f"""g AS (SELECT l_orderkey AS p, l_linenumber AS region, CASE WHEN l_orderkey % 3 = 0 THEN l_linenumber / 8 ELSE l_partkey % 90 / 100 END AS x, CASE WHEN l_orderkey % 3 = 1 THEN l_linenumber / 8 ELSE 0.4 + l_orderkey % 3 / 10 END AS y, 0.1::DOUBLE AS w, 0.06::DOUBLE AS h,
  l_suppkey % 3 > 0 AS obj, 0.5 + l_quantity / 100 AS confidence, l_suppkey % 5 = 0 AS code, l_suppkey % 4 = 0 AS num, l_partkey % 6 = 0 AS light, l_partkey % 4 = 0 AS red, l_partkey % 4 = 1 AS green FROM lineitem),
c AS (SELECT *, x + w / 2 AS cx, y + h / 2 AS cy, greatest(0.65::DOUBLE, confidence) AS sure FROM g),
t AS (SELECT p, region, confidence, sure, unnest([{{'t': 'right_side', 's': CASE WHEN cx >= 0.6::DOUBLE THEN 0.78::DOUBLE WHEN cx >= 0.5::DOUBLE THEN 0.45::DOUBLE END}}, {{'t': 'left_side', 's': CASE WHEN cx <= 0.4::DOUBLE THEN 0.78::DOUBLE WHEN cx <= 0.5::DOUBLE THEN 0.45::DOUBLE END}},
  {{'t': 'lower_area', 's': CASE WHEN cy >= 0.6::DOUBLE THEN 0.78::DOUBLE WHEN cy >= 0.5::DOUBLE THEN 0.45::DOUBLE END}}, {{'t': 'upper_area', 's': CASE WHEN cy <= 0.4::DOUBLE THEN 0.78::DOUBLE WHEN cy <= 0.5::DOUBLE THEN 0.45::DOUBLE END}},
  {{'t': 'displayed_code', 's': CASE WHEN code THEN 0.9::DOUBLE WHEN num THEN 0.66::DOUBLE END}}, {{'t': 'red_indicator', 's': light::INT * 0.55::DOUBLE + red::INT * 0.45::DOUBLE}}, {{'t': 'green_indicator', 's': light::INT * 0.55::DOUBLE + green::INT * 0.45::DOUBLE}}, {{'t': 'this_object', 's': CASE WHEN obj THEN 0.65::DOUBLE END}}]) AS e FROM c),
d AS (SELECT p, count(*) AS n, max(cx) - min(cx) AS dx, max(cy) - min(cy) AS dy, avg(w) AS aw, avg(h) AS ah FROM c WHERE obj GROUP BY p),
x AS (SELECT p, CASE WHEN n < 2 THEN NULL WHEN dx >= greatest(0.08::DOUBLE, aw) AND dx >= dy * 1.6::DOUBLE THEN 'x' WHEN dy >= greatest(0.08::DOUBLE, ah) AND dy >= dx * 1.6::DOUBLE THEN 'y' END AS axis FROM d),
o AS (SELECT c.p, region, confidence, row_number() OVER (PARTITION BY c.p ORDER BY CASE axis WHEN 'x' THEN cx ELSE cy END, region) AS k FROM c JOIN x ON c.p = x.p WHERE obj AND axis IS NOT NULL),
s AS (SELECT p, region, confidence, e.t AS term, least(1.0::DOUBLE, e.s * sure) AS score FROM t WHERE e.s > 0 UNION ALL SELECT p, region, confidence, 'ordinal_' || k, 0.92::DOUBLE FROM o WHERE k <= 9),
q AS (SELECT conv_id * 8 + turn AS reference, conv_id * 8 + turn AS p, {pick_sql(KINDS, 'conv_id * 5 + turn')} AS term FROM conversations),
m AS (SELECT reference, q.term, region, score, row_number() OVER (PARTITION BY reference ORDER BY score DESC NULLS LAST, confidence DESC, region) AS k, lead(score) OVER (PARTITION BY reference ORDER BY score DESC NULLS LAST, confidence DESC, region) AS second FROM q LEFT JOIN s ON q.p = s.p AND q.term = s.term),
z AS (SELECT *, CASE WHEN score >= 0.8::DOUBLE AND (second IS NULL OR score - second >= 0.2::DOUBLE) THEN 'resolved' WHEN score >= 0.6::DOUBLE AND (second IS NULL OR score - second >= 0.25::DOUBLE) THEN 'tentative' ELSE 'unresolved' END AS status FROM m WHERE k = 1)"""


@query(
    f"""WITH {REGIONS_SQL} SELECT reference, term, status, CASE WHEN status <> 'unresolved' THEN region END AS region, {r("CASE status WHEN 'resolved' THEN least(0.98::DOUBLE, score) WHEN 'tentative' THEN least(0.78::DOUBLE, score) ELSE 0.0::DOUBLE END")} AS confidence,
  CASE WHEN score IS NULL THEN 'NO_REGION_EVIDENCE' WHEN status = 'resolved' THEN 'UNIQUE_REGION_EVIDENCE' WHEN status = 'tentative' THEN 'AMBIGUOUS_BUT_PLAUSIBLE' ELSE 'AMBIGUOUS_REGION_EVIDENCE' END AS reason FROM z"""
)
def j13_grounded_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as references into the regions of a picture, an order's lines."""
    k, n, part, supp = (F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    tags = F.array_compact(F.array(F.when(supp % 5 == 0, "error_code"), F.when(supp % 4 == 0, "number_or_code"), F.when(part % 6 == 0, "indicator"), F.when(part % 4 == 0, "color:red"), F.when(part % 4 == 1, "color:green")))
    regions = bind.table(spark, sf_dir, "lineitem").select(
        k.alias("picture"), n.alias("region"), F.when(k % 3 == 0, n / 8).otherwise(part % 90 / 100).alias("x"), F.when(k % 3 == 1, n / 8).otherwise(0.4 + k % 3 / 10).alias("y"), F.lit(0.1).alias("w"), F.lit(0.06).alias("h"),
        (supp % 3 > 0).alias("is_object"), (0.5 + F.col("l_quantity") / 100).alias("confidence"), tags.alias("tags"),
    )
    at = F.col("conv_id") * 8 + F.col("turn")
    references = bind.table(spark, sf_dir, "conversations").select(at.alias("picture"), at.alias("reference"), pick(KINDS, F.col("conv_id") * 5 + F.col("turn")).alias("term"))
    found = grounding.grounded(references, regions, "picture")
    return found.select("reference", "term", "status", "region", fn.half_up(F.col("confidence")).alias("confidence"), "reason")


# --- plans -------------------------------------------------------------------------------------------

ASKED = ["repair", "compare", "read the manual of", "maintenance of", "what is", "价格"]
ABLE = [["ocr", "translate", "search"], ["identify"], ["product_understanding", "compare", "retrieve_current_info", "translate"], ["ocr", "ocr", "search"]]
_PLAN_OF = {"repair": "troubleshooting", "compare": "comparison", "read the manual of": "manual", "maintenance of": "research", "价格": "comparison"}


def _steps_sql() -> str:
    rows = [(t, k, s, kind, ",".join(deps)) for t, steps in task_plans.TEMPLATES.items() for k, (s, kind, deps, _) in enumerate(steps)]
    rows += [("c0", 0, "read", "capability_step", ""), ("c0", 1, "translate", "capability_step", "read"), ("c0", 2, "search", "retrieve_evidence", ""), ("c0", 3, "final", "final_answer", "translate,search")]
    rows += [("c2", 0, "identify", "identify_entity", ""), ("c2", 1, "translate", "capability_step", ""), ("c2", 2, "search", "retrieve_evidence", "identify"), ("c2", 3, "compare", "compare_options", "identify,search,translate"), ("c2", 4, "final", "final_answer", "compare")]
    return ", ".join(f"('{t}', {k}, '{s}', '{kind}', '{deps}')" for t, k, s, kind, deps in rows)


@query(
    f"""WITH a AS (SELECT p_partkey AS task, {pick_sql(ASKED, 'p_partkey')} AS said, p_partkey // 7 % 4 AS c FROM part),
b AS (SELECT task, c, CASE WHEN said IN ('repair', 'compare', 'read the manual of') OR (said = '价格' AND c IN (0, 2)) THEN CASE said {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _PLAN_OF.items())} END
  WHEN c IN (0, 2) THEN 'c' || c WHEN said = 'maintenance of' THEN 'research' ELSE 'answer' END AS plan FROM a), s(plan, place, step, type, dependencies) AS (VALUES {_steps_sql()})
SELECT task, CASE WHEN plan IN ('c0', 'c2') THEN 'composed' ELSE plan END AS template, place, step, type, dependencies FROM b JOIN s USING (plan)"""
)
def n6_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about parts, by their words and the capabilities that they need, as steps of plans."""
    k = F.col("p_partkey")
    able = F.element_at(F.array(*[F.lit(a) for a in ABLE]), (F.floor(k / 7) % 4 + 1).cast("int"))
    tasks = bind.table(spark, sf_dir, "part").select(k.alias("task"), F.lit("question").alias("type"), F.concat_ws(" ", pick(ASKED, k), "p_name").alias("intent"), able.alias("capabilities"), F.lit(None).cast("boolean").alias("plan_required"))
    return task_plans.planned(tasks, "task").select("task", "template", "place", "step", "type", F.array_join("dependencies", ",").alias("dependencies"))


@query(
    """WITH RECURSIVE l AS (SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, l_partkey, l_suppkey FROM lineitem),
j AS MATERIALIZED (SELECT g, n, CASE WHEN l_suppkey % 17 = 0 THEN 'j1' ELSE 'j' || n END AS id, list_distinct([CASE WHEN n > 1 THEN 'j' || (n - 1) END, CASE WHEN l_partkey % 13 = 0 THEN 'j' || (n + 1) END, CASE WHEN l_partkey % 31 = 0 THEN 'zz' END, CASE WHEN l_suppkey % 29 = 0 THEN 'j' || n END]) AS deps,
  l_partkey % 23 = 0 AS odd FROM l WHERE n <= 5),
d AS (SELECT g, n, id, unnest(deps) AS dep, odd FROM j), ids AS (SELECT DISTINCT g, id FROM j),
lastly AS (SELECT g, id, max(n) AS n FROM j GROUP BY ALL), e AS (SELECT DISTINCT d.g, d.id, d.dep FROM d JOIN lastly USING (g, id, n) JOIN ids ON ids.g = d.g AND ids.id = d.dep WHERE dep IS NOT NULL),
w(g, a, b) AS (SELECT g, id, dep FROM e UNION SELECT w.g, w.a, e.dep FROM w JOIN e ON e.g = w.g AND e.id = w.b), cyclic AS (SELECT DISTINCT g FROM w WHERE a = b),
u AS (SELECT g, n, 1 AS o, 'UNKNOWN_DEPENDENCY:' || id AS x FROM (SELECT DISTINCT d.g, n, d.id FROM d LEFT JOIN ids ON ids.g = d.g AND ids.id = d.dep WHERE dep IS NOT NULL AND ids.id IS NULL)
  UNION ALL SELECT DISTINCT g, n, 2, 'SELF_DEPENDENCY:' || id FROM d WHERE dep = id UNION ALL SELECT g, n, 3, 'REDO_COMPLETED_WORK:' || id FROM j WHERE id = 'j4' AND g % 9 = 0 UNION ALL SELECT g, n, 4, 'CAPABILITY_NOT_ALLOWED:' || id FROM j WHERE odd
  UNION ALL SELECT g, 0, 0, 'DUPLICATE_JOB_ID' FROM j GROUP BY g HAVING count(*) > count(DISTINCT id) UNION ALL SELECT g, 99, 9, 'CYCLIC_PLAN' FROM cyclic),
s AS (SELECT g, string_agg(x, ',' ORDER BY n, o) AS errors FROM u GROUP BY g)
SELECT g AS proposal, coalesce(errors, '') AS errors, errors IS NULL AS accepted FROM (SELECT DISTINCT g FROM j) LEFT JOIN s USING (g)"""
)
def g24_checked_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as proposed plans whose jobs are their lines."""
    lines = bind.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("proposal")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("lines"))

    def job(line, k):
        name = lambda n: F.concat(F.lit("j"), n.cast("string"))
        part, supp, n = line["l_partkey"], line["l_suppkey"], k + 1
        deps = F.array(F.when(n > 1, name(n - 1)), F.when(part % 13 == 0, name(n + 1)), F.when(part % 31 == 0, "zz"), F.when(supp % 29 == 0, name(n)))
        return F.struct(F.when(supp % 17 == 0, "j1").otherwise(name(n)).alias("id"), F.array_distinct(F.array_compact(deps)).alias("depends_on"), F.when(part % 23 == 0, F.array(F.lit("magic"))).otherwise(F.array(F.lit("search"))).alias("capabilities"))

    done = F.when(F.col("proposal") % 9 == 0, F.array(F.lit("j4"))).otherwise(F.array().cast("array<string>"))
    errors = task_plans.proposal_errors(F.col("jobs"), F.col("done"), F.array(F.lit("search"), F.lit("reasoning")))
    checked = lines.select("proposal", F.transform("lines", job).alias("jobs"), done.alias("done")).select("proposal", errors.alias("e"))
    return checked.select("proposal", F.array_join("e", ",").alias("errors"), (F.size("e") == 0).alias("accepted"))
