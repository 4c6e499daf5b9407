"""Plans of tasks from templates, and checks of proposed plans: millions of small graphs at once.

A task's words choose a template, whose steps are joined to it. A proposal is one row with its jobs; its checks, cycles included, are
expressions on that row, so one job serves any number of proposals and no round walks over all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: words by which a task needs a plan, and those that choose its template
NEEDS_PLAN = r"(?i)troubleshoot|repair|diagnos|compare|research|shopping|manual|maintenance|故障|维修|诊断|比较|研究|配件|说明书|保养|哪里买"
KINDS = [("troubleshooting", r"(?i)troubleshoot|repair|diagnos|维修|故障|诊断"), ("comparison", r"(?i)compare|shopping|价格|哪里买|购买|配件"), ("manual", r"(?i)manual|说明书")]
# fixed values: steps of the templates: step, type, steps before it, whether it is optional
TEMPLATES = {
    "answer": [("answer", "resolve_task", [], False)],
    "troubleshooting": [
        ("identify", "identify_entity", [], False), ("manual", "retrieve_primary_manual", ["identify"], False), ("diagnose", "generate_diagnosis", ["identify", "manual"], False), ("verify", "verify_diagnosis", ["diagnose"], False),
        ("solution", "recommend_solution", ["verify"], False), ("parts", "identify_parts", ["solution"], True), ("prices", "search_current_prices", ["parts"], True), ("final", "final_recommendation", ["solution", "prices"], False),
    ],
    "comparison": [
        ("identify", "identify_entity", [], False), ("specs", "retrieve_specifications", ["identify"], False), ("prices", "search_current_prices", ["identify"], False), ("compare", "compare_options", ["specs", "prices"], False),
        ("final", "final_recommendation", ["compare"], False),
    ],
    "manual": [("identify", "identify_entity", [], False), ("manual", "retrieve_primary_manual", ["identify"], False), ("final", "explain_manual", ["manual"], False)],
    "research": [("scope", "clarify_research_scope", [], False), ("search", "retrieve_evidence", ["scope"], False), ("synthesize", "synthesize_evidence", ["search"], False), ("final", "final_answer", ["synthesize"], False)],
}
# fixed values: capabilities that put a step into a composed plan
COMPOSED = {"identify": ["identify", "product_understanding", "food_understanding", "document_understanding"], "read": ["ocr", "read_text"], "translate": ["translate"], "search": ["search", "retrieve_current_info"], "compare": ["compare"]}
STEP_TYPES = {"identify": "identify_entity", "read": "capability_step", "translate": "capability_step", "search": "retrieve_evidence", "compare": "compare_options"}
FEW_CAPABILITIES, MAX_JOBS = 2, 5
_STEPS = "array<struct<step:string,type:string,dependencies:array<string>,optional:boolean>>"


def template_of(text: Column, capabilities: Column, required: Column) -> Column:
    """The template of a task by its type and words; ``composed`` for many capabilities and no telling words."""
    many = F.size(F.array_distinct(F.coalesce(capabilities, F.array().cast("array<string>")))) > FEW_CAPABILITIES
    told = F.coalesce(*[F.when(text.rlike(pattern), F.lit(kind)) for kind, pattern in KINDS])
    needed = F.coalesce(required, F.lit(False)) | many | text.rlike(NEEDS_PLAN)
    return F.when(~needed, "answer").when(told.isNotNull(), told).when(many, "composed").otherwise("research")


def composed_steps(capabilities: Column) -> Column:
    """Steps for the capabilities that are wanted; the final one waits for all that nothing else waits for."""
    on = {step: F.arrays_overlap(capabilities, F.lit(names)) for step, names in COMPOSED.items()}
    given = lambda *steps: F.array_compact(F.array(*[F.when(on[s], F.lit(s)) for s in steps]))
    before = {"identify": given(), "read": given(), "translate": given("read"), "search": given("identify"), "compare": given("identify", "search", "translate")}
    step = lambda name, kind, deps: F.struct(F.lit(name).alias("step"), F.lit(kind).alias("type"), deps.cast("array<string>").alias("dependencies"), F.lit(False).alias("optional"))
    steps = F.array_compact(F.array(*[F.when(on[s], step(s, STEP_TYPES[s], before[s])) for s in COMPOSED]))
    loose = F.array_except(F.transform(steps, lambda s: s["step"]), F.flatten(F.transform(steps, lambda s: s["dependencies"])))
    return F.concat(steps, F.array(step("final", "final_answer", loose)))


def planned(tasks: DataFrame, key: str) -> DataFrame:
    """``(key, template, place, step, type, dependencies, optional)`` of tasks ``(key, type, intent, capabilities, plan_required)``."""
    text = F.concat_ws(" ", F.coalesce("type", F.lit("")), F.coalesce("intent", F.lit("")))
    chosen = tasks.select(key, F.array_distinct(F.coalesce("capabilities", F.array().cast("array<string>"))).alias("capabilities"), template_of(text, F.col("capabilities"), F.col("plan_required")).alias("template"))
    known = tasks.sparkSession.createDataFrame(list(TEMPLATES.items()), f"template string, steps {_STEPS}")
    joined = chosen.join(F.broadcast(known), "template", "left")  # five rows
    steps = F.when(F.col("template") == "composed", composed_steps(F.col("capabilities")).cast(_STEPS)).otherwise(F.col("steps"))
    return joined.select(key, "template", F.posexplode(steps).alias("place", "s")).select(key, "template", "place", "s.*")


def _cyclic(jobs: Column) -> Column:
    """Whether jobs ``(id, depends_on)`` wait for each other in a circle: jobs that wait for none of the rest leave, round by round."""
    last = F.filter(jobs, lambda j, i: ~F.exists(F.slice(jobs, i + 2, F.size(jobs)), lambda k: k["id"] == j["id"]))

    def leave(rest: Column, _: Column) -> Column:
        ids = F.transform(rest, lambda j: j["id"])
        return F.filter(rest, lambda j: F.arrays_overlap(j["depends_on"], ids))

    return (F.size(jobs) > 0) & (F.size(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(jobs), F.lit(1))), last, leave)) > 0)


def proposal_errors(jobs: Column, completed: Column, allowed: Column | None = None, most: int = MAX_JOBS) -> Column:
    """What is wrong with a plan of jobs ``(id, depends_on, capabilities)``, of which the first ``most`` count; empty: accepted."""
    jobs = F.slice(F.coalesce(jobs, F.array()), 1, most)
    ids = F.transform(jobs, lambda j: j["id"])

    def job(j: Column) -> Column:
        told = lambda on, code: F.when(F.coalesce(on, F.lit(False)), F.concat(F.lit(f"{code}:"), j["id"]))
        found = [
            told(F.size(F.array_except(j["depends_on"], ids)) > 0, "UNKNOWN_DEPENDENCY"), told(F.array_contains(j["depends_on"], j["id"]), "SELF_DEPENDENCY"), told(F.array_contains(completed, j["id"]), "REDO_COMPLETED_WORK"),
        ]
        if allowed is not None:
            found.append(told(F.size(F.array_except(j["capabilities"], allowed)) > 0, "CAPABILITY_NOT_ALLOWED"))
        return F.array_compact(F.array(*found))

    whole = F.array_compact(F.array(F.when(F.size(jobs) == 0, "EMPTY_PLAN"), F.when(F.size(F.array_distinct(ids)) != F.size(ids), "DUPLICATE_JOB_ID")))
    return F.concat(whole, F.flatten(F.transform(jobs, job)), F.array_compact(F.array(F.when(_cyclic(jobs), "CYCLIC_PLAN"))))
