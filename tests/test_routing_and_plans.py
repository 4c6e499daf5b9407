"""Normalised records, grounded references, plans and decisions in known cases."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from plumbline.operators import grounding, machine, normalise, routing, task_plans, timeline


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


REGION = "picture int, region string, x double, y double, w double, h double, is_object boolean, confidence double, tags array<string>"


def ground(spark, regions, kinds):
    refs = spark.createDataFrame([(1, k, t) for k, t in enumerate(kinds)], "picture int, reference int, term string")
    rows = grounding.grounded(refs, spark.createDataFrame([(1, *r) for r in regions], REGION), "picture").collect()
    return [(r.status, r.region) for r in sorted(rows, key=lambda r: r.reference)]


def test_references_find_unique_regions(spark):
    code = ("b2", 0.7, 0.125, 0.1, 0.06, False, 0.95, ["error_code"])
    name = ("b1", 0.1, 0.125, 0.2, 0.06, False, 0.95, [])
    light = ("led1", 0.72, 0.18, 0.05, 0.05, True, 0.95, ["indicator", "color:red"])
    assert ground(spark, [name, code], ["displayed_code", "this_region", "red_indicator"]) == [("resolved", "b2"), ("unresolved", None), ("unresolved", None)]
    assert ground(spark, [("b1", 0.76, 0.125, 0.08, 0.05, False, 0.95, [])], ["right_side"]) == [("tentative", "b1")]
    assert ground(spark, [light, name], ["red_indicator", "green_indicator"]) == [("resolved", "led1"), ("unresolved", None)]
    row = [(f"o{k}", 0.1 + 0.3 * k, 0.5, 0.1, 0.1, True, 0.9, []) for k in (2, 0, 1)]
    assert ground(spark, row, ["ordinal_1", "ordinal_3", "ordinal_4"]) == [("resolved", "o0"), ("resolved", "o2"), ("unresolved", None)]
    assert ground(spark, [("a", 0.1, 0.1, 0.1, 0.1, True, 0.9, []), ("b", 0.12, 0.13, 0.1, 0.1, True, 0.9, [])], ["ordinal_1"]) == [("unresolved", None)]


def slow_cycle(jobs):
    last = {j["id"]: j["depends_on"] for j in jobs}
    seen, stack = set(), set()

    def visit(k):
        if k in stack:
            return True
        if k in seen:
            return False
        seen.add(k)
        stack.add(k)
        found = any(visit(d) for d in last.get(k, []))
        stack.discard(k)
        return found

    return any(visit(k) for k in last)


def test_proposals_against_a_depth_first_walk(spark):
    rng = random.Random(1)
    rows = []
    for k in range(400):
        names = [f"j{n}" for n in range(rng.choice([0, 1, 3, 5, 5, 7]))]
        rows.append((k, [{"id": rng.choice(names) if rng.random() < 0.1 else n, "depends_on": list({rng.choice([*names, "zz"]) for _ in range(rng.choice([0, 1, 1, 2]))}), "capabilities": [rng.choice(["search", "magic"])] if rng.random() < 0.1 else []} for n in names]))
    df = spark.createDataFrame(rows, "k int, jobs array<struct<id:string,depends_on:array<string>,capabilities:array<string>>>")
    got = {r.k: r.e for r in df.select("k", task_plans.proposal_errors(F.col("jobs"), F.array(F.lit("j4")), F.array(F.lit("search"))).alias("e")).collect()}
    cyclic = 0
    for k, jobs in rows:
        jobs = jobs[:5]
        ids = [j["id"] for j in jobs]
        want = ["EMPTY_PLAN"] * (not jobs) + ["DUPLICATE_JOB_ID"] * (len(set(ids)) < len(ids))
        for j in jobs:
            want += [f"UNKNOWN_DEPENDENCY:{j['id']}"] * (not set(j["depends_on"]) <= set(ids)) + [f"SELF_DEPENDENCY:{j['id']}"] * (j["id"] in j["depends_on"]) + [f"REDO_COMPLETED_WORK:{j['id']}"] * (j["id"] == "j4")
            want += [f"CAPABILITY_NOT_ALLOWED:{j['id']}"] * ("magic" in j["capabilities"])
        cyclic += slow_cycle(jobs)
        assert got[k] == want + ["CYCLIC_PLAN"] * slow_cycle(jobs)
    assert cyclic > 30


def test_plans_of_tasks(spark):
    tasks = [(1, "qa", "解释", []), (2, "", "diagnose the pump", ["a", "b", "c"]), (3, "", "help", ["ocr", "translate", "compare"]), (4, "manual_lookup", "找设备说明书", None), (5, "", "maintenance", ["a"]), (6, None, None, None)]
    df = spark.createDataFrame([(*t, None) for t in tasks], "k int, type string, intent string, capabilities array<string>, plan_required boolean")
    plans = {}
    for r in task_plans.planned(df, "k").orderBy("k", "place").collect():
        plans.setdefault(r.k, (r.template, []))[1].append((r.step, tuple(r.dependencies)))
    assert {k: v[0] for k, v in plans.items()} == {1: "answer", 2: "troubleshooting", 3: "composed", 4: "manual", 5: "research", 6: "answer"}
    assert plans[3][1] == [("read", ()), ("translate", ("read",)), ("compare", ("translate",)), ("final", ("compare",))]
    assert plans[2][1][-1] == ("final", ("solution", "prices"))


def test_machine_by_stretches_equals_a_loop(spark):
    rng = random.Random(2)
    toy = machine.Machine.of(["a", "b", "c"], ["x", "y"], lambda m, s: ({"a": "b", "b": "c", "c": "c"}[s], 1) if m == "x" else ("a" if s == "c" else s, 0))
    events = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(9)}", n, rng.randrange(2)) for n in range(600)]
    want, now = {}, {}
    for key, n, move in events:
        state, gain = now.get(key, ("a", 0))
        after = ({"a": "b", "b": "c", "c": "c"}[state], 1) if move == 0 else ("a" if state == "c" else state, 0)
        want[n], now[key] = (state, after[0], after[1]), (after[0], gain + after[1])
    df = spark.createDataFrame(events, "key string, n int, move int").repartition(5)
    for width in (1, 37, 1000):
        args = (df, toy, "key", "n", F.floor(F.col("n") / width), F.col("move"))
        assert {r.n: (r.came_from, r.state, r.gain) for r in machine.stepped(*args).collect()} == want
        assert {r.key: (r.state, r.gain) for r in machine.final_states(*args).collect()} == now


def test_exclusive_time_of_split_traces(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else f"t{rng.randrange(9)}", k, s := rng.randrange(1000), s + rng.choice([0, 1, 5, 40, 300, 900])) for k in range(500)]
    want = {}
    for t, k, s, e in rows:
        inside = sorted((a, b) for u, j, a, b in rows if u == t and j != k and a >= s and b <= e and (b - a < e - s or (b - a == e - s and j > k)))
        covered, reach = 0, s
        for a, b in inside:
            covered, reach = covered + max(0, b - max(a, reach)), max(reach, b)
        want[k] = (e - s - covered, bool(inside))
    df = spark.createDataFrame(rows, "trace string, span long, start long, end long")
    for size in (15, 2000):
        assert {r.span: (r.exclusive, r.has_nested) for r in timeline.exclusive_time(df, stretch_spans=size).collect()} == want
    assert timeline.exclusive_time(df.limit(0)).count() == 0


def test_normal_records(spark):
    assert one(spark, normalise.money(F.lit(10800), F.lit("XXX"))) == "$108.00"
    assert one(spark, normalise.money(F.lit(-5), F.lit("mxn"))) == "-MX$0.05"
    assert one(spark, normalise.money(F.lit(None).cast("long"), F.lit("USD"))) == "null"
    assert one(spark, normalise.visual_labels(F.array(F.lit(" a "), F.lit("b")), F.array(F.lit("a"), F.lit("")), F.lit(None).cast("array<string>"))) == ["a", "b"]
    assert one(spark, normalise.same_intent(F.lit("Fix-it!"), F.lit(" fix  it"))) == 1
    assert one(spark, normalise.sure(F.lit(float("nan")))) == 0.0 and one(spark, normalise.sure(F.lit(7.0))) == 1.0
    truth = spark.createDataFrame([(1, '{"total": 5, "fields": {"date": {"value": null}, "tax": [1]}}'), (2, None)], "k int, doc string")
    got = {(r.k, r.field): (r.value, r.status) for r in normalise.ground_truth(truth, "k", "doc").collect()}
    assert got[1, "total"] == ("5", "confirmed") and got[1, "date"] == (None, "confirmed") and got[1, "cash"] == (None, "unresolved") and got[2, "total"] == (None, "unresolved") and got[1, "tax"][1] == "confirmed"


def test_next_visual_evidence(spark):
    names = lambda *xs: F.lit(list(xs))
    assert one(spark, routing.next_evidence(names("scene_context", "specific_identity"))).target == "identity_marker"
    assert one(spark, routing.next_evidence(names("unheard_of"))) is None
    plan = one(spark, routing.vision_recovery(names("blurry_or_low_detail"), names("object_identity"), F.lit(0.4), F.lit(1), F.lit(True), F.lit(True)))
    assert plan.escalate and plan.actions == ["RECAPTURE:steadier_and_closer", "RECAPTURE:whole_object", "TEACHER:external"]
