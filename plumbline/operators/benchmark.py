"""Benchmark rows to summaries, comparisons, gates and rankings.

Rows: ``session, engine, scenario, device, ok, latency_ms, first_useful_ms, memory_mb, quality, recorded_at, seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.scalars import clamp, composite_score, half_up


BINS = 4096


def lower_percentiles(df: DataFrame, keys: list[str], metrics: dict[str, tuple[Column, float]], nearest: bool = False) -> DataFrame:
    """For each key group, of each named column the sorted non-null value at index ``floor((n - 1) p)``, or at the nearest rank ``ceil(n p) - 1``.

    A coarse histogram (``BINS`` bins between a group's least and greatest value) says in which bin that value lies; only the values
    of that bin are counted one by one and put in order. What is shuffled are histograms and one bin a group, not the values.
    """
    named = F.array(*[F.struct(F.lit(name).alias("metric"), column.cast("double").alias("value")) for name, (column, _) in metrics.items()])
    share = F.create_map(*[F.lit(x) for name, (_, p) in metrics.items() for x in (name, p)])
    group = [*keys, "metric"]
    values = df.select(*keys, F.explode(named).alias("m")).select(*keys, "m.*").filter("value is not null")
    ends = values.groupBy(*group).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("total"))
    part = F.coalesce(F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    same = [F.col(f"v.{k}").eqNullSafe(F.col(f"e.{k}")) for k in group]
    on = same[0]
    for c in same[1:]:
        on &= c
    binned = values.alias("v").join(ends.alias("e"), on).select("v.*", "low", "high", "total").withColumn("bin", F.least(F.lit(BINS - 1), F.floor(part * BINS)).cast("int"))
    counts = binned.groupBy(*group, "bin").agg(F.count("*").alias("n"), F.first("total").alias("total"))
    p = share[F.col("metric")]
    wanted = (F.ceil(F.col("total") * p) - 1 if nearest else F.floor((F.col("total") - 1) * p)).alias("wanted")
    upto = F.sum("n").over(Window.partitionBy(*group).orderBy("bin"))  # at most BINS rows a group
    hit = counts.withColumns({"upto": upto, "wanted": wanted}).filter((F.col("upto") > F.col("wanted")) & (F.col("upto") - F.col("n") <= F.col("wanted")))
    hit = hit.select(*group, "bin", (F.col("wanted") - (F.col("upto") - F.col("n"))).alias("at"))
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"h.{k}")) for k in [*group, "bin"]]
    on = same[0]
    for c in same[1:]:
        on &= c
    inside = binned.alias("b").join(hit.alias("h"), on).select(*[F.col(f"b.{k}") for k in group], "at", "value").groupBy(*group, "at", "value").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*group).orderBy("value"))
    found = inside.withColumn("upto", upto).filter((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("n") <= F.col("at")))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == name, F.col("value"))).alias(name) for name in metrics])


def session_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    ok = F.col("ok")
    good = lambda c: F.when(ok, F.col(c))
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("cases"),
        half_up(F.avg(ok.cast("int"))).alias("success_rate"),
        half_up(F.avg(good("quality"))).alias("avg_quality"),
        half_up(F.avg((F.col("latency_ms") > 5500).cast("int"))).alias("budget_exceeded_rate"),
    )
    p = lower_percentiles(
        rows, keys,
        {
            "p50_latency_ms": (good("latency_ms"), 0.5), "p95_latency_ms": (good("latency_ms"), 0.95),
            "p50_first_useful_ms": (good("first_useful_ms"), 0.5), "p95_memory_mb": (F.col("memory_mb"), 0.95),
        },
    )
    return base.join(p, keys, "left")


def report(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """Case-weighted means of success and quality, medians of the sessions' percentiles."""
    w = F.col("cases")
    mean = lambda c: F.sum(F.col(c) * w) / F.sum(F.when(F.col(c).isNotNull(), w))
    return sessions.groupBy(*keys).agg(
        F.count("*").alias("sessions"), F.sum("cases").alias("cases"),
        half_up(mean("success_rate")).alias("success_rate"), half_up(mean("avg_quality")).alias("avg_quality"),
        half_up(F.median("p50_latency_ms")).alias("p50_ms"), half_up(F.median("p95_latency_ms")).alias("p95_ms"),
    )


# fixed values: what a release needs, what is a regression or an improvement, and how many cases a promotion takes
RELEASE = {"success": 0.97, "quality": 0.85, "p50": 1500, "p95": 4000}
WORSE, BETTER = {"quality": -0.03, "success": -0.02, "p50": 1.35}, {"quality": 0.03, "p50": 1.2, "fast": 0.75, "fast_quality": -0.01}
PROMOTION_CASES = 12
# fixed values: weights of a canary's quality, success and times
CANARY = {"quality": 0.5, "success": 0.25, "p50": 0.15, "p95": 0.10}


def release_gate(df: DataFrame) -> DataFrame:
    checks = {
        "success_ok": F.col("success_rate") >= RELEASE["success"], "quality_ok": F.col("avg_quality") >= RELEASE["quality"],
        "p50_ok": F.coalesce(F.col("p50_ms") <= RELEASE["p50"], F.lit(True)), "p95_ok": F.coalesce(F.col("p95_ms") <= RELEASE["p95"], F.lit(True)),
    }
    out = df.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in checks.items()})
    return out.withColumn("released", F.forall(F.array(*checks), lambda x: x))


def rank(df: DataFrame, by: list[Column], out: str = "rank") -> DataFrame:
    """A rank over all rows; for small tables of groups."""
    return df.withColumn(out, F.row_number().over(Window.orderBy(*by)))


def competition(summary: DataFrame, baseline: str | None = None) -> DataFrame:
    """Every engine against the baseline (the named one, else the best by quality): verdict, promotion, rank."""
    by_quality = [F.col("avg_quality").desc(), F.col("engine")]
    own = F.struct(F.col("engine").alias("e"), F.col("avg_quality").alias("q"), F.col("success_rate").alias("s"), F.col("p50_ms").alias("p"))
    every = Window.orderBy(*by_quality).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row an engine
    base = F.max(F.when(F.col("engine") == baseline, own)).over(every) if baseline else F.first(own).over(every)
    marked = release_gate(summary).withColumn("_base", base).filter("_base is not null")
    marked = marked.select("*", *[F.col(f"_base.{c}").alias(n) for c, n in (("e", "baseline"), ("q", "b_quality"), ("s", "b_success"), ("p", "b_p50"))]).drop("_base")
    q, s = half_up(F.col("avg_quality") - F.col("b_quality")), half_up(F.col("success_rate") - F.col("b_success"))
    out = marked.withColumns({"quality_delta": q, "success_delta": s, "p50_ratio": half_up(F.col("p50_ms") / F.col("b_p50"))})
    r = F.col("p50_ratio")
    regressed = (F.col("quality_delta") < WORSE["quality"]) | (F.col("success_delta") < WORSE["success"]) | (r > WORSE["p50"])
    better = ((F.col("quality_delta") >= BETTER["quality"]) & (r <= BETTER["p50"])) | ((r <= BETTER["fast"]) & (F.col("quality_delta") >= BETTER["fast_quality"]))
    out = out.withColumns({
        "verdict": F.when(regressed, "REGRESSION").when(better, "IMPROVEMENT").otherwise("MIXED_OR_TIE"),
        "promoted": (F.col("cases") >= PROMOTION_CASES) & F.col("released") & ~regressed,
        "composite": half_up(composite_score(F.col("avg_quality"), F.col("success_rate"), F.col("p50_ms"), F.col("p95_ms"))),
    })
    return rank(out, by_quality).drop("b_quality", "b_success", "b_p50")


def _with_canary(df: DataFrame, margin: float) -> DataFrame:
    """Adds ``score``, ``place`` and ``chosen``; the places of promoted engines are among themselves."""
    score = half_up(
        CANARY["quality"] * F.col("avg_quality") + CANARY["success"] * F.col("success_rate")
        + CANARY["p50"] * clamp(1 - F.coalesce("p50_ms", F.lit(9999)) / RELEASE["p50"]) + CANARY["p95"] * clamp(1 - F.coalesce("p95_ms", F.lit(9999)) / RELEASE["p95"])
    )
    ordered = Window.partitionBy("promoted").orderBy(F.col("score").desc(), "engine")  # one row an engine
    lead = half_up(F.col("score") - F.lead("score").over(ordered))
    placed = df.withColumn("score", score).withColumns({"place": F.row_number().over(ordered), "lead": lead})
    return placed.withColumn("chosen", F.col("promoted") & (F.col("place") == 1) & F.coalesce(F.col("lead") >= margin, F.lit(True)))


def canary(df: DataFrame, margin: float = 0.04) -> DataFrame:
    """Of the promoted engines that whose blended score leads by the margin, if one does."""
    return _with_canary(df, margin).filter("promoted").select("engine", "score", "place", "chosen")


# fixed values: what the runtime adds to an engine's score
RUNTIME = {"LAB_REGRESSION": -0.22, "PROMOTED_CANARY": 0.16, "PROMOTED_ELIGIBLE": 0.06, "NO_RUNTIME_PROMOTION": 0.0}


def runtime_policy(df: DataFrame, days: int = 30, cases: int = 12) -> DataFrame:
    """``engine, verdict, promoted, cases, newest`` of a competition to a reason and an adjustment; rows older than ``days`` before the newest are ignored."""
    now = F.max("newest").over(Window.partitionBy())  # one row an engine
    fresh = df.withColumn("now", now).filter((F.col("cases") >= cases) & (F.unix_timestamp("now") - F.unix_timestamp("newest") <= days * 86_400))
    reason = (
        F.when(F.col("verdict") == "REGRESSION", "LAB_REGRESSION").when(F.coalesce("chosen", F.lit(False)), "PROMOTED_CANARY").when(F.col("promoted"), "PROMOTED_ELIGIBLE").otherwise("NO_RUNTIME_PROMOTION")
    )
    value = F.create_map(*[F.lit(x) for kv in RUNTIME.items() for x in kv])
    return _with_canary(fresh, 0.04).select("engine", reason.alias("reason")).withColumn("adjustment", value[F.col("reason")])


def failure_patterns(rows: DataFrame, tag: str = "scenario") -> DataFrame:
    quality = F.coalesce("quality", F.lit(0.0))
    failed = ~F.col("ok") | (quality < 0.75)
    return rows.groupBy("engine", F.coalesce(F.col(tag), F.lit("ordinary")).alias("tag")).agg(
        F.count("*").alias("cases"), F.sum(failed.cast("int")).alias("failures"), half_up(F.avg(quality)).alias("avg_quality"), half_up(F.avg(failed.cast("int"))).alias("failure_rate")
    ).filter("failures > 0")


# fixed values: what a case's tags, conditions and scenario say about it, by modality
TAGS = {
    "vision": {
        "low_light": r"(?i)low[_ -]?light|dark|night|弱光|暗光", "blur": r"(?i)blur|motion[_ -]?blur|模糊|抖动", "far_distance": r"(?i)far|distance|远景|远距离", "multi_object": r"(?i)multi[_ -]?object|crowd|多物体|多个物体",
        "small_target": r"(?i)small[_ -]?target|tiny|小目标", "text_interference": r"(?i)text|sign|label|文字|招牌|铭牌", "occlusion": r"(?i)occlu|遮挡",
    },
    "voice": {
        "shop_noise": r"(?i)shop[_ -]?noise|商店噪声", "street_noise": r"(?i)street[_ -]?noise|街道噪声", "vehicle_noise": r"(?i)vehicle[_ -]?noise|车内噪声", "far_mic": r"(?i)far[_ -]?mic|远距离",
        "mixed_language": r"(?i)mixed|code[_ -]?switch|混合语言|中西|中英|西英", "numbers": r"(?i)number|amount|数字|金额", "brand_model": r"(?i)brand|model|品牌|型号",
    },
}


def case_tags(text: Column, modality: str) -> Column:
    """All tags of a case by its words; ``ordinary`` without any."""
    found = F.array_compact(F.array(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in TAGS[modality].items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("ordinary")))


def tag_summary(patterns: DataFrame) -> DataFrame:
    """Cases and failures of a tag over all engines."""
    return patterns.groupBy("tag").agg(F.sum("cases").alias("cases"), F.sum("failures").alias("failures"), half_up(F.sum("failures") / F.sum("cases")).alias("failure_rate"))


def remediation_hints(patterns: DataFrame, top: int = 12) -> DataFrame:
    picked = patterns.filter("cases >= 2 and failure_rate >= 0.25").orderBy(F.desc("failure_rate"), "avg_quality", "engine", "tag").limit(top)
    return picked.withColumn("severity", F.when(F.col("failure_rate") >= 0.5, "high").otherwise("medium"))


def outcome_adjustment(counters: DataFrame) -> DataFrame:
    """Counters ``attempts, failures, signals, corrections, confirmed`` to a bounded adjustment."""
    fail, fix = F.col("failures") / F.col("attempts"), F.col("corrections") / F.col("signals")
    technical = F.when(F.col("attempts") < 8, 0.0).when(fail >= 0.35, -0.10).when(fail >= 0.2, -0.05).otherwise(0.0)
    quality = F.when(F.col("signals") < 5, 0.0).when(fix >= 0.4, -0.12).when(fix >= 0.25, -0.06).when((fix <= 0.1) & (F.col("confirmed") >= 5), 0.04).otherwise(0.0)
    return counters.withColumn("adjustment", half_up(clamp(technical + quality, -0.16, 0.06)))


def scenario_evidence(patterns: DataFrame, min_cases: int = 12) -> DataFrame:
    """Per engine the sum over scenarios of bonuses for clear leaders and penalties for failing engines."""
    enough = patterns.filter(F.col("cases") >= min_cases)
    by = Window.partitionBy("tag").orderBy(F.desc("avg_quality"), "failure_rate", "engine")
    group = Window.partitionBy("tag")
    ranked = enough.withColumns({"n": F.count("*").over(group), "place": F.row_number().over(by), "q2": F.lead("avg_quality").over(by), "f2": F.lead("failure_rate").over(by)}).filter("n >= 2")
    clear = (F.col("place") == 1) & ((half_up(F.col("avg_quality") - F.col("q2")) >= 0.08) | (half_up(F.col("f2") - F.col("failure_rate")) >= 0.12))
    delta = F.when(clear, 0.08).otherwise(0.0) + F.when(F.col("failure_rate") >= 0.5, -0.08).otherwise(0.0)
    return ranked.groupBy("engine").agg(half_up(clamp(F.sum(delta), -0.12, 0.12)).alias("adjustment"), F.count("*").alias("scenarios"))


def failure_runs(rows: DataFrame, key: str = "engine", stretch: int = 100_000) -> DataFrame:
    """Per key: runs, successes, smoothed success rate, the longest and the current run of failures.

    A key's rows are cut into stretches of their (numeric) sequence, so that a key with many rows is not one task; a stretch tells its
    failures before the first and after the last success and its longest run, and a fold over the stretches puts them together.
    """
    cut = rows.withColumn("part", F.floor(F.col("seq") / stretch))
    island = F.sum(F.col("ok").cast("int")).over(Window.partitionBy(key, "part").orderBy("seq"))
    islands = cut.withColumn("island", island).groupBy(key, "part", "island").agg(F.count_if(~F.col("ok")).alias("fails"), F.count_if("ok").alias("oks"))
    parts = islands.groupBy(key, "part").agg(
        F.sum(F.col("fails") + F.col("oks")).alias("n"), F.sum("oks").alias("oks"), F.max("fails").alias("longest"), F.sum(F.when(F.col("island") == 0, F.col("fails")).otherwise(0)).alias("lead"), F.max_by("fails", "island").alias("trail")
    )
    packed = parts.groupBy(key).agg(F.sum("n").alias("runs"), F.sum("oks").alias("successes"), F.sort_array(F.collect_list(F.struct("part", "n", "oks", "longest", "lead", "trail"))).alias("parts"))
    kind = "struct<now:bigint,longest:bigint>"

    def step(s: Column, x: Column) -> Column:
        whole = x["oks"] == 0
        reach = s["now"] + F.when(whole, x["n"]).otherwise(x["lead"])
        return F.struct(F.when(whole, reach).otherwise(x["trail"]).alias("now"), F.greatest(s["longest"], reach, x["longest"]).alias("longest")).cast(kind)

    folded = packed.withColumn("s", F.aggregate("parts", F.struct(F.lit(0).alias("now"), F.lit(0).alias("longest")).cast(kind), step))
    return folded.select(
        key, "runs", "successes", half_up((F.col("successes") + 3) / (F.col("runs") + 4), 3).alias("smoothed_rate"), F.col("s.longest").alias("longest_failures"), F.col("s.now").alias("consecutive_failures")
    )


def start_kinds(rows: DataFrame, key: str = "engine", hot_seconds: int = 300) -> DataFrame:
    """``cold`` on a key's first use, ``hot`` within five minutes of the last use, else ``warm``.

    Uses are put in order inside a key's day; only a day's first use looks at the last one of the day before it.
    """
    at = F.unix_micros(F.col("recorded_at").cast("timestamp"))
    cut = rows.withColumns({"_at": at, "_day": F.floor(at / 86_400_000_000)})
    days = cut.groupBy(key, "_day").agg(F.max("_at").alias("_last"))
    days = days.withColumn("_before", F.lag("_last").over(Window.partitionBy(key).orderBy("_day"))).drop("_last")  # one row a key and day
    within = F.lag("_at").over(Window.partitionBy(key, "_day").orderBy("_at", "seq"))
    gap = F.col("_at") - F.coalesce(F.col("_within"), F.col("_before"))
    joined = cut.withColumn("_within", within).join(days, [key, "_day"])
    return joined.withColumn("start", F.when(gap.isNull(), "cold").when(gap <= hot_seconds * 1_000_000, "hot").otherwise("warm")).drop("_at", "_day", "_within", "_before")


def last_n(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("place", place).filter(F.col("place") <= n)


def latest_snapshot(rows: DataFrame, keys: list[str], version: list[str], values: list[str]) -> DataFrame:
    """The newest row of each key, without a sort: ``max_by`` over a struct."""
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*version)).alias("v"))
    return newest.select(*keys, "v.*")
