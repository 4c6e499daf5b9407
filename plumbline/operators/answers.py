"""Answers and their claims, identities, retrieval results, visual evidence, speech signals, benchmark readiness and search packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.scalars import clamp, half_up
from plumbline.operators.policies import issues

# fixed values: what a claim may be and how it may stand
CLAIM_TYPES = ("fact", "inference", "recommendation", "price", "safety", "unknown")
CLAIM_STATUS = ("supported", "partially_supported", "unsupported", "conflicted", "unknown")
# fixed values: how much a visual claim says, from least to most
LEVELS = {"none": 0, "scene": 1, "category": 2, "family": 3, "brand": 4, "model_candidate": 5, "exact_model": 6, "state_anomaly": 7}
# fixed values: the order in which findings of equal weight come first
FAILURES = ("contract", "evidence", "entity", "perception", "router", "provider", "search_source", "user_input")
# fixed values: what a speaker's words signal, by kind
SPEECH = {
    "intent": [(r"(?i)怎么办|怎么修|怎么处理|如何解决|how do i|how to|cómo|como .*solucion|qué hago|que hago", "solve_or_guide"), (r"(?i)为什么|怎么回事|what happened|why|por qué|por que", "explain_cause"), (r"(?i)是什么|这是什么|what is|qué es|que es", "identify"), (r"(?i)翻译|translate|traduc", "translate")],
    "symptom": [(r"(?i)不工作|不能用|没反应|坏了|故障|error|falla|no funciona", "not_working"), (r"(?i)闪|闪烁|parpade|blinking|flashing", "blinking_indicator"), (r"(?i)响|噪音|声音|noise|ruido|sonido", "abnormal_sound"), (r"(?i)漏油|漏水|泄漏|leak|fuga", "leak"), (r"(?i)发热|过热|很烫|overheat|caliente", "overheating")],
    "temporal": [("昨天", "yesterday_context"), ("今天", "today_context"), ("刚才", "recent_context"), ("一直", "persistent"), ("突然", "sudden_change")],
    "action": [("拔(?:过)?(?:一次)?插头|拔掉.*插头|重新插|断电.*重启|重启(?:过)?", "power_cycle"), ("换(?:过)?电池|更换(?:过)?电池", "battery_replaced"), ("清理(?:过)?|清洁(?:过)?", "cleaned"), ("重新安装|重装(?:过)?", "reinstalled")],
    "reference": [("这个|这个东西|这个机器|这个设备", "this_object"), ("右边|右侧", "right_side"), ("左边|左侧", "left_side"), ("红灯|红色灯", "red_indicator"), ("绿灯|绿色灯", "green_indicator"), (r"(?i)第一个|第1个|first(?: one)?|primero|primera", "ordinal_1"), (r"(?i)第二个|第2个|second(?: one)?|segundo|segunda", "ordinal_2")],
}
# fixed values: words that point back to an object of the conversation, in the order they are tried
POINTERS = [("same_object", r"(?i)它|这个|这个东西|this one|it|this|éste|esta|esto|eso|esa"), ("previous_object", r"(?i)刚才那个|刚才的|上一个|previous one|the one before|el anterior|la anterior"), ("other_object", r"(?i)那个|另一个|另外一个|that one|the other one|ese|esa|aquel|aquella")]


def normal_claims(df: DataFrame) -> DataFrame:
    """Claims ``text, type, status, confidence`` with unknown kinds named so; claims without text are dropped."""
    known = lambda c, values: F.when(F.col(c).isin(*values), F.col(c)).otherwise("unknown")
    return df.filter(F.length(F.trim("text")) > 0).withColumns(
        {"text": F.trim("text"), "type": known("type", CLAIM_TYPES), "status": known("status", CLAIM_STATUS), "confidence": clamp(F.coalesce("confidence", F.lit(0.0)))}
    )


def checked_answers(answers: DataFrame, claim_issues: DataFrame, longest: int = 12_000) -> DataFrame:
    """Answers ``id, answer, unknown_refs`` with the issues of their claims ``id, issue``; resolved source conflicts only warn."""
    found = claim_issues.groupBy("id").agg(F.collect_set("issue").alias("more"))
    own = issues({"answer_missing": F.length(F.trim(F.coalesce("answer", F.lit("")))) == 0, "answer_too_long": F.length("answer") > longest, "unknown_evidence_ref": F.col("unknown_refs") > 0})
    joined = answers.join(found, "id", "left").withColumn("all", F.array_sort(F.array_distinct(F.concat(own, F.coalesce("more", F.array().cast("array<string>"))))))
    blocking = F.filter("all", lambda x: ~x.startswith("source_conflict_resolved:"))
    return joined.select("id", F.array_join("all", ",").alias("issues"), (F.size(blocking) == 0).alias("ok"), (F.size("all") - F.size(blocking)).alias("warnings"))


def identity_issues(df: DataFrame, least: float = 0.82) -> DataFrame:
    """Proposals ``name, confidence, refs, allowed, status``: why they may not be taken, and what they become."""
    refs = F.array_distinct(F.coalesce("refs", F.array().cast("array<bigint>")))
    found = issues({
        "identity_name_missing": F.length(F.trim(F.coalesce("name", F.lit("")))) == 0, "identity_confidence_too_low": F.coalesce("confidence", F.lit(0.0)) < least, "identity_evidence_missing": F.size(refs) == 0,
        "identity_unknown_evidence_ref": F.size(F.array_except(refs, "allowed")) > 0, "identity_unresolved": F.col("status") == "unresolved",
    })
    return df.withColumn("issues", F.array_join(found, ",")).withColumn("becomes", F.when(F.col("issues") != "", None).when(F.col("confidence") >= 0.9, "confirmed").otherwise("probable"))


def resolved_identity(candidates: DataFrame, key: str) -> DataFrame:
    """Per key the best of candidates ``name, confidence, brand``: close rivals cap it at .69, brands that differ at .64."""
    order = Window.partitionBy(key).orderBy(F.desc("confidence"), "name")
    ranked = candidates.withColumns({"place": F.row_number().over(order), "second": F.lead("confidence").over(order)})
    clash = candidates.groupBy(key).agg((F.count_distinct(F.lower("brand")) > 1).alias("conflict"))
    best = ranked.filter("place = 1").join(clash, key)
    close = F.coalesce(F.col("confidence") - F.col("second") < 0.12, F.lit(False))
    sure = F.when(close, F.least(F.col("confidence"), F.lit(0.69))).otherwise(F.col("confidence"))
    sure = half_up(F.when(F.col("conflict"), F.least(sure, F.lit(0.64))).otherwise(sure))
    return best.select(key, "name", sure.alias("confidence"), "conflict", ((sure < 0.75) | F.col("conflict")).alias("ask"))


def retrieval_verdict(results: DataFrame, key: str) -> DataFrame:
    """Results ``domain, quality, authority`` with ``least`` and ``cross`` of their request: can they answer, and if not, why."""
    out = results.groupBy(key).agg(
        F.count("*").alias("n"), F.count_distinct("domain").alias("domains"), F.count_if(F.col("authority") >= 0.8).alias("authoritative"), half_up(F.avg("quality")).alias("quality"), F.max("least").alias("least"), F.bool_or("cross").alias("cross")
    )
    crossed = ~F.col("cross") | (F.col("domains") >= 2) | (F.col("authoritative") >= 2)
    why = F.when(F.col("n") < F.col("least"), "insufficient_results").when(~crossed, "insufficient_cross_check").when(F.col("quality") < 0.62, "low_source_quality")
    return out.select(key, "n", "domains", "authoritative", "quality", why.alias("reason"), why.isNull().alias("can_answer"))


def strongest_claim(claims: DataFrame, key: str) -> DataFrame:
    """Per key the visual claim that says most, then the surest, and whether it names at least a brand with .7."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.lower(F.trim("level"))], F.lit(LEVELS["category"]))
    best = claims.filter("label is not null").groupBy(key).agg(F.max_by(F.struct("label", rank.alias("rank"), "confidence"), F.struct(rank.alias("rank"), F.col("confidence"), F.col("label"))).alias("b"))
    return best.select(key, "b.*", ((F.col("b.rank") >= LEVELS["brand"]) & (F.col("b.confidence") >= 0.7)).alias("brand_known"))


def primary_failure(findings: DataFrame, key: str) -> DataFrame:
    """Per key the finding that is blocking first, then first by category."""
    place = F.array_position(F.array(*map(F.lit, FAILURES)), F.col("category"))
    order = F.struct((~F.col("blocking")).alias("soft"), F.when(place == 0, len(FAILURES) + 1).otherwise(place).alias("place"), F.col("code"))
    return findings.groupBy(key).agg(F.min_by(F.struct("category", "code", "blocking"), order).alias("f")).select(key, "f.*")


def speech_signals(turns: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``(keys, kind, signal)``: what a text's words signal."""
    rows = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("signal"))) for kind, rules in SPEECH.items() for p, name in rules]))
    return turns.select(*keys, F.explode(rows).alias("s")).select(*keys, "s.*")


def pointed_objects(turns: DataFrame, key: str, order: str) -> DataFrame:
    """Turns ``text, seen`` (the object seen with them, or null) of a conversation: which earlier object a turn without one points to.

    The focus is the object seen last, the one before it the previous and other object.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    focus = F.last("seen", ignorenulls=True).over(w)
    marked = turns.withColumn("focus", focus)
    changed = F.when(F.col("seen").isNotNull() & (F.col("focus").isNotNull()) & (F.col("seen") != F.col("focus")), F.col("focus"))
    marked = marked.withColumn("left_behind", changed).withColumn("before", F.last("left_behind", ignorenulls=True).over(w))
    kind = F.coalesce(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in POINTERS])
    target = F.when(kind == "same_object", F.col("focus")).when(kind == "previous_object", F.coalesce("before", "focus")).when(kind == "other_object", F.col("before"))
    return marked.filter("seen is null").select(key, order, kind.alias("kind"), target.alias("object")).filter("kind is not null")


def failover_chain(ranked: DataFrame, key: str) -> DataFrame:
    """Ranked providers ``provider, score, explore`` of a request: the explored one (of ranks 2 and 3) first, then the others in order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "provider"))
    rows = ranked.withColumn("place", place)
    first = F.when(F.col("explore") & (F.col("place") == F.col("turn")), 0).otherwise(1)
    return rows.withColumn("chain", F.row_number().over(Window.partitionBy(key).orderBy(first, "place")))


def sanitised_package(df: DataFrame, key: str, limits: dict[str, int]) -> DataFrame:
    """Lists of a task package, each cut to what the policy lets out (a limit of the feature)."""
    return df.select(key, *[F.slice(c, 1, n).alias(c) for c, n in limits.items()])


def without_secrets(values: Column) -> Column:
    """A map without keys that name media or secrets."""
    # fixed values: names of fields that are secret or hold media
    return F.map_filter(values, lambda k, _: ~k.rlike(r"(?i)token|secret|password|api_?key|image|audio|media|base64"))


def error_codes(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b(?:ERR(?:OR)?\s*[:#-]?\s*)?([A-Z]\d{1,4})\b"), 1), F.upper))


def preflight(checks: dict[str, Column]) -> Column:
    """Reasons why a benchmark cannot run; empty when it is ready."""
    return F.array_join(issues(checks), ",")
