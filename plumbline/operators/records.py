"""Records to records: normalised evidence and ground truth, merged contexts, compacted states, labels and regions; ordered folds over turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.scalars import clamp, half_up
from plumbline.operators.machine import Machine, final_states

# fixed values: what a kind of evidence is worth without a confidence of its own
KIND_CONFIDENCE = {"observation": 0.8, "user_report": 0.75, "ocr_extraction": 0.7, "external_source": 0.7, "inference": 0.55, "tool_result": 0.8, "teacher_result": 0.65}
STATES = ("active", "superseded", "expired", "retracted", "conflicted")
# fixed values: regions by their names in a text
REGIONS = [
    (r"(?i)\b(?:mexico|méxico|mexican[oa]?|墨西哥)\b", "MX"), (r"(?i)(?:\b(?:united states|usa|u\.s\.)\b|美国)", "US"), (r"(?i)\b(?:china|中国|中华人民共和国)\b", "CN"), (r"(?i)(?:\bjapan\b|日本)", "JP"), (r"(?i)\b(?:canada|加拿大)\b", "CA"),
    (r"(?i)\b(?:spain|españa|西班牙)\b", "ES"), (r"(?i)\b(?:france|法国)\b", "FR"), (r"(?i)\b(?:germany|deutschland|德国)\b", "DE"), (r"(?i)\b(?:united kingdom|uk|britain|英国)\b", "GB"), (r"(?i)\b(?:brazil|brasil|巴西)\b", "BR"),
]
CURRENCIES = {"MX": "MXN", "US": "USD", "JP": "JPY", "GB": "GBP", "CN": "CNY", "CA": "CAD", "BR": "BRL"}
# fixed values: words with which a user pauses, closes, resumes or reopens a problem, and says how it went
LIFECYCLE = {
    "pause": r"(?i)先不管|暂时不管|先放着|稍后再说|回头再弄|pause|later|despu[eé]s|m[aá]s tarde", "close": r"(?i)不用处理了|这个问题结束|不再处理|关闭这个问题|close this|cerrar.*problema",
    "resume": r"(?i)继续|接着|再看看|继续处理|resume|continue|continuar|seguir", "reopen": r"(?i)又坏|又不行|又出现|又开始|复发|再次.*不|又.*闪|again|stopped working again|otra vez|de nuevo",
    "resolved": r"(?i)已经好了|解决了|正常了|可以了|修好了|funciona|resuelto|solucionado", "not_resolved": r"(?i)还是不行|没有解决|仍然|还是一样|sigue igual|no funciona",
}
# fixed values: explicit corrections of the turn before, and words that continue it
CORRECTIONS = [r"(?:不是|不对)[，,\s]*([^，,。；;]+?)[，,\s]*(?:是|应该是)[，,\s]*([^，,。；;]+)$", r"(?i)(?:no|not)\s+(.+?)[,;]?\s+(?:sino|but|it'?s|should be)\s+(.+)$", r"(?i)(?:no es|no era)\s+(.+?)[,;]?\s+(?:es|era)\s+(.+)$"]
CONTINUES = r"(?i)^(?:继续|然后|还有|那|那么|再|y\b|entonces\b|también\b|also\b|then\b|and\b)"


def evidence_kind(given: Column, url: Column, source: Column) -> Column:
    """The kind that a record states, else the one that its origin suggests."""
    named = F.when(given.isin(*KIND_CONFIDENCE), given)
    guessed = (
        F.when(url.isNotNull(), "external_source").when(source == "photo", "observation").when(source == "user", "user_report").when(source == "ocr", "ocr_extraction")
        .when(source == "teacher", "teacher_result").when(source == "tool", "tool_result").otherwise("inference")
    )
    return F.when(given.isNotNull(), F.coalesce(named, F.lit("inference"))).otherwise(guessed)


def evidence_semantics(df: DataFrame) -> DataFrame:
    """``given_kind, url, source, given_state, given_confidence`` to ``kind, state, confidence`` with defaults."""
    kind = evidence_kind(F.col("given_kind"), F.col("url"), F.col("source"))
    default = F.create_map(*[F.lit(x) for kv in KIND_CONFIDENCE.items() for x in kv])
    state = F.when(F.col("given_state").isin(*STATES), F.col("given_state")).otherwise("active")
    return df.withColumn("kind", kind).withColumns({"state": state, "confidence": clamp(F.coalesce("given_confidence", default[F.col("kind")]))})


def field_evidence(value: Column, confidence: Column) -> Column:
    """``struct(value, status, confidence)``: a missing value is unresolved and worth nothing."""
    return F.struct(value.alias("value"), F.when(value.isNull(), "unresolved").otherwise("resolved").alias("status"), F.when(value.isNull(), 0.0).otherwise(clamp(confidence)).alias("confidence"))


def merged_context(base: DataFrame, patch: DataFrame, key: str, fields: list[str], lists: list[str]) -> DataFrame:
    """Non-null fields of the patch win; lists are put one after the other; all rows of the base stay."""
    p = patch.select(key, *[F.col(c).alias(f"_{c}") for c in [*fields, *lists]])
    empty = lambda c: F.coalesce(F.col(c), F.array())
    return base.join(p, key, "left").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in fields], *[F.concat(empty(c), empty(f"_{c}")).alias(c) for c in lists])


def last_of(values: Column, n: int) -> Column:
    """The last ``n`` elements of an array."""
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), F.lit(n))


def explicit_regions(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(pattern), F.lit(region)) for pattern, region in REGIONS]))


def currency_of(text: Column, question_region: Column, object_region: Column, locale: Column) -> Column:
    # fixed values: how currencies are written in a text
    by_region = F.create_map(*[F.lit(x) for kv in CURRENCIES.items() for x in kv])
    of_locale = F.upper(F.get(F.split(locale, "-"), F.lit(1)))
    return (
        F.when(text.rlike(r"(?i)\b(?:USD|US\$)"), "USD").when(text.rlike(r"(?i)\bMXN\b|\bM\.?N\.?"), "MXN").when(text.rlike("\\bEUR\\b|€"), "EUR")
        .when(text.rlike("\\bJPY\\b|¥") & (object_region == "JP"), "JPY").otherwise(by_region[F.coalesce(question_region, object_region, of_locale)])
    )


def label_score(expected: Column, predicted: Column) -> Column:
    """Share of the expected labels that equal, contain or are contained in a predicted one."""
    clean = lambda xs: F.filter(F.transform(xs, lambda x: F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))), lambda x: x != "")
    e, p = clean(expected), clean(predicted)
    hits = F.filter(e, lambda x: F.exists(p, lambda y: (x == y) | F.contains(x, y) | F.contains(y, x)))
    return half_up(F.coalesce(F.try_divide(F.size(hits), F.size(e)), F.lit(0.0)))


def normal_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """``struct(x, y, w, h, cx, cy)`` in shares of the picture; boxes whose values are all at most 1.5 are shares already."""
    share = F.greatest(x, y, w, h) <= 1.5
    part = lambda v, whole: clamp(F.when(share, v).otherwise(F.try_divide(v, whole)))
    nx, ny, nw, nh = part(x, width), part(y, height), part(w, width), part(h, height)
    return F.struct(*[half_up(v).alias(n) for n, v in {"x": nx, "y": ny, "w": nw, "h": nh, "cx": nx + nw / 2, "cy": ny + nh / 2}.items()])


def ordinals(regions: DataFrame, group: str, spread: float = 1.6) -> DataFrame:
    """Places of a group's regions ``id, cx, cy, w, h`` along the axis on which they spread most: at least 1.6 times the other and one average size; else null."""
    per = regions.groupBy(group).agg(
        (F.max("cx") - F.min("cx")).alias("dx"), (F.max("cy") - F.min("cy")).alias("dy"), F.avg("w").alias("aw"), F.avg("h").alias("ah")
    )
    axis = F.when((F.col("dx") >= spread * F.col("dy")) & (F.col("dx") >= F.col("aw")), "x").when((F.col("dy") >= spread * F.col("dx")) & (F.col("dy") >= F.col("ah")), "y")
    placed = regions.join(per.select(group, axis.alias("axis")), group)
    along = F.when(F.col("axis") == "x", F.col("cx")).when(F.col("axis") == "y", F.col("cy"))
    return placed.withColumn("ordinal", F.when(F.col("axis").isNotNull(), F.row_number().over(Window.partitionBy(group).orderBy(along, "id"))))


def ring_next(items: DataFrame, group: str, order: str) -> DataFrame:
    """For every item the next one of its group that is not ``skipped``, around the end to the start; itself if it is the only one."""
    w = Window.partitionBy(group)
    live = F.when(~F.col("skipped"), F.col(order))
    after = F.min(live).over(w.orderBy(order).rowsBetween(1, Window.unboundedFollowing))
    return items.withColumn("next", F.coalesce(after, F.min(live).over(w)))


SIGNALS = [(hard, resume, again, outcome) for hard in (None, "pause", "close") for resume in (False, True) for again in (False, True) for outcome in (None, "resolved", "not_resolved")]


def _said(signal: tuple, now: str) -> tuple[str, int]:
    """The state of a problem after a turn with these signals, and whether it begins anew."""
    hard, resume, again, outcome = signal
    if hard:
        return "paused" if hard == "pause" else "closed", 0
    if now in ("paused", "closed") and resume or outcome == "not_resolved" and not (now == "resolved" and again):
        return "investigating", 0 if not (now == "resolved" and again) else 1
    if now == "resolved" and again:
        return "investigating", 1
    return ("resolved" if outcome == "resolved" else now), 0


PROBLEM = Machine.of(["investigating", "paused", "closed", "resolved"], SIGNALS, _said)


def lifecycle(turns: DataFrame, key: str, order: str, stretch: Column | None = None) -> DataFrame:
    """``(key, status, generation)``: the state of each key after its user turns, and how often it was reopened; folded by ``stretch``, a coarse part of the order."""
    said = lambda name: F.coalesce(F.col("text").rlike(LIFECYCLE[name]), F.lit(False))
    hard = F.when(said("pause"), 1).when(said("close"), 2).otherwise(0)
    outcome = F.when(said("not_resolved"), 2).when(said("resolved"), 1).otherwise(0)
    move = ((hard * 2 + said("resume").cast("int")) * 2 + said("reopen").cast("int")) * 3 + outcome
    last = final_states(turns, PROBLEM, key, order, F.lit(0) if stretch is None else stretch, move)
    return last.select(key, F.col("state").alias("status"), F.col("gain").cast("int").alias("generation"))


def corrected_turns(turns: DataFrame, key: str, order: str) -> DataFrame:
    """User turns as ``correction`` (what it replaces in the user's turn before), ``continuation`` or ``new_turn``, with the text that they amount to."""
    users = turns.filter("role = 'user'").withColumn("text", F.trim(F.coalesce("text", F.lit(""))))
    before = F.lag("text").over(Window.partitionBy(key).orderBy(order))
    first = lambda group: F.coalesce(*[F.nullif(F.trim(F.regexp_extract("text", p, group)), F.lit("")) for p in CORRECTIONS])
    rows = users.withColumns({"before": before, "wrong": first(1), "right": first(2)})
    tail = F.length("before") - F.position(F.reverse(F.lower("wrong")), F.reverse(F.lower("before"))) - F.length("wrong") + 1
    found = F.contains(F.lower("before"), F.lower("wrong"))
    replaced = F.concat(F.substring(F.col("before"), F.lit(1), tail), F.col("right"), F.substring(F.col("before"), tail + F.length("wrong") + 1, F.length("before")))
    fixed = F.coalesce(found & (replaced != F.col("before")), F.lit(False))
    kind = F.when(fixed, "correction").when(F.col("text").rlike(CONTINUES), "continuation").otherwise("new_turn")
    return rows.select(key, order, kind.alias("kind"), F.when(fixed, replaced).otherwise(F.col("text")).alias("resolved"))


def speech_latency(events: DataFrame, key: str) -> DataFrame:
    """Per utterance the milliseconds from its start to the first partial and to the final result."""
    at = F.unix_micros(F.col("at").cast("timestamp"))
    first = lambda kind: F.min(F.when(F.col("type") == kind, at))
    out = events.groupBy(key).agg(F.min(at).alias("start"), first("partial").alias("partial"), first("final").alias("final"))
    ms = lambda c: F.floor((F.col(c) - F.col("start")) / 1000)
    return out.select(key, ms("partial").alias("partial_ms"), ms("final").alias("final_ms"))


def cohort_winner(rows: DataFrame, cohort: str, name: str) -> DataFrame:
    """The best of each cohort under a comparison that is not transitive (quality, if it differs by more than .02, then success by more than .01, then time).

    Candidates are compared in order of name as a tournament: the holder stays unless the next one beats it.
    """
    live = rows.filter("cases > 0 and success > 0")
    packed = live.groupBy(cohort).agg(F.sort_array(F.collect_list(F.struct(F.col(name).alias("name"), "quality", "success", "p50"))).alias("all"))  # a cohort's engines are few

    def better(a: Column, b: Column) -> Column:
        q, s = b["quality"] - a["quality"], b["success"] - a["success"]
        return F.when(F.abs(q) > 0.02, q > 0).when(F.abs(s) > 0.01, s > 0).otherwise(b["p50"] < a["p50"])

    won = F.aggregate(F.slice(F.col("all"), 2, 1_000_000), F.col("all")[0], lambda a, b: F.when(better(a, b), b).otherwise(a))
    return packed.select(cohort, won["name"].alias("winner"))


def photo_entities(photos: DataFrame, entities: DataFrame, session: str) -> DataFrame:
    """The entity of its session that each photo shows, by serial, model, brand and label; conflicts of serial or model make a new object."""
    e = entities.select(session, F.col("id").alias("entity"), *[F.col(c).alias(f"e_{c}") for c in ("serial", "model", "brand", "label")])
    norm = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    both = lambda c: F.col(c).isNotNull() & F.col(f"e_{c}").isNotNull()
    same = lambda c: both(c) & (norm(F.col(c)) == norm(F.col(f"e_{c}")))
    differ = lambda c: both(c) & (norm(F.col(c)) != norm(F.col(f"e_{c}")))
    pairs = photos.join(e, session, "left")
    score = F.lit(0.18) + F.when(same("serial"), 0.75).otherwise(0.0)
    score = F.when(differ("serial"), 0.0).otherwise(score) + F.when(same("model"), 0.48).otherwise(0.0)
    score = F.when(differ("model"), F.least(score, F.lit(0.05))).otherwise(score) + F.when(same("brand"), 0.18).when(differ("brand"), -0.2).otherwise(0.0)
    score = clamp(score + F.when(same("label"), F.least(F.lit(0.28), F.col("label_confidence") * 0.25)).otherwise(0.0) + F.when(F.col("continues"), 0.22).otherwise(0.0))
    scored = pairs.withColumns({"score": F.when(F.col("entity").isNotNull(), score), "conflict": differ("serial") | differ("model")})
    order = Window.partitionBy("photo").orderBy(F.desc_nulls_last("score"), "entity")
    best = scored.withColumns({"place": F.row_number().over(order), "rival": F.lead("score").over(order)}).filter("place = 1")
    lead = F.col("score") - F.coalesce("rival", F.lit(0.0))
    status = (
        F.when(F.col("entity").isNull(), "new_object").when(F.col("conflict"), "likely_new_object").when((F.col("score") >= 0.82) & ((lead >= 0.15) | F.col("rival").isNull()), "same_object")
        .when(F.col("score") >= 0.58, "probably_same_object").when(F.col("score") <= 0.22, "likely_new_object").otherwise("unresolved")
    )
    return best.select("photo", status.alias("status"), F.when(status.isin("same_object", "probably_same_object"), F.col("entity")).alias("entity"), half_up(F.col("score")).alias("score"))
