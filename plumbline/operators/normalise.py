"""Records in many forms to one form: ground truth, offers, recognition results, vision observations, labels and money."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import clamp

# fixed values: fields of a receipt's ground truth
TRUTH_FIELDS = ["merchant", "date", "subtotal", "tax", "discount", "total", "cash", "change"]
# fixed values: diagnostics of a recognition that may be kept
DIAGNOSTICS = "orientation script pageCount warning mode languageHint trainedLanguage workerCacheHit workerCreated queueDepth recognitionTimingSamples".split()
# fixed values: signs of currencies in amounts shown in English, and those without a minor unit
SIGNS = {"USD": "$", "MXN": "MX$", "EUR": "€", "GBP": "£", "JPY": "¥", "CNY": "CN¥", "CAD": "CA$", "BRL": "R$"}
WHOLE = ("JPY",)
MAX_BLOCKS, OBSERVED = 2000, 0.85


def ground_truth(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, field, value, status)`` of JSON documents whose fields are values or ``{value, status}``, below ``fields`` or at the top; a missing one is unresolved."""
    doc = df.select(key, F.try_parse_json(text).alias("d"))
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    rows = doc.select(key, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(get("d", f"$.fields.{f}", "variant"), get("d", f"$.{f}", "variant")).alias("v")) for f in TRUTH_FIELDS])))
    whole = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    there = F.col("v").isNotNull() & ~F.coalesce(F.is_variant_null("v"), F.lit(False))
    has = get("v", "$.value", "variant").isNotNull()
    value = F.when(whole, get("v", "$.value", "string")).otherwise(get("v", "$", "string"))
    status = F.when(~there, "unresolved").when(~whole, "confirmed").otherwise(F.coalesce(get("v", "$.status", "string"), F.when(has, "confirmed").otherwise("unresolved")))
    return rows.select(key, "field", F.when(there, value).alias("value"), status.alias("status"))


def offers(df: DataFrame) -> DataFrame:
    """Offers with aliases filled in: ``price`` or ``claim_value``, ``seller`` or ``publisher``, channel by distance, currency from ``claim_key`` (``price_mxn``)."""
    known = F.nullif(F.upper(F.regexp_extract(F.coalesce("claim_key", F.lit("")), "(?i)price_([a-z]{3})", 1)), F.lit(""))
    return df.select(
        "id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("seller", "publisher").alias("seller"), F.coalesce("price", "claim_value").alias("price"), F.coalesce("currency", known).alias("currency"),
        F.coalesce("channel", F.when(F.col("distance_km").isNotNull(), "physical").otherwise("online")).alias("channel"), F.coalesce("availability", F.lit("unknown")).alias("availability"),
        F.coalesce("member_only", F.lit(False)).alias("member_only"), F.coalesce("observed_at", "accessed_at").alias("observed_at"),
    )


def finite(value: Column) -> Column:
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), value)


def sure(value: Column) -> Column:
    """A confidence from 0 to 1; nothing finite is 0."""
    return clamp(F.coalesce(finite(value.cast("double")), F.lit(0.0)))


def ocr_results(df: DataFrame) -> DataFrame:
    """Recognition results ``engine, text, confidence, blocks (id, text, confidence, x, y, width, height, line), diagnostics (map)`` in one form; at most 2000 blocks."""
    number = lambda v: F.coalesce(finite(v.cast("double")), F.lit(0.0))
    box = lambda b: F.when(b["x"].isNotNull() | b["width"].isNotNull(), F.struct(*[number(b[c]).alias(c) for c in ("x", "y", "width", "height")]))
    block = lambda b, i: F.struct(
        F.coalesce(b["id"], F.concat(F.lit("block-"), (i + 1).cast("string"))).alias("id"), F.coalesce(b["text"], F.lit("")).alias("text"), sure(b["confidence"]).alias("confidence"), box(b).alias("bbox"), b["line"].alias("line")
    )
    diagnostics = F.map_filter("diagnostics", lambda k, v: k.isin(*DIAGNOSTICS) & v.isNotNull())
    return df.withColumns({
        "engine": F.coalesce("engine", F.lit("unknown")), "text": F.coalesce("text", F.lit("")), "confidence": sure(F.col("confidence")), "blocks": F.transform(F.slice("blocks", 1, MAX_BLOCKS), block), "diagnostics": diagnostics,
    })


def ocr_problem(engine: Column, text: Column, confidence: Column, blocks: Column) -> Column:
    """Why a result is none; null if it is one."""
    return (
        F.when(engine.isNull() | (engine == ""), "OCR_RESULT_ENGINE_ID_REQUIRED").when(text.isNull(), "OCR_RESULT_TEXT_REQUIRED").when(finite(confidence).isNull(), "OCR_RESULT_CONFIDENCE_REQUIRED")
        .when(~confidence.between(0, 1), "OCR_RESULT_CONFIDENCE_RANGE").when(blocks.isNull(), "OCR_RESULT_BLOCKS_REQUIRED")
    )


def claims(values: Column, kind: str) -> Column:
    """Claims ``(id, label, value, confidence, status)`` with defaults: what is sure enough is observed, the rest a candidate."""
    def one(x: Column, i: Column) -> Column:
        confidence = F.coalesce(x["confidence"], F.lit(0.0))
        return F.struct(
            F.coalesce(x["id"], F.concat(F.lit(f"{kind}-"), (i + 1).cast("string"))).alias("id"), F.coalesce(x["label"], x["value"], F.lit("")).alias("label"), confidence.alias("confidence"),
            F.coalesce(x["status"], F.when(confidence >= OBSERVED, "observed").otherwise("candidate")).alias("status"),
        )

    return F.transform(values, one)


def visual_labels(*sources: Column) -> Column:
    """The distinct trimmed labels of several arrays, in order, without empty ones."""
    every = F.flatten(F.array(*[F.coalesce(s, F.array().cast("array<string>")) for s in sources]))
    return F.array_distinct(F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def benchmark_cases(manifests: DataFrame, cases: DataFrame, dataset: str, case: str, text: str) -> DataFrame:
    """Cases of the datasets whose manifests still fit, as benchmark cases with the manifest's hash."""
    from plumbline.operators.documents import verified

    valid = verified(manifests, cases, dataset, case, text).filter("hash_matches").select(dataset)
    get = lambda name: F.try_variant_get("d", f"$.{name}", "string")
    rows = cases.select(dataset, F.try_parse_json(text).alias("d")).join(manifests.select(dataset, "content_hash").join(valid, dataset), dataset)
    return rows.select(dataset, get("caseId").alias("id"), get("difficulty").alias("difficulty"), get("receiptType").alias("receipt_type"), F.to_json(F.try_variant_get("d", "$.fields", "variant")).alias("expected"), "content_hash")


def same_intent(expected: Column, predicted: Column) -> Column:
    """1 where two intents are the same words in any writing, else 0."""
    norm = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}\s]+", " "), r"\s+", " "))
    return (norm(expected) == norm(predicted)).cast("int")


def money(minor: Column, currency: Column) -> Column:
    """Minor units as an English amount; a currency that is not known counts as dollars, others without a sign show their code."""
    code = F.upper(F.coalesce(currency, F.lit("XXX")))
    code = F.when(code == "XXX", "USD").otherwise(code)
    sign = F.coalesce(*[F.when(code == c, F.lit(s)) for c, s in SIGNS.items()], F.concat(code, F.lit(" ")))
    value = F.abs(minor) / 100
    shown = F.when(code.isin(*WHOLE), F.format_number(F.floor(value + 0.5), 0)).otherwise(F.format_number(value.cast("decimal(38,2)"), 2))
    return F.when(minor.isNotNull(), F.concat(F.when(minor < 0, "-").otherwise(""), sign, shown)).otherwise("null")
