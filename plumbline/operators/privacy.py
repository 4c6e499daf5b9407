"""Personal data in texts: findings with places, redaction of overlapping findings, and queries that are safe to send."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.functions.scalars import fnv1a32

# fixed values: patterns of personal data, in the order they are looked for
PATTERNS = {
    "rfc": r"\b[A-Z&Ññ]{3,4}\d{6}[A-Z0-9]{3}\b", "curp": r"\b[A-Z]{4}\d{6}[HM][A-Z]{5}[A-Z0-9]\d\b", "email": r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "phone": r"(?<!\d)(?:\+?52[\s.-]?)?(?:\d[\s.-]?){10}(?!\d)", "payment_card": r"\b(?:\d[ -]*?){13,19}\b",
}
_COMPILED = {kind: re.compile(pattern, re.I | re.A) for kind, pattern in PATTERNS.items()}
FINDINGS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_KIND = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

# fixed values: patterns that are taken out of a search query, and what stands in their place
QUERY_PATTERNS = [
    (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "email"), (r"\b(?:\+?52[\s.-]*)?(?:\d[\s.-]?){10}\b", "phone"), (r"\b(?:\d[ -]*?){13,19}\b", "account"), (r"\b\d{18}\b", "clabe"),
    (r"(?i)\b[A-ZÑ&]{3,4}\d{6}[A-Z0-9]{3}\b", "rfc"), (r"(?i)\b[A-Z]{4}\d{6}[HM][A-Z]{5}[A-Z0-9]\d\b", "curp"), (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "ip"),
    (r"(?i)\b(?=[A-Z0-9]{12,}\b)(?=[A-Z0-9]*\d)[A-Z0-9]{12,}\b", "reference"),
    (r"(?i)\b(?:nombre|name|titular|beneficiario|beneficiary|cliente|customer)\s*[:#-]?\s+[A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ.' -]{2,50}", "person"),
    (r"(?i)\b(cuenta|account|tarjeta|card|clabe|rfc|curp|folio|referencia|reference)\s*[:#-]?\s*[A-Z0-9*.-]{4,}", "$1"),
]


def luhn(digits: str) -> bool:
    if not 13 <= len(digits) <= 19:
        return False
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return (sum(int(d) for d in digits[-1::-2]) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def scan(text: str | None) -> list[dict]:
    """Findings of one text in order of kind and place; card numbers need a valid check digit."""
    out = []
    for kind, pattern in _COMPILED.items():
        for m in pattern.finditer(text or ""):
            if kind != "payment_card" or luhn(re.sub(r"\D", "", m[0])):
                out.append({"type": kind, "start": m.start(), "end": m.end()})
    return out


def spliced(text: str | None, found: list[dict]) -> str | None:
    """The text with every finding replaced by its kind, the last place first; overlapping findings each leave their mark."""
    if text is None:
        return None
    for f in sorted(found, key=lambda f: -f["start"]):
        text = text[: f["start"]] + f"[REDACTED_{f['type'].upper()}]" + text[f["end"] :]
    return text


@F.arrow_udf(FINDINGS)
def _findings(texts: pa.Array) -> pa.Array:
    return pa.array([scan(t) for t in texts.to_pylist()], _KIND)


@F.arrow_udf(T.StringType())
def _redacted(texts: pa.Array) -> pa.Array:
    return pa.array([spliced(t, scan(t)) for t in texts.to_pylist()], pa.string())


def suspect(text: Column) -> Column:
    """Whether a text can hold personal data at all: every pattern needs an ``@`` or six digits close together."""
    return F.contains(text, F.lit("@")) | text.rlike(r"\d(?:[\s.-]*\d){5}")


def findings(text: str) -> Column:
    """Findings of a text column; texts that cannot hold any stay in the JVM."""
    return _findings(F.when(suspect(F.col(text)), F.col(text)))


def redacted(text: str) -> Column:
    return F.when(suspect(F.col(text)), _redacted(F.when(suspect(F.col(text)), F.col(text)))).otherwise(F.col(text))


# fixed values: domains that are sensitive in themselves, and kinds of data that need consent
SENSITIVE_DOMAINS, CONSENT_KINDS = ("finance", "medical", "health", "identity", "legal"), ("account", "clabe", "rfc", "curp")


def search_gate(query: Column, seen: Column, domain: Column, allow: Column, ask_consent: Column) -> Column:
    """``struct(sensitive, kinds, requires_consent, blocked, reason)``: whether a query may be sent to an outside search, by it and by what was read in a picture."""
    text = F.concat_ws("\n", F.coalesce(query, F.lit("")), F.coalesce(seen, F.lit("")))
    kinds = F.array_compact(F.array(*[F.when(text.rlike(pattern), F.lit(kind)) for pattern, kind in QUERY_PATTERNS[:8]]))
    delicate = F.coalesce(domain.isin(*SENSITIVE_DOMAINS), F.lit(False))
    consent = ask_consent & (delicate | F.arrays_overlap(kinds, F.lit(list(CONSENT_KINDS))))
    reason = F.when(~allow, "external_search_disabled").when(consent, "sensitive_external_search_requires_minimization").otherwise("search_allowed_with_minimization")
    return F.struct((delicate | (F.size(kinds) > 0)).alias("sensitive"), kinds.alias("kinds"), consent.alias("requires_consent"), (~allow).alias("blocked"), reason.alias("reason"))


def fingerprint(query: Column) -> Column:
    """The FNV-1a hash of a query as eight hex digits, by which a log can name it."""
    return F.lpad(F.lower(F.hex(fnv1a32(query))), 8, "0")


def safe_query(text: Column, longest: int = 240) -> Column:
    """A search query without personal data and quotes, with single spaces, at most ``longest`` characters (a limit of the feature).

    A label keeps its place and loses the value that follows, whether or not a colon stands between; keeping values that follow a blank would be less safe.
    """
    for pattern, token in QUERY_PATTERNS:
        text = F.regexp_replace(text, pattern, token)
    text = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), '["“”]', "")
    return F.trim(F.substring(text, 1, longest))


def safe_queries(df: DataFrame, key: str, order: str, query: str = "query", top: int = 3) -> DataFrame:
    """Per key the first ``top`` different safe queries that still say something."""
    safe = df.select(key, order, safe_query(F.coalesce(query, F.lit(""))).alias("q"))
    # fixed values: words that say nothing without what they stand for
    said = F.length(F.trim(F.regexp_replace("q", r"(?i)\b(email|phone|account|clabe|rfc|curp|reference|person)\b", ""))) >= 3
    first = safe.filter((F.col("q") != "") & said).groupBy(key, "q").agg(F.min(order).alias("at"))
    return first.groupBy(key).agg(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("at", "q"))), 1, top), lambda x: x["q"]).alias("queries"))


_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"  # a word's edge by ASCII letters, digits and underscores
# fixed values: what is taken out of texts that are sent with a task, and how much of a conversation and of a text may be sent
PACKAGE_PATTERNS = [
    ("EMAIL", rf"(?i){_EDGE}[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}{_EDGE}"), ("PHONE", rf"{_EDGE}(?:\+?52\s*)?(?:\d[\s.-]?){{10}}{_EDGE}"), ("CARD", rf"{_EDGE}(?:\d[ -]*?){{13,19}}{_EDGE}"),
    ("RFC", rf"(?iu){_EDGE}[A-ZÑ&]{{3,4}}\d{{6}}[A-Z0-9]{{3}}{_EDGE}"),
]
MOST_TURNS, TURNS, SUMMARY = 8, 4, 1200


def package_text(text: Column) -> Column:
    """A text as it may be sent with a task: personal data replaced by its kind. Texts that cannot hold any are left as they are."""
    clean = F.coalesce(text, F.lit(""))
    for kind, pattern in PACKAGE_PATTERNS:
        clean = F.regexp_replace(clean, pattern, f"[REDACTED_{kind}]")
    return F.when(suspect(text), clean).otherwise(F.coalesce(text, F.lit("")))


def package_summary(text: Column) -> Column:
    """A read text on one line, of at most 1,200 characters."""
    one = F.trim(F.regexp_replace(package_text(text), r"\s+", " "))
    return F.when(F.length(one) > SUMMARY, F.concat(F.left(one, F.lit(SUMMARY)), F.lit("…"))).otherwise(one)


def package_turns(turns: DataFrame, key: str, order: str, text: str = "text", last: int = TURNS) -> DataFrame:
    """``(key, turns)``: the last turns of a conversation ``(order, text)``, redacted; at most eight."""
    last = max(0, min(MOST_TURNS, last))
    late = turns.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("_k") <= last)
    kept = late.select(key, F.struct(order, package_text(F.col(text)).alias("text")).alias("t")).groupBy(key).agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return turns.select(key).distinct().join(kept, key, "left")
