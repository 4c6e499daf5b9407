"""Repair of recognised receipt texts: a fold over rewriting rules whose state is the text and a log of what was changed.

Every rule is one step of column expressions on ``(text, log)``: it appends ``(rule, before, after, confidence)`` for each place that it
changes and rewrites the text. Only the Unicode normalisation leaves the JVM, and only for texts that are not ASCII.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = "struct<rule:string,before:string,after:string,confidence:double>"
# fixed values: labels whose letters may stand apart, labels with letters taken for digits, and how sure each repair is
SPLIT = [("SUBTOTAL", "JOIN_SUBTOTAL_LABEL"), ("TOTAL", "JOIN_TOTAL_LABEL"), ("EFECTIVO", "JOIN_EFECTIVO_LABEL"), ("CAMBIO", "JOIN_CAMBIO_LABEL"), ("IVA", "JOIN_IVA_LABEL")]
SPLIT_SURE = 0.98
BROKEN = (r"SUB\s*\n\s*TOTAL", "SUBTOTAL", "JOIN_BROKEN_SUBTOTAL_LINE", 0.98)
CONFUSED = [
    ("SUBT[O0]TAL", "SUBTOTAL", "LABEL_O0_SUBTOTAL", 0.97), ("T[O0]TAL", "TOTAL", "LABEL_O0_TOTAL", 0.97), ("TOTA[I1L]", "TOTAL", "LABEL_IL1_TOTAL", 0.94),
    ("[I1L]VA", "IVA", "LABEL_IL1_IVA", 0.94), ("CAMB[I1L][O0]", "CAMBIO", "LABEL_IL10_CAMBIO", 0.93), ("EFECT[I1L]V[O0]", "EFECTIVO", "LABEL_IL10_EFECTIVO", 0.93),
]
# fixed values: an amount with letters that stand for its digits, and labels whose lines may repeat
AMOUNT = r"(?iu)(?<![A-ZÁÉÍÓÚÑ])(?:\$|MXN\s*|MN\s*)?[\s]*[0-9OIl]{1,7}(?:[ ,.][0-9OIl]{3})*[.,][0-9OIl]{2}(?:\s*(?:MXN|MN))?(?![A-ZÁÉÍÓÚÑ])"
# what an amount with one of these letters holds: the letter, and the digits after it or the separator before it
LETTERED = r"(?iu)(?-iu:[OoIl])[0-9OIl]{0,6}(?:[ ,.][0-9OIl]{3})*[.,][0-9OIl]{2}|[.,](?:(?-iu:[OoIl])[0-9OIl]|[0-9OIl](?-iu:[OoIl]))"
AMOUNT_SURE, REPEAT_SURE, UNICODE_SURE = 0.93, 0.9, 0.99
FINANCIAL = r"(?i)(?<!\w)(?:SUB\s*TOTAL|TOTAL|IVA|EFECTIVO|CAMBIO|DESCUENTO|DESC|PAGO)(?!\w)"
SHOWN = 160
_SPACE = " \t\f\x0b\r"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def shown(text: Column) -> Column:
    """A text as the log holds it: on one line and not too long."""
    one = F.btrim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(one) > SHOWN, F.concat(F.left(one, F.lit(SHOWN - 3)), F.lit("..."))).otherwise(one)


def entries(rule: str, before: Column, after: Column, confidence: float) -> Column:
    return F.transform(before, lambda m: F.struct(F.lit(rule).alias("rule"), shown(m).alias("before"), after.alias("after"), F.lit(confidence).alias("confidence")))


def misspelt(pattern: str, label: str) -> str:
    """A regular expression for the words of ``pattern`` that are not the label itself.

    It asks for the first letter before anything else, so that most places of a text are passed by one comparison.
    """
    first = re.match(r"\[[^]]*\]|\w", pattern)[0]
    return rf"(?i){first}(?<!\w{first})(?!(?<=(?-i:{label[0]}))(?-i:{label[1:]})){pattern[len(first):]}(?!\w)"


def replaced(df: DataFrame, pattern: str, label: str, rule: str, confidence: float) -> DataFrame:
    """One step: every other spelling of a label becomes the label. Texts without one are only looked through once."""
    other = misspelt(pattern, label)
    found = F.col("text").rlike(other)
    log = F.when(found, F.concat("log", entries(rule, F.regexp_extract_all("text", F.lit(other), 0), F.lit(label), confidence))).otherwise(F.col("log"))
    return df.withColumns({"log": log, "text": F.when(found, F.regexp_replace("text", other, label)).otherwise(F.col("text"))})


def amounts(df: DataFrame) -> DataFrame:
    """One step: letters inside amounts become the digits that they look like. Texts without such a letter are only looked through once."""
    found, gaps = F.regexp_extract_all("text", F.lit(AMOUNT), 0), F.regexp_extract_all("text", F.lit(rf"(?s)(.*?)(?:{AMOUNT}|\z)"), 1)
    digits = lambda m: F.translate(m, "OoIl", "0011")
    changed = F.filter(found, lambda m: m != digits(m))
    log = F.transform(changed, lambda m: F.struct(F.lit("AMOUNT_GLYPH_OIL_TO_01").alias("rule"), shown(m).alias("before"), shown(digits(m)).alias("after"), F.lit(AMOUNT_SURE).alias("confidence")))
    text = F.array_join(F.zip_with(gaps, F.transform(found, digits), lambda gap, m: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(m, F.lit("")))), "")
    lettered = F.col("text").rlike(LETTERED)
    return df.withColumns({"log": F.when(lettered, F.concat("log", log)).otherwise(F.col("log")), "text": F.when(lettered, text).otherwise(F.col("text"))})


def repeats(df: DataFrame) -> DataFrame:
    """The last step: a line that repeats the one before it goes, unless it holds a financial label."""
    lines = F.split("text", "\n")
    trimmed = F.transform(lines, lambda x: F.btrim(x, F.lit(_SPACE)))
    again = lambda x, i: (i > 0) & (x != "") & (x == F.get("trimmed", i - 1)) & ~x.rlike(FINANCIAL)
    df = df.withColumn("trimmed", trimmed)
    log = entries("ADJACENT_DUPLICATE_NONFINANCIAL_LINE", F.filter("trimmed", again), F.lit(""), REPEAT_SURE)
    kept = F.array_join(F.filter("trimmed", lambda x, i: ~again(x, i) & (x != "")), "\n")
    return df.withColumn("log", F.concat("log", log)).withColumn("text", kept).drop("trimmed")


def repaired(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``normalized, changed, log, confidence`` to rows with a text; a null text is an empty one."""
    raw = F.coalesce(F.col(text), F.lit(""))
    plain = F.coalesce(_nfkc(F.when(raw.rlike(r"[^\x00-\x7F]"), raw)), raw)
    for pattern, by in ((r"\r\n?", "\n"), (r"[​-‍﻿]", ""), (r"[ \t]+", " ")):
        plain = F.regexp_replace(plain, pattern, by)
    first = F.struct(F.lit("UNICODE_WHITESPACE_NORMALIZATION").alias("rule"), shown(F.col("_raw")).alias("before"), shown(F.col("text")).alias("after"), F.lit(UNICODE_SURE).alias("confidence"))
    state = df.select(*[F.col(c).alias(f"_in_{c}") for c in df.columns], raw.alias("_raw"), plain.alias("text"))
    state = state.withColumn("log", F.when(F.col("text") != F.col("_raw"), F.array(first)).otherwise(F.array().cast(f"array<{ENTRY}>")))
    rules = [(r"\s*".join(label), label, rule, SPLIT_SURE) for label, rule in SPLIT] + [BROKEN, *CONFUSED]
    state = repeats(amounts(reduce(lambda s, rule: replaced(s, *rule), rules, state)))
    least = F.aggregate("log", F.lit(1.0), lambda a, e: F.least(a, e["confidence"]))
    changed = F.col("text") != F.btrim(F.col("_raw"), F.lit(_SPACE + "\n"))
    return state.select(*[F.col(f"_in_{c}").alias(c) for c in df.columns], F.col("text").alias("normalized"), changed.alias("changed"), "log", least.alias("confidence"))
