"""Labelled fields of receipt texts, rule-based classes, masks and codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.states import parsed_amount

# fixed values: labels of receipt fields; a total is not a subtotal
LABELS = {"subtotal": r"^\s*SUB\s?TOTAL\b", "tax": r"^\s*(IVA|TAX)\b", "discount": r"^\s*(DESCUENTO|DISCOUNT)\b", "total": r"^\s*TOTAL\b(?!\s+(DE|PARCIAL|ART))"}
SUMMED = ("tax", "discount")


def receipt_fields(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Labelled amounts in minor units: taxes and discounts are summed over lines, other fields take the last line."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line", "raw"))
    kind = F.coalesce(*[F.when(F.upper("raw").rlike(pattern), name) for name, pattern in LABELS.items()])
    amount = parsed_amount(F.element_at(F.regexp_extract_all("raw", F.lit(r"([0-9][0-9.,]*)"), 1), -1))
    found = lines.withColumns({"kind": kind, "amount": amount}).filter("kind is not null and amount is not null")
    pick = lambda name: F.when(F.col("kind") == name, F.col("amount"))
    fields = [(F.sum(pick(n)) if n in SUMMED else F.max_by("amount", F.when(F.col("kind") == n, F.col("line")))).alias(n) for n in LABELS]
    return df.select(key).join(found.groupBy(key).agg(*fields), key, "left")


def classified(df: DataFrame, rules: list[tuple[str, str, float]], text: str = "text", least: float = 3.0) -> DataFrame:
    """The class with the largest sum of weights of its matching patterns, its score and margin; ``unknown`` below ``least``."""
    names = list(dict.fromkeys(name for name, _, _ in rules))
    score = lambda n: sum((F.when(F.col(text).rlike(p), w).otherwise(0.0) for name, p, w in rules if name == n), F.lit(0.0))
    ranked = F.sort_array(F.array(*[F.struct((-score(n)).alias("s"), F.lit(n).alias("name")) for n in names]))
    out = df.withColumn("_ranked", ranked)
    first, second = -F.col("_ranked")[0]["s"], -F.col("_ranked")[1]["s"]
    return out.withColumns({"score": first, "margin": first - second, "class": F.when(first >= least, F.col("_ranked")[0]["name"]).otherwise("unknown")}).drop("_ranked")


def masked(text: Column, keep: int = 4) -> Column:
    """All but the last characters as stars."""
    return F.when(F.length(text) <= keep, text).otherwise(F.concat(F.repeat(F.lit("*"), F.length(text) - keep), F.right(text, F.lit(keep))))


def corrections(turns: DataFrame, marker: str) -> DataFrame:
    """User turns that start with the marker, with the turn they correct."""
    from pyspark.sql.window import Window

    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.withColumn("corrects", before).filter((F.col("role") == "user") & F.lower("text").rlike(marker))
