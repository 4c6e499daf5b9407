"""Receipt arithmetic in integer minor units, facts and offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.scalars import half_up

FIELDS = ["subtotal", "tax", "discount", "total"]


def minor(x: Column) -> Column:
    return F.floor(x * 100 + 0.5).cast("bigint")


def checks(receipts: DataFrame) -> DataFrame:
    """The sum check within two minor units, and confidences raised or lowered by it."""
    off = F.col("subtotal") + F.col("tax") - F.col("discount") - F.col("total")
    good = F.abs(off) <= 2
    confidence = F.lit(0.92)
    return receipts.withColumns({"difference": off, "balanced": good, "confidence": F.when(good, F.least(F.lit(0.99), F.greatest(confidence, F.lit(0.97)))).otherwise(F.least(confidence, F.lit(0.74)))})


def facts(receipts: DataFrame, key: str = "receipt") -> DataFrame:
    """Fields to rows ``receipt, field, value, status``."""
    long = receipts.unpivot([key], FIELDS, "field", "value")
    return long.withColumn("status", F.when(F.col("value").isNull(), "unresolved").when(F.col("value") == 0, "empty").otherwise("resolved"))


def identity(offers: DataFrame, brand: str, kind: str, size: int) -> DataFrame:
    """Confidence that an offer is the wanted product: weights 1, 3 and 2 for brand, model and size; other sizes are refused."""
    hit = lambda c, v, w: F.when(F.col(c) == v, w).otherwise(0)
    score = hit("brand", brand, 1) + hit("kind", kind, 3) + hit("size", size, 2)
    return offers.withColumn("confidence", half_up(score / 6)).filter((F.col("size") == size) & (F.col("confidence") >= 0.55))


def ranked_offers(offers: DataFrame) -> DataFrame:
    """Offers that are available and priced, per product by cost and then freshness."""
    order = Window.partitionBy("product").orderBy("cost", F.desc("observed_at"), "offer")
    return offers.filter("available and cost is not null").withColumn("place", F.row_number().over(order))


def merge_equivalent(candidates: DataFrame) -> DataFrame:
    """Candidates with one name, brand and model in lower case become one: best confidence, all references."""
    keys = [F.lower(F.trim(c)).alias(c) for c in ("name", "brand", "model")]
    return candidates.groupBy(*keys).agg(F.max("confidence").alias("confidence"), F.array_join(F.sort_array(F.collect_set("ref")), ",").alias("refs"), F.count("*").alias("merged"))
