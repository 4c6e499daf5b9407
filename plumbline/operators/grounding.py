"""Words that point at something, grounded in the regions of a picture by an inverted index.

A region is indexed under every kind of reference that it can answer, with its score for it: sides by its centre, codes and
lights by its tags, objects, and the ordinal that it has in a clear row or column of objects. The index keeps the best two regions of a
picture and kind, so references meet it in one equi-join and never the regions themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values: what a region's place, tags and kind are worth to a reference
SIDE, NEAR_SIDE, ERROR_CODE, ANY_CODE, LIGHT, COLOUR, OBJECT, ORDINAL, LEAST_SURE = 0.78, 0.45, 0.9, 0.66, 0.55, 0.45, 0.65, 0.92, 0.65
# fixed values: scores, leads and ceilings of a resolved and a tentative answer; how far objects of a row must spread
RESOLVED, TENTATIVE = (0.8, 0.2, 0.98), (0.6, 0.25, 0.78)
SPREAD, LEAST_SPREAD, MOST_ORDINAL = 1.6, 0.08, 9


def _side(centre: Column, beyond: bool) -> Column:
    return F.when(centre >= 0.6 if beyond else centre <= 0.4, SIDE).when(centre >= 0.5 if beyond else centre <= 0.5, NEAR_SIDE)


def terms() -> dict[str, Column]:
    """What a region ``x, y, w, h, tags, is_object`` is worth to each kind of reference; null: nothing."""
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    has = lambda tag: F.coalesce(F.array_contains("tags", tag), F.lit(False))
    light = lambda colour: F.nullif(F.when(has("indicator"), LIGHT).otherwise(0.0) + F.when(has(f"color:{colour}"), COLOUR).otherwise(0.0), F.lit(0.0))
    return {
        "right_side": _side(cx, True), "left_side": _side(cx, False), "lower_area": _side(cy, True), "upper_area": _side(cy, False),
        "displayed_code": F.when(has("error_code"), ERROR_CODE).when(has("number_or_code"), ANY_CODE), "red_indicator": light("red"), "green_indicator": light("green"), "this_object": F.when(F.col("is_object"), OBJECT),
    }


def ordinal_regions(regions: DataFrame, picture: str) -> DataFrame:
    """``(picture, term, region, score, confidence)``: objects of pictures with a dominant row or column, by their place in it."""
    objects = regions.filter(F.col("is_object") & F.col("x").isNotNull()).withColumns({"cx": F.col("x") + F.col("w") / 2, "cy": F.col("y") + F.col("h") / 2})
    span = objects.groupBy(picture).agg(F.count("*").alias("n"), (F.max("cx") - F.min("cx")).alias("dx"), (F.max("cy") - F.min("cy")).alias("dy"), F.avg("w").alias("aw"), F.avg("h").alias("ah"))
    wide = lambda d, size, other: (F.col(d) >= F.greatest(F.lit(LEAST_SPREAD), F.col(size))) & (F.col(d) >= F.col(other) * SPREAD)
    axis = F.when(F.col("n") < 2, None).when(wide("dx", "aw", "dy"), "x").when(wide("dy", "ah", "dx"), "y")
    rows = objects.join(span.select(picture, axis.alias("axis")).filter("axis is not null"), picture)
    place = F.row_number().over(Window.partitionBy(picture).orderBy(F.when(F.col("axis") == "x", F.col("cx")).otherwise(F.col("cy")), "region"))
    placed = rows.withColumn("place", place).filter(F.col("place") <= MOST_ORDINAL)
    return placed.select(picture, F.concat(F.lit("ordinal_"), "place").alias("term"), "region", F.lit(ORDINAL).alias("score"), "confidence")


def index(regions: DataFrame, picture: str) -> DataFrame:
    """``(picture, term, region, score, second)``: the best region of a picture for each kind of reference, and the score of the next."""
    sure = F.greatest(F.lit(LEAST_SURE), F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(LEAST_SURE)))
    worth = F.array(*[F.struct(F.lit(t).alias("term"), s.alias("worth")) for t, s in terms().items()])
    each = regions.select(picture, "region", "confidence", sure.alias("sure"), F.explode(F.filter(worth, lambda e: e["worth"] > 0)).alias("e"))
    scored = each.select(picture, F.col("e.term").alias("term"), "region", F.least(F.lit(1.0), F.col("e.worth") * F.col("sure")).alias("score"), "confidence")
    order = Window.partitionBy(picture, "term").orderBy(F.desc("score"), F.desc("confidence"), "region")
    ranked = scored.unionByName(ordinal_regions(regions, picture)).withColumn("k", F.row_number().over(order)).filter("k <= 2")
    return ranked.groupBy(picture, "term").agg(F.min_by("region", "k").alias("region"), F.max("score").alias("score"), F.max(F.when(F.col("k") == 2, F.col("score"))).alias("second"))


def grounded(references: DataFrame, regions: DataFrame, picture: str) -> DataFrame:
    """References ``(picture, reference, term)`` with ``status, region, confidence, reason``; the region only where the answer is clear enough."""
    best = references.join(index(regions, picture), [picture, "term"], "left")
    lead, alone = F.col("score") - F.coalesce("second", F.lit(0.0)), F.col("second").isNull()
    clear = lambda limit: (F.col("score") >= limit[0]) & ((lead >= limit[1]) | alone)
    status = F.when(clear(RESOLVED), "resolved").when(clear(TENTATIVE), "tentative").otherwise("unresolved")
    rows = best.withColumn("status", status)
    confidence = F.when(F.col("status") == "resolved", F.least(F.lit(RESOLVED[2]), "score")).when(F.col("status") == "tentative", F.least(F.lit(TENTATIVE[2]), "score")).otherwise(0.0)
    reason = F.when(F.col("score").isNull(), "NO_REGION_EVIDENCE").when(F.col("status") == "resolved", "UNIQUE_REGION_EVIDENCE").when(F.col("status") == "tentative", "AMBIGUOUS_BUT_PLAUSIBLE").otherwise("AMBIGUOUS_REGION_EVIDENCE")
    return rows.select(picture, "reference", "term", "status", F.when(F.col("status") != "unresolved", F.col("region")).alias("region"), confidence.alias("confidence"), reason.alias("reason"))
