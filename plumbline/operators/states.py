"""Ordered folds over events and turns: repeats, stages, lifecycles, corrections; text measures between turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.scalars import half_up


def repeated_routes(events: DataFrame, key: str, kind: str, order: list[str]) -> DataFrame:
    """Per key: events whose kind equals the one before, and whether three in a row are equal."""
    w = Window.partitionBy(key).orderBy(*order)
    one, two = F.lag(kind).over(w), F.lag(kind, 2).over(w)
    marked = events.withColumns({"again": F.coalesce(F.col(kind) == one, F.lit(False)), "thrice": F.coalesce((F.col(kind) == one) & (one == two), F.lit(False))})
    return marked.groupBy(key).agg(F.count("*").alias("n"), F.count_if("again").alias("repeats"), F.bool_or("thrice").alias("loops"))


def progressive(events: DataFrame, key: str, rank: str, order: list[str]) -> DataFrame:
    """Events whose stage is not below one already shown."""
    before = F.max(rank).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("shown", before).filter(F.col("shown").isNull() | (F.col(rank) >= F.col("shown"))).drop("shown")


def generations(events: DataFrame, key: str, kind: str, opens: str, closes: str, order: list[str]) -> DataFrame:
    """Per key how often it was opened again after being closed, and whether it is open at the end."""
    w = Window.partitionBy(key).orderBy(*order)
    relevant = events.filter(F.col(kind).isin(opens, closes)).withColumn("before", F.lag(kind).over(w))
    return relevant.groupBy(key).agg(
        F.count_if((F.col(kind) == opens) & (F.col("before") == closes)).alias("reopened"), (F.max_by(kind, F.struct(*order)) == opens).alias("is_open")
    )


def history(facts: DataFrame) -> DataFrame:
    """Facts newest first per entity and type; the newest usable one is current."""
    keys = Window.partitionBy("entity", "type")
    place = F.row_number().over(keys.orderBy(F.desc("observed_at"), F.desc("id")))
    newest = F.max(F.when(F.col("usable"), F.struct("observed_at", "id"))).over(keys)
    return facts.withColumns({"place": place, "is_current": F.coalesce(newest["id"] == F.col("id"), F.lit(False))})


#: Facts observed within so many milliseconds of the newest are of the same time.
CONTEMPORARY_MS = 1000


def current_facts(facts: DataFrame, within_ms: int = CONTEMPORARY_MS) -> DataFrame:
    """Per entity and type ``status, id, value, claims, values``: the newest usable fact, or a conflict where usable facts of its time disagree.

    The newest times are a small table; facts of older times leave before they are gathered.
    """
    usable = facts.filter("usable").withColumn("_ms", F.unix_millis(F.col("observed_at").cast("timestamp")))
    newest = usable.groupBy("entity", "type").agg(F.max("_ms").alias("_newest"))
    near = usable.join(newest, ["entity", "type"]).filter(F.col("_newest") - F.col("_ms") <= within_ms)
    found = near.groupBy("entity", "type").agg(
        F.max_by(F.struct("id", "value"), F.struct("_ms", "id")).alias("last"), F.array_sort(F.collect_set("value")).alias("values"), F.count("*").alias("claims")
    )
    agreed = F.size("values") == 1
    known = found.select("entity", "type", F.when(agreed, "current").otherwise("conflicted").alias("status"), F.when(agreed, F.col("last.id")).alias("id"), F.when(agreed, F.col("last.value")).alias("value"), "claims", "values")
    every = facts.select("entity", "type").distinct()
    return every.join(known, ["entity", "type"], "left").withColumns({"status": F.coalesce("status", F.lit("none")), "claims": F.coalesce("claims", F.lit(0)), "values": F.coalesce("values", F.array().cast(dict(facts.dtypes)["value"].join(("array<", ">"))))})


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != ""))


def turn_overlap(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Share of a turn's distinct words that the turn before it has."""
    own, other = tokens(F.col("text")), tokens(F.lag("text").over(Window.partitionBy(key).orderBy(order)))
    marked = turns.withColumns({"own": own, "other": other})
    share = F.coalesce(F.try_divide(F.size(F.array_intersect("own", "other")), F.size("own")), F.lit(0.0))
    return marked.select(key, order, half_up(F.when(F.col("other").isNull(), 0.0).otherwise(share)).alias("overlap"))


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Levenshtein distance in words over the reference's words, as a fold over rows of the distance table."""
    clean = lambda t: F.filter(F.split(F.lower(F.coalesce(t, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")

    def distance(ref: Column, hyp: Column) -> Column:
        first = F.transform(F.concat(F.array(F.lit("")), hyp), lambda _, j: j.cast("int"))

        def row(above: Column, word: Column) -> Column:
            def cell(done: Column, h: Column) -> Column:
                j = F.size(done)
                cost = F.when(h == word, 0).otherwise(1)
                best = F.least(F.get(above, j - 1) + cost, F.get(above, j) + 1, F.get(done, j - 1) + 1)
                return F.concat(done, F.array(best.cast("int")))

            return F.aggregate(hyp, F.array((F.get(above, F.lit(0)) + 1).cast("int")), cell)

        return F.aggregate(ref, first, row, lambda last: F.element_at(last, -1))

    pair = F.array(F.struct(clean(reference).alias("r"), clean(hypothesis).alias("h")))
    rate = F.transform(pair, lambda p: F.when(F.size(p["r"]) == 0, F.when(F.size(p["h"]) == 0, 0.0).otherwise(1.0)).otherwise(distance(p["r"], p["h"]) / F.size(p["r"])))
    return F.get(rate, F.lit(0))


def parsed_amount(text: Column) -> Column:
    """Minor units of an amount whose last separator, if two digits follow, is the decimal point."""
    digits = F.regexp_replace(text, "[^0-9.,]", "")
    cents = digits.rlike(r"[.,][0-9]{2}$")
    whole = F.regexp_replace(F.when(cents, F.substring(digits, F.lit(1), F.length(digits) - 3)).otherwise(digits), "[.,]", "")
    return F.concat(whole, F.when(cents, F.right(digits, F.lit(2))).otherwise("00")).try_cast("bigint")


def parsed_date(text: Column) -> Column:
    """Day/month/year or ISO dates that exist in the calendar, else null."""
    return F.coalesce(F.try_to_date(text, "d/M/yyyy"), F.try_to_date(text, "yyyy-MM-dd"))
