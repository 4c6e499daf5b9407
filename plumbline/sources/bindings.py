"""Projections of the driver's tables into the operators' schemas, each with the same text in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.receipts import minor


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bench_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, k = F.pmod("user_id", F.lit(5)), F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.concat_ws("-", F.concat(F.lit("e"), u), F.dayofmonth("ts")).alias("session"), F.concat(F.lit("e"), u).alias("engine"),
        F.col("event_type").alias("scenario"), F.pmod("user_id", F.lit(3)).alias("device"),
        (~((F.col("event_type") == "error") & (k < 5 + 20 * u))).alias("ok"),
        (F.col("value") * 20).alias("latency_ms"), (F.col("value") * 8).alias("first_useful_ms"), F.col("value").alias("memory_mb"),
        (0.72 + 0.30 * k / 99 - 0.03 * u).alias("quality"), F.col("ts").alias("recorded_at"), F.col("event_id").alias("seq"),
    )


BENCH = """b AS (
  SELECT 'e' || (user_id % 5) || '-' || day(ts) AS session, 'e' || (user_id % 5) AS engine, event_type AS scenario, user_id % 3 AS device,
    NOT (event_type = 'error' AND (props->>'$.k')::INT < 5 + 20 * (user_id % 5)) AS ok, value * 20 AS latency_ms, value * 8 AS first_useful_ms,
    value AS memory_mb, 0.72::DOUBLE + 0.30::DOUBLE * (props->>'$.k')::INT / 99 - 0.03::DOUBLE * (user_id % 5) AS quality, ts AS recorded_at, event_id AS seq
  FROM events)"""


def ocr_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("strategy"), F.col("l_linestatus").alias("difficulty"), F.col("l_linenumber").alias("kind"),
        (F.col("l_extendedprice") / 10).alias("elapsed_ms"), (F.col("l_discount") > 0.08).alias("failed"), (F.col("l_quantity") > 45).alias("cold"),
        (F.col("l_suppkey") % 9 != 0).alias("field_ok"), (F.col("l_suppkey") % 7 != 0).alias("critical_ok"), (F.col("l_partkey") % 5 != 0).alias("total_ok"), (F.col("l_partkey") % 8 != 0).alias("date_ok"),
        (F.col("l_orderkey") % 6 == 0).alias("fallback"), (F.col("l_orderkey") % 4 == 0).alias("cache_hit"), (F.col("l_tax") > 0.07).alias("timeout"),
    )


OCR = """o AS (SELECT l_returnflag AS strategy, l_linestatus AS difficulty, l_linenumber AS kind, l_extendedprice / 10 AS elapsed_ms,
  l_discount > 0.08 AS failed, l_quantity > 45 AS cold, l_suppkey % 9 <> 0 AS field_ok, l_suppkey % 7 <> 0 AS critical_ok, l_partkey % 5 <> 0 AS total_ok, l_partkey % 8 <> 0 AS date_ok,
  l_orderkey % 6 = 0 AS fallback, l_orderkey % 4 = 0 AS cache_hit, l_tax > 0.07 AS timeout FROM lineitem)"""


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice")
    total = F.col("subtotal") + F.col("tax") - F.col("discount") + F.when(F.col("receipt") % 7 == 0, 500).otherwise(0)
    return (
        table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("receipt"))
        .agg(F.sum(minor(price)).alias("subtotal"), F.sum(minor(price * F.col("l_tax"))).alias("tax"), F.sum(minor(price * F.col("l_discount"))).alias("discount"))
        .withColumn("total", total)
    )


RECEIPTS = """r0 AS (SELECT l_orderkey AS receipt, sum(floor(l_extendedprice * 100 + 0.5)::BIGINT)::BIGINT AS subtotal,
  sum(floor(l_extendedprice * l_tax * 100 + 0.5)::BIGINT)::BIGINT AS tax, sum(floor(l_extendedprice * l_discount * 100 + 0.5)::BIGINT)::BIGINT AS discount
  FROM lineitem GROUP BY 1),
r AS (SELECT *, subtotal + tax - discount + CASE WHEN receipt % 7 = 0 THEN 500 ELSE 0 END AS total FROM r0)"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims about parts: value, family (supplier group) and weight."""
    odd = ((F.col("l_suppkey") % 10 == 0) & (F.col("l_partkey") % 3 == 0)).cast("int")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    weight = 0.55 * (0.5 + 0.05 * (F.col("l_suppkey") % 9)) + 0.25 * F.when(F.col("l_linenumber") == 1, 1.0).otherwise(0.55) + 0.2 * 0.65
    return table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_partkey").alias("claim"), (F.col("p_size") + odd).alias("value"), (F.col("l_suppkey") % 7).alias("family"), weight.alias("weight")
    )


STATEMENTS = """s AS (SELECT l_partkey AS claim, p_size + (l_suppkey % 10 = 0 AND l_partkey % 3 = 0)::INT AS value, l_suppkey % 7 AS family,
  0.55::DOUBLE * (0.5::DOUBLE + 0.05::DOUBLE * (l_suppkey % 9)) + 0.25::DOUBLE * CASE WHEN l_linenumber = 1 THEN 1.0::DOUBLE ELSE 0.55::DOUBLE END + 0.2::DOUBLE * 0.65::DOUBLE AS weight
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("value"),
        F.col("o_orderdate").alias("observed_at"), (F.col("o_orderkey") % 11 != 0).alias("usable"), F.col("o_orderkey").alias("id"),
    )


FACTS = """f AS (SELECT o_custkey AS entity, o_orderpriority AS type, o_orderstatus AS value, o_orderdate AS observed_at, o_orderkey % 11 <> 0 AS usable, o_orderkey AS id FROM orders)"""


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "started").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "click", "warned").otherwise("noted")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("execution"), kind.alias("type"), (F.get_json_object("props", "$.k").cast("int") % 4).alias("code"), F.col("ts").alias("at"), F.col("event_id").alias("seq")
    )


AUDIT = """a AS (SELECT user_id AS execution, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'completed'
  WHEN 'click' THEN 'warned' ELSE 'noted' END AS type, (props->>'$.k')::INT % 4 AS code, ts AS moment, event_id AS seq FROM events)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.pmod(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint"), F.lit(3_600_000).cast("bigint"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("trace"), F.col("event_id").alias("span"), start.alias("start"), (start + F.floor(F.col("value") * 1000).cast("bigint")).alias("end")
    )


SPANS = """p AS (SELECT user_id AS trace, event_id AS span, (epoch_us(ts) // 1000) % 3600000 AS "start",
  (epoch_us(ts) // 1000) % 3600000 + floor(value * 1000)::BIGINT AS "end" FROM events)"""


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("offer"), F.col("l_partkey").alias("product"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"),
        F.col("p_size").alias("size"), minor(F.col("l_extendedprice") / F.col("l_quantity")).alias("cost"), (F.col("l_returnflag") != "R").alias("available"), F.col("l_shipdate").alias("observed_at"),
    )


OFFERS = """f AS (SELECT l_orderkey * 10 + l_linenumber AS offer, l_partkey AS product, p_brand AS brand, p_type AS kind, p_size AS size,
  floor(l_extendedprice / l_quantity * 100 + 0.5)::BIGINT AS cost, l_returnflag <> 'R' AS available, l_shipdate AS observed_at
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""



def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task graph from the parts of all orders: node ``lane-n``, chains of up to twenty with cross links."""
    k = F.col("p_partkey")
    name = F.concat_ws("-", F.floor(k / 20), k % 20)
    state = F.element_at(F.array(*map(F.lit, ("completed", "pending", "failed", "skipped"))), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(name.alias("id"), state.alias("state"), (F.col("p_size") % 3 == 0).alias("optional"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    lane, at = F.floor(k / 20), k % 20
    name = lambda n: F.concat_ws("-", lane, n)
    deps = F.array(F.when(at > 0, name(at - 1)), F.when((at > 5) & (at % 3 == 0), name(at - 4)))
    return table(spark, sf_dir, "part").select(name(at).alias("id"), F.explode(F.array_compact(deps)).alias("dep"))


GRAPH = """pk AS (SELECT p_partkey // 20 AS lane, p_partkey % 20 AS pos, p_size FROM part),
n(id, state, optional) AS (SELECT lane || '-' || pos, ['completed', 'pending', 'failed', 'skipped'][(p_size % 4 + 1)::INT], p_size % 3 = 0 FROM pk),
d(id, dep) AS (SELECT lane || '-' || pos, lane || '-' || (pos - 1) FROM pk WHERE pos > 0 UNION ALL SELECT lane || '-' || pos, lane || '-' || (pos - 4) FROM pk WHERE pos > 5 AND pos % 3 = 0)"""
