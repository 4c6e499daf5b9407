"""Queries that keep their rows in stores of their own and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scalars as fn
from plumbline.plans.registry import query, r
from plumbline.sources import bindings as bind
from plumbline.sources.keyed_store import AssetVault, KeyedStore, listed
from plumbline.sources.places import new_dir

BATCHES = 3

STATES_SQL = f"""e AS (SELECT user_id AS k, day(ts) % {BATCHES} AS b, event_id, event_type AS kind, value FROM events),
saved AS (SELECT k, b, arg_max(kind, event_id) AS state, arg_max(value, event_id) AS value FROM e WHERE kind <> 'error' GROUP BY ALL),
gone AS (SELECT DISTINCT k, b FROM e WHERE kind = 'error' AND value > 30),
ops AS (SELECT k, b * 2 AS turn, state, value, false AS removed FROM saved UNION ALL SELECT k, b * 2 + 1, NULL, NULL, true FROM gone),
now AS (SELECT k, arg_max({{'s': state, 'v': value, 'r': removed}}, turn) AS x FROM ops GROUP BY k),
t AS (SELECT k AS key, x.s AS state, {r('x.v')} AS value FROM now WHERE NOT x.r)"""


def replayed(spark: SparkSession, sf_dir: str) -> KeyedStore:
    """Task states by user: events save them, costly errors remove them; three batches, compacted after the second."""
    store = KeyedStore(spark, new_dir(spark, "task-states"))
    events = bind.table(spark, sf_dir, "events").withColumn("b", F.dayofmonth("ts") % BATCHES)
    for b in range(BATCHES):
        batch = events.filter(F.col("b") == b)
        store.save(batch.filter("event_type <> 'error'").select(F.col("user_id").alias("key"), F.col("event_type").alias("state"), "value", "event_id"), "event_id")
        store.remove(batch.filter("event_type = 'error' and value > 30").select(F.col("user_id").alias("key")))
        if b == 1:
            store.compact()
    return store


@query(f"WITH {STATES_SQL} SELECT key, state, value FROM t")
def s10_task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All task states after a replay of the events."""
    return replayed(spark, sf_dir).list().select("key", "state", fn.half_up(F.col("value")).alias("value"))


@query(f"WITH {STATES_SQL} SELECT state, count(*) AS tasks FROM t WHERE state = 'click' GROUP BY state")
def f2_store_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's list with one predicate given and one left open."""
    return replayed(spark, sf_dir).list(state="click", key=None).groupBy("state").agg(F.count("*").alias("tasks"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 = 0 AND o_custkey % 2 = 0")
def f1_golden_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of one task that have two tags."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    tags = F.array_compact(F.array(F.when(k % 3 == 0, "third"), F.when(c % 2 == 0, "even"), F.lit("order")))
    return listed(bind.table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_orderstatus").alias("task"), tags.alias("tags")), task="O", tags=["third", "even"]).select("id")


@query(
    """WITH a AS (SELECT p_partkey AS k, p_type || '|' || p_size AS c FROM part), kept AS (SELECT k, CASE WHEN k % 4 = 0 THEN upper(c) || '!' ELSE c END AS c FROM a WHERE k % 7 <> 0),
d AS (SELECT c, count(*) AS n, strlen(c) AS b FROM kept GROUP BY c)
SELECT sum(n)::BIGINT AS assets, sum(n * b)::BIGINT AS bytes, count(*) AS contents, sum(b)::BIGINT AS content_bytes, count(*) AS stored FROM d"""
)
def s8_vault_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part descriptions as assets: stored once, some replaced, some removed, what no name holds collected."""
    vault = AssetVault(spark, new_dir(spark, "vault"))
    k, text = F.col("p_partkey"), F.concat_ws("|", "p_type", "p_size")
    part = bind.table(spark, sf_dir, "part")
    vault.put(part.select(k.cast("string").alias("name"), text.cast("binary").alias("content")))
    vault.put(part.filter(k % 4 == 0).select(k.cast("string").alias("name"), F.concat(F.upper(text), F.lit("!")).cast("binary").alias("content")))
    vault.remove(part.filter(k % 7 == 0).select(k.cast("string").alias("name")))
    vault.collect_garbage()
    return vault.stats()
