"""The circuit breaker's timers, on a stream of one file a batch."""

from __future__ import annotations

import os
import time

from pyspark.sql import functions as F

from plumbline.streaming.breaker import circuit_breaker


def run(spark, tmp_path, batches, **limits):
    schema = "execution string, type string, at timestamp, seq long"
    place = tmp_path / "in"
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "execution string, type string, at string, seq long").withColumn("at", F.to_timestamp("at"))
        df.coalesce(1).write.mode("append").parquet(str(place))
        for name in os.listdir(place):
            if name.endswith(".parquet") and os.path.getmtime(place / name) > 1e9 + len(batches):
                os.utime(place / name, (1e9 + k, 1e9 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(place))
    name = f"breaker{time.time_ns()}"
    seen = []
    query = circuit_breaker(stream, **limits).writeStream.outputMode("update").foreachBatch(lambda df, k: seen.extend((k, *r) for r in df.collect())).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return seen


def test_half_open_and_forgotten_without_another_event(spark, tmp_path):
    t = lambda minutes: f"2024-01-01 {minutes // 60:02d}:{minutes % 60:02d}:00"
    batches = [
        [("a", "failed", t(0), 2), ("a", "failed", t(0), 1), ("a", "failed", t(1), 3), ("b", "failed", t(0), 1), ("b", "done", t(1), 2), ("b", "failed", t(1), 3)],
        [("other", "done", t(5), 1)],
        [("other", "done", t(20), 2)],
        [("other", "done", t(21), 3), ("b", "failed", t(21), 4), ("b", "failed", t(21), 5)],
        [("other", "done", t(200), 4)],
        [("other", "done", t(201), 5)],
    ]
    seen = run(spark, tmp_path, batches, limit=3, cooldown_seconds=600, idle_seconds=7200)
    of = lambda key: [r[2:] for r in seen if r[1] == key]
    assert of("a") == [("open", 3, 3), ("half_open", 3, 3), ("forgotten", 3, 3)]
    assert of("b")[:2] == [("closed", 1, 3), ("open", 3, 5)]
    assert {r[0] for r in of("b")[2:]} <= {"half_open", "forgotten"} and of("b")[-1][0] == "forgotten"
    assert [r[0] for r in of("other")][:5] == ["closed"] * 5


def test_success_closes_and_order_inside_a_batch_does_not_matter(spark, tmp_path):
    t = lambda seconds: f"2024-01-01 00:00:{seconds:02d}"
    seen = run(spark, tmp_path, [[("a", "failed", t(k), k) for k in (3, 1, 2, 0)], [("a", "done", t(9), 9), ("a", "failed", t(10), 10), ("a", "failed", t(8), 8)]], limit=3)
    assert [r[2:] for r in seen if r[2] in ("open", "closed")] == [("open", 4, 4), ("closed", 1, 7)]
