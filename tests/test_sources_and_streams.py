from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import states
from plumbline.sources import bindings, files
from plumbline.streaming import operators as streaming

SF = "/root/testdata/sf0.001"


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"cases": [{"id": "a", "tags": ["x"]}, {"id": "b", "modality": "voice"}]}))
    rows = files.read_manifest(spark, str(tmp_path / "m.json")).orderBy("id").collect()
    assert [(r.id, r.modality, r.tags) for r in rows] == [("a", None, ["x"]), ("b", "voice", None)]
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(Exception, match="without cases"):
        files.read_manifest(spark, str(tmp_path / "bad.json")).collect()


def test_archive_round_trip_and_tampering(spark, tmp_path):
    df = spark.createDataFrame([("a", "one"), ("b", "two")], "id string, text string")
    files.export_archive(df, str(tmp_path / "x"), "id", "text")
    assert {r.status for r in files.verify_archive(spark, str(tmp_path / "x")).collect()} == {"ok"}
    spark.createDataFrame([("a", "one"), ("b", "changed"), ("c", "new")], "path string, payload string").write.mode("overwrite").parquet(str(tmp_path / "x/entries"))
    assert {r.path: r.status for r in files.verify_archive(spark, str(tmp_path / "x")).collect()} == {"a": "ok", "b": "mismatched", "c": "unexpected"}


def test_assets_log_and_search(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/f.bin").write_bytes(b"abc")
    assert files.read_assets(spark, str(tmp_path / "in")).first().bytes == 3
    files.append_log(spark.createDataFrame([("e1", "failed", "secret text")], "id string, type string, note string"), str(tmp_path / "log"))
    row = spark.read.parquet(str(tmp_path / "log")).first()
    assert row.type == "failed" and row.note.length == 11
    (tmp_path / "s.jsonl").write_text("\n".join(json.dumps({"id": str(k), "url": "u"}) for k in range(30)))
    spark.dataSource.register(files.JsonSearchSource)
    assert spark.read.format("plumbline_search").option("files", str(tmp_path / "s.jsonl")).load().count() == 10


def run_stream(spark, df, tmp_path, build, mode):
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = build(stream).writeStream.outputMode(mode).format("memory").queryName(f"q{abs(hash(str(tmp_path)))}").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(query.name)


@pytest.fixture
def events(spark):
    return bindings.audit_events(spark, SF).withColumn("at", F.col("at").cast("timestamp"))


def test_stream_counters_equal_batch(spark, events, tmp_path):
    got = run_stream(spark, events, tmp_path, lambda s: streaming.outcome_counters(s, ["execution"]), "complete")
    want = streaming.outcome_counters(events, ["execution"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_drops_repeats(spark, events, tmp_path):
    twice = events.union(events)
    got = run_stream(spark, twice, tmp_path, lambda s: streaming.once_within(s, ["seq"]), "append")
    assert got.count() == events.count()


def test_circuit_breaker(spark, tmp_path):
    rows = [(k, t, f"2024-01-01 00:0{i}:00", i) for k, kinds in {1: "ffff", 2: "ffof", 3: "fffo"}.items() for i, t in enumerate({"f": "failed", "o": "noted"}[c] for c in kinds)]
    df = spark.createDataFrame(rows, "execution int, type string, at string, seq int").withColumn("at", F.to_timestamp("at"))
    got = run_stream(spark, df, tmp_path, streaming.circuit_breaker, "update")
    assert {r.key: (r.state, r.failures, r.events) for r in got.collect()} == {"1": ("open", 4, 4), "2": ("closed", 1, 4), "3": ("closed", 0, 4)}


@pytest.mark.parametrize(("a", "b", "want"), [("a b c", "a b c", 0.0), ("a b c d", "a x c", 0.5), ("", "", 0.0), ("", "x", 1.0), ("one two", None, 1.0), ("a b", "a b c d e", 1.5)])
def test_word_error_rate(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(states.word_error_rate(F.col("a"), F.col("b")).alias("x")).first().x == want
