"""Archive, shards and url filters against brute force, and their edge cases; the pipeline's contract."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import flow_sharding, registry, url_filter, warc_store
from plumbline.llm.common import new_dir, table

SF = "/root/testdata/sf0.001"
PAGES = "page_id bigint, url string, html string, digest string, holder int"


def archived(spark, rows, **limits):
    path = new_dir(spark, "warc")
    df = spark.createDataFrame(rows, PAGES)
    warc_store.write_archive(df, path, "page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8"), **limits)
    return path


def test_archive_equals_brute_force(spark):
    rows = [(k, f"http://h/{k}", f"page é {k % 7}", "x", 1) for k in range(50)] + [(90, None, None, "x", 1), (91, "http://a\r\nb", "", "x", 1), (92, "u", "long " * 200_000, "x", 1)]
    found = {r.record_id: r for r in warc_store.read_records(spark, archived(spark, rows)).collect()}
    last = {}
    for k, _, page, *_ in rows:
        last[page or ""] = max(k, last.get(page or "", -1))
    assert len(found) == len(rows)
    for k, _, page, *_ in rows:
        data, r = (page or "").encode(), found[k]
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        holder = last[page or ""]
        assert (r.record_type, r.refers_to) == (("response", None) if holder == k else ("revisit", holder))
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and block == (data if holder == k else b"") + b"\r\n\r\n"
        assert f"Content-Length: {len(data) if holder == k else 0}".encode() in head


def test_archive_small_payloads_ties_and_damage(spark):
    rows = [(1, "u", "ab", "", 0), (2, "u", "ab", "", 0), (3, "u", "abcdef", "", 0), (3, "u", "abcdef", "", 0), (None, "u", "abcdef", "", 0)]
    path = archived(spark, rows, min_revisit_bytes=5)
    got = sorted((str(r.record_id), r.record_type, r.refers_to) for r in warc_store.read_records(spark, path).collect())
    assert got == [("1", "response", None), ("2", "response", None), ("3", "response", None), ("3", "response", None), ("None", "revisit", 3)]
    blobs = spark.read.parquet(f"{path}/blobs")
    assert blobs.count() == 2
    blobs.withColumn("payload", F.encode(F.lit("changed"), "UTF-8")).write.parquet(f"{path}-bad/blobs")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}-bad/headers")
    with pytest.raises(Exception, match="damaged blob"):
        warc_store.read_records(spark, f"{path}-bad").collect()
    assert warc_store.read_records(spark, archived(spark, [])).count() == 0


def test_archive_export_holds_every_record(spark):
    rows = [(k, "http://h/x", f"body\r\n{k % 3}", "", 0) for k in range(9)]
    path = archived(spark, rows)
    warc_store.export_warc(spark, path, f"{path}-out")
    text = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(f"{path}-out").collect())
    assert all(bytes(r.record) in text for r in warc_store.read_records(spark, path).collect())
    assert text.count(b"WARC/1.1\r\n") == 9


def test_flow_is_least_cost():
    rng = random.Random(1)
    for _ in range(25):
        supply = [rng.randint(0, 5) for _ in range(3)]
        capacity = [rng.randint(0, 4) for _ in range(3)]
        capacity[0] += max(0, sum(supply) - sum(capacity))
        cost = [[rng.randint(0, 3) for _ in range(3)] for _ in range(3)]
        flow = flow_sharding.min_cost_flow(supply, capacity, cost)
        assert [sum(r) for r in flow] == supply and all(sum(c) <= cap for c, cap in zip(zip(*flow, strict=True), capacity, strict=True))
        parts = [[p for p in itertools.product(range(s + 1), repeat=3) if sum(p) == s] for s in supply]
        ways = [w for w in itertools.product(*parts) if all(sum(x) <= c for x, c in zip(zip(*w, strict=True), capacity, strict=True))]
        price = lambda w, cost=cost: sum(a * b for r, c in zip(w, cost, strict=True) for a, b in zip(r, c, strict=True))
        assert price(flow) == min(map(price, ways))


def check_shards(rows, shards):
    for s in range(shards):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_shards_of_the_table(spark):
    rows = registry.op8_sharding(spark, SF.replace("0.001", "0.01")).collect()
    texts = {r.doc_id: r.text for r in table(spark, SF.replace("0.001", "0.01"), "documents").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    check_shards(rows, 16)
    sizes = [sum(r.size for r in rows if r.shard == s) for s in range(16)]
    assert max(sizes) - min(sizes) <= 0.01 * sum(sizes) / 16
    old = [sum(r.size for r in rows if r.old_shard == s) for s in range(16)]
    moved = sum(r.size for r in rows if r.shard != r.old_shard)
    assert moved <= sum(max(0, o - sum(sizes) / 16) for o in old) + 0.02 * sum(sizes)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))


def test_shard_edge_cases(spark):
    rows = [(None, None), (None, ""), (1, "same"), (1, "same"), (2, "x" * 1_000_000), (3, "y"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").select(
        "doc_id", flow_sharding.text_size(F.col("text")).alias("size"), flow_sharding.text_crc32(F.col("text")).alias("crc"), F.lit(0).alias("old")
    )
    got = flow_sharding.reshard(df, "old", "size", ["doc_id", "crc"], 4).collect()
    assert len(got) == len(rows)
    check_shards(got, 4)
    assert flow_sharding.reshard(df.limit(0), "old", "size", ["doc_id", "crc"], 4).count() == 0
    docs = spark.createDataFrame([(k, "t" * k, k % 2) for k in range(60)], "doc_id bigint, text string, old int")
    plan = flow_sharding.reshard(docs.select("doc_id", flow_sharding.text_size(F.col("text")).alias("size"), "old"), "old", "size", ["doc_id"], 3)
    path = flow_sharding.rewrite(docs.select("doc_id", "text"), plan, ["doc_id"], "old")
    back = spark.read.parquet(path)
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(r.doc_id, r.shard) for r in plan.collect() if r.shard != r.old}


def test_shards_are_rewritten_whole(spark, tmp_path):
    rows = [(None if k % 5 == 0 else k % 40, "t" * (k % 90) if k % 7 else None, (0, 0, 1, 2)[k % 4]) for k in range(300)]
    layout = flow_sharding.write_layout(spark.createDataFrame(rows, "doc_id bigint, text string, old int"), "old")
    sized = layout.select("row_id", "doc_id", flow_sharding.text_size(F.col("text")).alias("size"), "old")
    held = [sum(len(t or "") + 1 for _, t, o in rows if o == k) for k in range(3)]
    room = [held[0] // 2, held[1], held[2], held[0] - held[0] // 2]
    plan = flow_sharding.reshard(sized, "old", "size", ["doc_id", "size"], 4, capacities=room, large_share=1.0)
    path = str(tmp_path / "new")
    got = flow_sharding.rewrite_shards(layout, plan, "old", path).collect()
    assert sorted(((r.doc_id, r.text, r.old) for r in got), key=str) == sorted(rows, key=str)
    assert {(r.row_id, r.shard, r.slot) for r in got} == {(r.row_id, r.shard, r.slot) for r in plan.collect()}
    assert {p.name for p in (tmp_path / "new").glob("shard=*")} == {"shard=0", "shard=3"}
    files = spark.read.parquet(path).collect()
    assert sorted((r.row_id, r.shard) for r in files) == sorted((r.row_id, r.shard) for r in got if r.shard in (0, 3))
    assert {r.shard for r in got if r.old == 1} == {1} and {r.shard for r in got if r.old == 2} == {2}
    assert flow_sharding.rewrite_shards(layout.limit(0), plan.limit(0), "old").count() == 0


def test_moved_rows_with_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None if k % 10 else k % 4, "t", k % 2) for k in range(60)], "doc_id bigint, text string, old int")
    plan = flow_sharding.reshard(docs.select("doc_id", flow_sharding.text_size(F.col("text")).alias("size"), "old"), "old", "size", ["doc_id"], 3)
    back = spark.read.parquet(flow_sharding.rewrite(docs.select("doc_id", "text"), plan, ["doc_id"], "old"))
    moved = [(r.doc_id, r.shard) for r in plan.collect() if r.shard != r.old]
    assert any(d is None for d, _ in moved) and sorted(((r.doc_id, r.shard) for r in back.collect()), key=str) == sorted(moved, key=str)


def slow_verdict(url, rules):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None, "allow"
    rest = url[at + 3 :]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


def test_url_verdicts_equal_brute_force(spark):
    rng = random.Random(2)
    urls = [None, "", "no scheme", "://", "http://", "http://COM/en/", "https://Example.COM/en/7?x#y", "http://xcom/en/", "ftp://a.example.net/de/8/9", "http://org/es", "http://b.org/es/", "x://É.com/en/://com/", "http://com?/en/", "http://a.com/en/" + "z" * 100_000]
    for _ in range(2000):
        urls.append(f"{rng.choice(['http', 'https'])}://{rng.choice(['', 'a.', 'www.b.'])}{rng.choice(['example.', 'other.', ''])}{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es'])}/{rng.randint(0, 99)}{rng.choice(['', '/', '?q', '#f'])}")
    df = spark.createDataFrame([(k, u, "old") for k, u in enumerate(urls)], "page_id bigint, url string, rule string")
    got = {r.page_id: r for r in url_filter.judge_urls(df, registry.URL_RULES).collect()}
    for k, u in enumerate(urls):
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == slow_verdict(u, registry.URL_RULES), u
    assert url_filter.judge_urls(df.limit(0), registry.URL_RULES).count() == 0


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = [f"k{k}" for k in range(0, 20_000, 9)]
    levels = url_filter.build_cascade(universe, listed)
    assert len(levels) > 2
    found = {r.key for r in universe.filter(url_filter.in_cascade(F.col("key"), levels)).collect()}
    assert found == set(listed)
    assert url_filter.build_cascade(universe, []) == []


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == names
            path = new_dir(spark, "stage")
            out.write.parquet(path)
            assert 0 < spark.read.parquet(path).count() <= docs.count()
            docs = spark.read.parquet(path)
        else:
            rows = out.collect()
            assert len(rows) == docs.count() and all(r.round_trip for r in rows)


def test_pipeline_on_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def test_two_pipelines_side_by_side(spark):
    """Runs in two threads of one session remove their own scratch folders only."""
    import threading

    found, failed = {}, []

    def run(name):
        try:
            found[name] = sorted((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=run, args=(name,)) for name in ("a", "b")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    assert found["a"] == found["b"] and len(found["a"]) > 50
