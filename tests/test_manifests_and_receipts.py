"""Digests of whole corpora, languages and amounts, against plain Python."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from plumbline.functions import scalars as fn
from plumbline.operators import corpus, documents, papers


def test_manifest_digests_do_not_depend_on_the_number_of_rows(spark):
    df = spark.range(-5, 3000).union(spark.sql("select cast(null as bigint)")).toDF("id")
    got = {r.part: (r.rows, r.digest) for r in corpus.manifest(df, "id", ["id"], parts=2).collect()}
    for part in (0, 1):
        rows = sorted(hashlib.sha256(str(i).encode()).hexdigest() for i in range(-5, 3000) if i % 2 == part)
        assert got.pop(part) == (len(rows), hashlib.sha256("".join(rows).encode()).hexdigest())
    assert got == {None: (1, None)}
    big = spark.range(140_000).toDF("id")  # more than a thousand rows a part
    rows = sorted(hashlib.sha256(str(i).encode()).hexdigest() for i in range(5, 140_000, 64))
    assert corpus.manifest(big, "id", ["id"]).filter("part = 5").collect() == [(5, len(rows), hashlib.sha256("".join(rows).encode()).hexdigest())]


def test_spanish_words_end_at_letters_with_accents(spark):
    texts = ["AI!! ÈQUE!! OUO", "thê_que quex", "so que no", "el año", "plain", "12", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    assert [r.x for r in df.orderBy("k").select(fn.language_of(F.col("text")).alias("x")).collect()] == ["es", "en", "es", "es", "en", "unknown", "unknown"]


def test_amounts_of_a_million_keep_their_first_digit(spark):
    text = "SUBTOTAL $ 905,770.80\nIVA 16% 144,923.33\nDescuento -33,046.33\nTOTAL 51017647.80\nEFECTIVO $1,017,747.80\nCAMBIO $100.00"
    small = "SUBTOTAL $ 100.00\nIVA 16% 16.00\nTOTAL 5116.00"
    df = spark.createDataFrame([(1, text), (2, small)], "k int, text string")
    got = {r.k: (r.total, r.cash, r.recovered) for r in papers.recovered_totals(papers.money_fields(papers.lines_of(df, "k"), "k")).collect()}
    assert got == {1: (5_101_764_780, 101_774_780, False), 2: (11_600, None, True)}


def test_leaves_of_all_documents_are_not_broadcast(spark):
    df = spark.createDataFrame([("a", '{"x": [1, {"y": 2}], "z": null}'), ("b", "{}"), ("c", "no json")], "k string, doc string")
    found = documents.flattened(df, "k", "doc")
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.k: r["values"] for r in found.collect()} == {"a": ["1", "2"], "b": [], "c": []}
