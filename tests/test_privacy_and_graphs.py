"""Personal data against hand-made texts, and walks over long and cyclic graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import golden, graph, papers, privacy


def test_findings_and_overlapping_redaction(spark):
    card = "4539578763621486"
    text = f"Call +52 55 1234 5678, mail ana@example.com, RFC ABCD010203XY1, card {card}, not 4539578763621487"
    found = privacy.scan(text)
    assert [f["type"] for f in found] == ["rfc", "email", "phone", "payment_card"]
    assert all(text[f["start"] : f["end"]].strip() for f in found)
    assert privacy.luhn(card) and not privacy.luhn("4539578763621487") and not privacy.luhn("42")
    clean = privacy.spliced(text, found)
    assert card not in clean and "ana@" not in clean and "[REDACTED_RFC]" in clean and clean.endswith("not 4539578763621487")
    overlapping = [{"type": "rfc", "start": 2, "end": 8}, {"type": "phone", "start": 4, "end": 6}]
    assert privacy.spliced("0123456789", overlapping) == "01[REDACTED_RFC]ACTED_PHONE]6789"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "nothing here")], "id int, text string")
    rows = {r.id: r.clean for r in df.select("id", privacy.redacted("text").alias("clean")).collect()}
    assert rows == {1: clean, 2: None, 3: "", 4: "nothing here"}


def test_safe_queries(spark):
    asked = ['price of "pump" for ana@example.com', "name: Juana Perez de la Cruz", "call 5512345678", "price of “pump” for bo@example.org", "model 4 manual", "folio: ABC123456789 status", "w " * 300]
    df = spark.createDataFrame([("c", k, q) for k, q in enumerate(asked)], "conv string, turn int, query string")
    row = privacy.safe_queries(df, "conv", "turn").first()
    assert row.queries[:2] == ["price of pump for email", "call phone"]
    assert len(row.queries) == 3
    assert df.select(F.max(F.length(privacy.safe_query(F.col("query"))))).first()[0] <= 240


def test_compare_trees(spark):
    rows = [
        (1, '{"a":1,"b":{"c":[1,2]},"d":"x"}', '{"a":1.0,"b":{"c":[1,2]},"d":"y"}'),
        (2, '{"a":{"$oneOf":["x",{"k":1}]},"l":{"$includes":[2,"z"]}}', '{"a":{"k":1},"l":["z",3,2]}'),
        (3, '{"l":{"$includes":[2]},"m":null}', '{"l":2}'),
        (4, "{}", "{}"),
    ]
    got = {r.id: r for r in golden.compared(spark.createDataFrame(rows, "id int, expected string, actual string"), "id").collect()}
    assert (got[1].checks, got[1].score, got[1].failures) == (3, 67, "$.d")
    assert got[2].passed and got[2].score == 100
    assert got[3].failures == "$.l,$.m" and got[3].score == 0
    assert got[4].passed and got[4].checks == 0


def test_graphs_deeper_than_a_dozen(spark):
    n = 40
    nodes = spark.createDataFrame([(str(k), "pending", False) for k in range(n)], "id string, state string, optional boolean")
    edges = spark.createDataFrame([(str(k), str(k - 1)) for k in range(1, n)], "id string, dep string")
    assert graph.descendants(edges, "0").count() == n
    assert {r.id: r.level for r in graph.levels(nodes, edges).collect()} == {str(k): k for k in range(n)}
    assert graph.issues(nodes, edges).count() == 0
    looped = edges.union(spark.createDataFrame([("10", "12")], "id string, dep string"))
    assert {int(r.id) for r in graph.issues(nodes, looped).filter("issue = 'cycle'").collect()} == set(range(10, n))


def test_receipt_lines_and_fields(spark):
    texts = [
        (1, "ＯＸＸＯ\nSUBTOTAL $100.00 IVA 16% 16.00 TOTAL $116.00\nEFECTIVO 200.00 CAMBIO 84.00\n31/02/2024\n12 DE MARZO DE 2024"),
        (2, "TOTAL DE ARTICULOS 3\nTOTAL PARCIAL 9.99\nDESC. 5,00\nDESCUENTO 1.234,50"),
        (3, None),
        (4, "SUBTOTAL 100.00\nIVA 16.00\nTOTAL 5116.00"),
    ]
    df = spark.createDataFrame(texts, "id int, text string")
    made = papers.parsed(df, "id")
    fields = {r.id: r for r in made["fields"].collect()}
    assert (fields[1].subtotal, fields[1].tax, fields[1].total, fields[1].cash, fields[1].change) == (10000, 1600, 11600, 20000, 8400)
    assert fields[2].total is None and fields[2].discount == 500 + 123450
    assert fields[4].total == 11600 and fields[4].recovered
    assert {r.id: str(r.date) for r in made["dates"].collect()} == {1: "2024-03-12"}
    assert {r.id: r.merchant for r in made["merchants"].collect()}[1] == "OXXO"
    assert {r.check for r in made["checks"].filter("id = 1 and status = 'supported'").collect()} == {"cash-change-total", "subtotal-tax-total", "subtotal-iva-rate-tax"}


def test_long_chains_take_few_rounds(spark, monkeypatch):
    seen = []
    original = graph._checkpointed
    monkeypatch.setattr(graph, "_checkpointed", lambda df: seen.append(1) or original(df))
    n = 1000
    nodes = spark.createDataFrame([(str(k), "pending", False) for k in range(n)], "id string, state string, optional boolean")
    edges = spark.createDataFrame([(str(k), str(k - 1)) for k in range(1, n)], "id string, dep string")
    assert {r.id: r.level for r in graph.levels(nodes, edges).collect()} == {str(k): k for k in range(n)}
    assert len(seen) <= 20
    seen.clear()
    assert {int(r.id) for r in graph.descendants(edges, "400").collect()} == set(range(400, n))
    assert len(seen) <= 20


def test_random_graphs_equal_a_walk(spark):
    import random

    rng = random.Random(4)
    for share in (0.3, 0.9):
        pairs = {(f"n{a}", f"n{rng.randrange(max(1, a))}") for a in range(1, 60) for _ in range(rng.choice([0, 1, 1, 2]))} | {("n3", "n9"), ("n9", "n3"), ("n50", "n9"), ("n7", "gone")} if share < 0.5 else {(f"n{a}", f"n{rng.randrange(a)}") for a in range(1, 60) for _ in range(rng.choice([1, 2]))}
        names = [f"n{k}" for k in range(60)]
        deps = {x: [d for i, d in pairs if i == x and d in names] for x in names}
        level = {}
        while True:
            ready = [x for x in names if x not in level and all(d in level for d in deps[x])]
            if not ready:
                break
            level |= {x: max([level[d] + 1 for d in deps[x]], default=0) for x in ready}
        reach = {"n3"}
        while more := {i for i, d in pairs if d in reach} - reach:
            reach |= more
        nodes = spark.createDataFrame([(x, "pending", False) for x in names], "id string, state string, optional boolean")
        edges = spark.createDataFrame(sorted(pairs), "id string, dep string")
        assert {r.id: r.level for r in graph.levels(nodes, edges).collect()} == level
        assert {r.id for r in graph.descendants(edges, "n3").collect()} == reach
        assert {r.id for r in graph.issues(nodes, edges).filter("issue = 'cycle'").collect()} == set(names) - set(level)


def test_estimated_sizes_of_walks_do_not_square(spark):
    steps = [(f"n{k}", f"n{k - 1}") for k in range(1, 600)] + [("a", "b"), ("b", "a")]
    jumps = graph._jumps(spark.createDataFrame(steps, "id string, dep string"))
    assert len(str(jumps._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 20
