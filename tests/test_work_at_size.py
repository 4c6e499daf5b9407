"""What a row costs and where rows meet: plans of queries that grew too fast, and the results that they must keep."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.scalars import half_up
from plumbline.operators import evidence, papers, repair, routing
from plumbline.plans import registry


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_receipt_types_match_each_indicator_once_and_as_before(spark):
    words = """SPEI clabe CLAVE\tDE\tRASTREO Transferencia BANCO\tRECEPTOR BANCO CUENTA REFERENCIAS REFERENCIA TOTAL\tDE\tARTICULOS TOTAL\tDE\tARTÍCULOS CFDI SATX SAT RÉGIMEN\tFISCAL régimen\tFISCAL USO\tCFDI RFC
    PERMISO\tC.R.E. PERMISO\tCRE LITROS LITRO ESTACIÓN\tDE\tSERVICIO SERVICIOS xSERVICIO SERVICIO_ PRECIO\tPOR\tLITRO VOLUMEN MESAS MESA mesero CAFÉ CAFE TAQUERÍA TACOS OXXO TIENDA\tDE\tCONVENIENCIA RECARGA SUBTOTAL
    IVA CAMBIO ARTICULO ARTÍCULOS CAJERO CAJA ÉCAJA FOLIO\tFISCAL FOLIO SELLO\tDIGITAL 7ticket""".split()
    texts = ["", *(" ".join(words[i::n]) for n in (1, 2, 3, 5, 7, 11, 50) for i in range(min(n, len(words)))), " total\nde\nArticulos iva", "Restaurante\nMESA 4 SERVICIO"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    text = F.col("text")
    total = lambda rules: sum((F.when(text.rlike(p), w).otherwise(0) for p, w in rules), F.lit(0))
    ranked = F.sort_array(F.array(*[F.struct((-total(rules)).alias("s"), F.lit(k).alias("k"), F.lit(n).alias("name")) for k, (n, rules) in enumerate(papers.TYPES.items())]))
    sure = half_up(F.least(F.lit(0.98), 0.55 - ranked[0]["s"] * 0.06 + F.greatest(F.lit(0), ranked[1]["s"] - ranked[0]["s"]) * 0.04), 2)
    known = ranked[0]["s"] <= -3
    want = df.select("k", F.when(known, ranked[0]["name"]).otherwise("unknown"), F.when(known, sure).otherwise(0.0)).orderBy("k").collect()
    typed = df.select("k", papers.receipt_type(text).alias("t")).select("k", "t.*")
    assert typed.orderBy("k").collect() == want
    assert plan(typed).count("RLIKE") <= 2 * len({p for rules in papers.TYPES.values() for p, _ in rules})  # one a pattern and output column; it was over a hundred


def test_special_fields_compile_no_pattern_a_row(spark):
    df = spark.createDataFrame([(1, "CFDI\nRFC EMISOR ABC010203XY1\nUUID 0a1b2c3d-0000-4000-8000-000000000001"), (2, "SPEI\nCUENTA ****43 21\nIMPORTE $1,234.50\nREFERENCIA  "), (3, None)], "id int, text string")
    found = papers.special_fields(df, "id")
    assert "Join" not in plan(found) and "RepartitionByExpression [id" in plan(found)
    want = {(1, "cfdi_invoice", "issuerRfc", "ABC010203XY1"), (1, "cfdi_invoice", "uuid", "0A1B2C3D-0000-4000-8000-000000000001"), (2, "bank_transfer", "accountLast4", "4321"), (2, "bank_transfer", "amount", "123450")}
    assert {tuple(r) for r in found.collect()} == want


def test_merchants_look_for_brands_once_a_line(spark):
    df = spark.createDataFrame([(1, "el florido\nCALLE 5\nTOTAL 3.00"), (2, "Operadora X SA de CV RFC ABC\nOXXO GAS"), (3, "12 MESAS\nab\n--")], "k int, text string")
    found = papers.merchants(papers.lines_of(df, "k"), "k")
    assert plan(found).count(r"WALMART\b, ") + plan(found).count(r"WALMART\b THEN") <= 2
    assert {(r.k, r.merchant, r.kind, r.score) for r in found.collect()} == {(1, "EL FLORIDO", "brand", 11), (2, "OXXO", "brand", 11)}


def test_teachers_are_cut_to_the_best_before_they_are_sorted(spark):
    tasks = spark.sql("select id as task, array('a', 'b') as required, 'es' as language, false as needs_evidence, false as needs_freshness, id = 1 as local_only, false as sensitive, true as consent from range(3)")
    caps = "array(named_struct('capability', 'b', 'score', 0.5D), named_struct('capability', if(id % 5 = 0, 'c', 'a'), 'score', 0.7D))"
    providers = spark.sql(f"select id as provider, {caps} as capabilities, array('auto') as languages, array(if(id = 8, 'local', 'cloud')) as privacy, id <> 3 as healthy, 0.5D as reliability, 0D as evidence, 0D as freshness, 0D as history, 'fast' as latency_class, cast(null as bigint) as measured_ms, if(id < 900, 1, 0) as priority from range(1000)")
    found = routing.ranked_teachers(tasks, providers, "task", 3)
    assert sorted((r.task, r.place, r.provider) for r in found.collect()) == [(0, 1, 1), (0, 2, 2), (0, 3, 4), (1, 1, 8), (2, 1, 1), (2, 2, 2), (2, 3, 4)]
    assert "hashpartitioning(provider" not in found._jdf.queryExecution().executedPlan().toString()


def test_claims_are_counted_without_meeting_themselves_again(spark):
    claims = spark.createDataFrame([(1, "x", "fact", "claimed", [1, 1, 9], True), (1, "y", "opinion", "claimed", [], False), (2, "z", "price", "claimed", [2], True)], "answer int, id string, type string, status string, refs array<int>, fresh_required boolean")
    known = spark.createDataFrame([(1, True, True, True, False), (2, False, True, True, True)], "ref int, usable boolean, search boolean, fresh boolean, qualified boolean")
    judged = evidence.judged_claims(claims, known)
    assert plan(judged).count("Join ") == 1  # with the evidence
    want = {("x", "unsupported", 1, "unknown_evidence_ref,source_quality_insufficient"), ("y", "claimed", 0, ""), ("z", "unsupported", 0, "inactive_evidence_ref,unsupported_price,freshness_evidence_missing")}
    assert {(r.id, r.status, r.usable_refs, ",".join(r.issues)) for r in judged.collect()} == want


def test_photos_are_summarised_without_meeting_their_texts_again(spark):
    found = registry.queries()["a27_entity_summary"](spark, "/root/testdata/sf0.001")
    assert "Join " not in plan(found) and plan(found).count("Relation [") == 1


def test_repairs_are_dealt_and_look_once_at_texts_without_damage(spark):
    found = registry.queries()["t6_repaired_receipts"](spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() >= 8  # all texts of few bytes of sums were one task's
    texts = ["TOTAL 10.00", "total 1O.OO T0TAL TOTAL\nS UB TOTAL", "XT0TAL T0TALX T O TAL_", "1VA 1VA IVA lva\nFOLIO OIIO", "1.OI 1O0 7.O0A $7 O00,1l TOTAL"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = repair.repaired(df).orderBy("id")
    assert [r.normalized for r in got.collect()] == ["TOTAL 10.00", "TOTAL 10.00 TOTAL TOTAL\nSUBTOTAL", "XT0TAL T0TALX T O TAL_", "IVA IVA IVA IVA\nFOLIO OIIO", "1.01 1O0 7.O0A $7 000,11 TOTAL"]
    assert [[e.before for e in r.log] for r in got.collect()] == [[], ["S UB TOTAL", "total", "T0TAL", "1O.OO"], [], ["1VA", "1VA", "lva"], ["1.OI", "$7 O00,1l"]]
    rewrites = plan(got).count("regexp_replace(text#") - plan(got).count("THEN regexp_replace(text#")
    assert rewrites <= 3  # the white space of all texts; it was every rule of every text
