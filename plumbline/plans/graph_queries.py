"""Queries of the evidence graph, repaired texts, canonical documents and sanitised events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scalars as fn
from plumbline.operators import documents, photo_graph, repair, sanitise
from plumbline.plans.registry import clamp, query, r
from plumbline.sources import bindings as bind


def photo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as photos: the customer is the session; names, codes and words follow from the numbers."""
    k = F.col("o_orderkey")
    named = F.concat_ws(
        "\n",
        F.when(k % 2 == 0, F.concat(F.lit("Brand: "), F.when(k % 7 < 4, "ACME").otherwise("Bolt & Co"))),
        F.when(k % 3 == 0, F.concat(F.lit("Model "), F.when(k % 9 == 0, "mx/").otherwise("MX-"), k % 4)),
        F.when(k % 5 == 0, F.concat(F.lit("S/N: SER-"), k % 3)),
        F.when(k % 6 == 1, F.concat(F.lit("ERROR e"), k % 13)),
    )
    user = F.when(k % 23 == 0, "a different device").when(k % 7 == 0, "the SAME one")
    label = F.struct(F.when(k % 11 < 6, "Pump").when(k % 11 < 9, "fan").otherwise("valve").alias("label"), (k % 10 / 10).alias("confidence"))
    rows = bind.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("session"), F.col("o_orderdate").alias("at"), k.alias("photo"), named.alias("text"), user.alias("user_text"), F.array(label).alias("labels"),
        F.array(F.col("o_orderstatus")).alias("states"), F.when(k % 8 == 0, F.array(F.lit("lid"), F.lit("hose"), F.lit("wheel"))).otherwise(F.array(F.lit("lid"))).alias("parts"),
    )
    return photo_graph.photo_evidence(rows)


PHOTOS = """p AS (SELECT o_custkey AS s, o_orderkey AS photo, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n,
  CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 7 < 4 THEN 'ACME' ELSE 'Bolt' END END AS brand,
  CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 9 = 0 THEN 'mx/' ELSE 'MX-' END || o_orderkey % 4 END AS model,
  CASE WHEN o_orderkey % 5 = 0 THEN 'SER-' || o_orderkey % 3 END AS serial, CASE WHEN o_orderkey % 6 = 1 THEN 'E' || o_orderkey % 13 END AS code,
  o_orderkey % 23 = 0 AS another, o_orderkey % 7 = 0 AND o_orderkey % 23 <> 0 AS same, o_orderstatus AS state, o_orderkey % 8 = 0 AS many,
  CASE WHEN o_orderkey % 11 < 6 THEN 'pump' WHEN o_orderkey % 11 < 9 THEN 'fan' ELSE 'valve' END AS label, (o_orderkey % 10) / 10 AS sure FROM orders)"""

FOLD = f"""fold(s, n, photo, entity, status, confidence, ents) AS (
  SELECT s, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::DOUBLE, []::STRUCT(id BIGINT, serial VARCHAR, model VARCHAR, brand VARCHAR, labels VARCHAR[])[] FROM (SELECT DISTINCT s FROM p)
  UNION ALL
  SELECT s, n, photo, CASE WHEN known THEN best.id ELSE photo END, status,
    CASE status WHEN 'new_object' THEN 0.9::DOUBLE WHEN 'unresolved' THEN 0.5::DOUBLE WHEN 'likely_new_object' THEN CASE WHEN another THEN 0.98::DOUBLE WHEN best.hard THEN 0.95::DOUBLE ELSE 1 - best.score END ELSE best.score END,
    CASE WHEN known THEN list_transform(ents, lambda e: CASE WHEN e.id = best.id THEN struct_pack(id := e.id, serial := coalesce(e.serial, ps), model := coalesce(e.model, pm), brand := coalesce(e.brand, pb), labels := list_append(e.labels, label)) ELSE e END)
      ELSE list_append(ents, struct_pack(id := photo, serial := ps, model := pm, brand := pb, labels := [label])) END
  FROM (SELECT *, status IN ('same_object', 'probably_same_object') AS known FROM (
    SELECT *, CASE WHEN len(ents) = 0 THEN 'new_object' WHEN another OR best.hard THEN 'likely_new_object' WHEN best.score >= 0.82 AND (best.score - rival >= 0.15 OR len(ents) = 1) THEN 'same_object'
      WHEN best.score >= 0.58 THEN 'probably_same_object' WHEN best.score <= 0.22 THEN 'likely_new_object' ELSE 'unresolved' END AS status
    FROM (SELECT *, list_sort(scored, 'DESC')[1] AS best, coalesce(list_sort(scored, 'DESC')[2].score, 0.0) AS rival FROM (
      SELECT *, list_transform(half, lambda x: struct_pack(score := {clamp('x.a + CASE WHEN x.sb THEN 0.18::DOUBLE WHEN x.db THEN -0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN x.l THEN least(0.28::DOUBLE, sure * 0.25::DOUBLE) ELSE 0.0::DOUBLE END + CASE WHEN same THEN 0.22::DOUBLE ELSE 0.0::DOUBLE END')}, place := -x.i, id := x.id, hard := x.hard)) AS scored
      FROM (SELECT *, list_transform(ents, lambda e, i: struct_pack(i := i, id := e.id, hard := coalesce(e.serial <> ps, false) OR coalesce(e.model <> pm, false), l := list_contains(e.labels, label), sb := coalesce(e.brand = pb, false), db := coalesce(e.brand <> pb, false),
          a := CASE WHEN coalesce(e.model <> pm, false) THEN least(0.05::DOUBLE, CASE WHEN e.serial <> ps THEN 0.0::DOUBLE WHEN e.serial = ps THEN 0.18::DOUBLE + 0.75::DOUBLE ELSE 0.18::DOUBLE END)
            ELSE CASE WHEN e.serial <> ps THEN 0.0::DOUBLE WHEN e.serial = ps THEN 0.18::DOUBLE + 0.75::DOUBLE ELSE 0.18::DOUBLE END + CASE WHEN e.model = pm THEN 0.48::DOUBLE ELSE 0.0::DOUBLE END END)) AS half
        FROM (SELECT p.s, p.n, p.photo, p.another, p.same, p.label, p.sure, lower(p.serial) AS ps, replace(replace(lower(p.model), '-', ''), '/', '') AS pm, lower(p.brand) AS pb, f.ents FROM fold f JOIN p ON p.s = f.s AND p.n = f.n + 1))))))),
g AS MATERIALIZED (SELECT s, n, photo, entity, status, confidence FROM fold WHERE n > 0)"""


@query(f"WITH RECURSIVE {PHOTOS}, {FOLD} SELECT photo, s AS session, entity, status, {r('confidence')} AS confidence FROM g")
def n7_photo_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which object every photo shows, known or founded by it."""
    placed = photo_graph.placed_photos(photo_rows(spark, sf_dir))
    return placed.select("photo", "session", "entity", "status", fn.half_up(F.col("confidence")).alias("confidence"))


@query(f"WITH RECURSIVE {PHOTOS}, {FOLD} SELECT status, count(*) AS photos, count(DISTINCT entity) AS entities, {r('avg(confidence)')} AS confidence FROM g GROUP BY status")
def n7_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often photos show known, new and unresolved objects."""
    placed = photo_graph.placed_photos(photo_rows(spark, sf_dir))
    return placed.groupBy("status").agg(F.count("*").alias("photos"), F.count_distinct("entity").alias("entities"), fn.half_up(F.avg("confidence")).alias("confidence"))


def _once(value: str, where: str = "TRUE") -> str:
    return f"(SELECT entity, string_agg(v, ',' ORDER BY n) AS x FROM (SELECT entity, {value} AS v, min(n) AS n FROM j WHERE {where} GROUP BY 1, 2) GROUP BY entity)"


@query(
    f"""WITH RECURSIVE {PHOTOS}, {FOLD}, j AS MATERIALIZED (SELECT g.entity, p.*, CASE WHEN model IS NOT NULL OR serial IS NOT NULL THEN 'nameplate' WHEN code IS NOT NULL THEN 'display' WHEN many THEN 'overview' ELSE 'unknown_view' END AS view FROM g JOIN p USING (photo)),
m AS (SELECT entity, count(*) AS photos, arg_min(brand, n) FILTER (brand IS NOT NULL) AS brand, arg_min(model, n) FILTER (model IS NOT NULL) AS model, arg_min(serial, n) FILTER (serial IS NOT NULL) AS serial, bool_or(many) AS many FROM j GROUP BY entity)
SELECT m.entity, photos, brand, model, serial, v.x AS views, coalesce(c.x, '') AS error_codes, t.x AS states, CASE WHEN many THEN 'lid,hose,wheel' ELSE 'lid' END AS parts
FROM m LEFT JOIN {_once('view')} v USING (entity) LEFT JOIN {_once('code', 'code IS NOT NULL')} c USING (entity) LEFT JOIN {_once('state')} t USING (entity)"""
)
def a27_entity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all photos of an object say together."""
    photos = photo_rows(spark, sf_dir).withColumn("said", photo_graph.said(texts=False))
    found = photo_graph.summarised(photo_graph.placed_photos(photos, ["said"]), texts=False)
    joined = [F.coalesce(F.array_join(c, ","), F.lit("")).alias(c) for c in ("views", "error_codes", "states", "parts")]
    return found.select("entity", "photos", "brand", "model", "serial", *joined)


# --- damaged receipt texts ---------------------------------------------------------------------------

#: Parts of the damaged texts for each shuffle partition.
DEALT = 4

DAMAGED = f"""{bind.RECEIPTS},
a AS (SELECT receipt AS k, printf('%d.%02d', subtotal // 100, subtotal % 100) AS s, printf('%d.%02d', tax // 100, tax % 100) AS t, printf('%d.%02d', total // 100, total % 100) AS a FROM r),
t AS (SELECT k, 'TIENDA NORTE' || chr(10) || 'FOLIO OIIO' || chr(10) || 'SUBTOTAL ' || s || repeat(chr(10) || 'IVA ' || t, CASE WHEN k % 6 = 0 THEN 2 ELSE 1 END) || chr(10) || 'TOTAL $' || a AS text,
  concat_ws(',', CASE WHEN k % 11 = 0 THEN 'UNICODE_WHITESPACE_NORMALIZATION' END, CASE WHEN k % 3 <> 1 THEN 'JOIN_SUBTOTAL_LABEL' END,
    CASE WHEN k % 3 = 1 THEN 'LABEL_O0_SUBTOTAL' END, CASE WHEN k % 7 = 0 AND k % 11 <> 0 THEN 'LABEL_O0_TOTAL' END,
    CASE WHEN k % 5 = 0 THEN CASE WHEN k % 6 = 0 THEN 'LABEL_IL1_IVA,LABEL_IL1_IVA' ELSE 'LABEL_IL1_IVA' END END,
    CASE WHEN k % 2 = 0 AND regexp_matches(a, '[01]') THEN 'AMOUNT_GLYPH_OIL_TO_01' END, CASE WHEN k % 4 = 0 THEN 'ADJACENT_DUPLICATE_NONFINANCIAL_LINE' END) AS rules FROM a)"""


@query(
    f"""WITH {DAMAGED} SELECT k AS receipt, text, rules, CASE WHEN rules LIKE '%ADJACENT%' THEN 0.9::DOUBLE WHEN rules LIKE '%AMOUNT%' THEN 0.93::DOUBLE WHEN rules LIKE '%LABEL_IL1%' THEN 0.94::DOUBLE WHEN rules LIKE '%LABEL_O0%' THEN 0.97::DOUBLE
  ELSE 0.98::DOUBLE END AS confidence FROM t"""
)
def t6_repaired_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipt texts damaged in known ways, repaired, with the rules that did it."""
    money = lambda c: F.format_string("%d.%02d", F.floor(F.col(c) / 100).cast("bigint"), F.col(c) % 100)
    k = F.col("receipt")
    tax = F.concat(F.when(k % 5 == 0, "1VA ").otherwise("IVA "), money("tax"), F.lit("\n"))
    label = F.when(k % 11 == 0, "ＴＯＴＡＬ").when(k % 7 == 0, "T0TAL").otherwise("TOTAL")
    total = F.when(k % 2 == 0, F.translate(money("total"), "01", "Ol")).otherwise(money("total"))
    text = F.concat(
        F.lit("TIENDA NORTE\n"), F.when(k % 4 == 0, "TIENDA NORTE \n").otherwise(""), F.lit("FOLIO OIIO\n"), F.when(k % 3 == 0, "S U B T O T A L ").when(k % 3 == 1, "SUBT0TAL ").otherwise("SUB\nTOTAL "), money("subtotal"), F.lit("\n"),
        tax, F.when(k % 6 == 0, tax).otherwise(""), label, F.lit(" $"), total,
    )
    # the sums are few bytes, but the repair of their texts is work for many tasks: a given number is not merged again by size
    dealt = bind.receipts(spark, sf_dir).repartition(DEALT * int(spark.conf.get("spark.sql.shuffle.partitions")), "receipt")
    fixed = repair.repaired(dealt.select("receipt", text.alias("text")))
    return fixed.select("receipt", F.col("normalized").alias("text"), F.array_join(F.col("log.rule"), ",").alias("rules"), "confidence")


# --- canonical documents -----------------------------------------------------------------------------

CASE_SQL = """d AS (SELECT o_custkey AS dataset, o_orderkey AS k, o_orderkey::VARCHAR AS "case",
  '{"amount":' || (floor(o_totalprice * 100 + 0.5)::BIGINT) || ',"caseId":"' || o_orderkey || '","difficulty":"' || CASE WHEN o_orderkey % 3 = 0 THEN 'hard' ELSE 'easy' END || '","fields":{"date":"' || o_orderdate::DATE || '","lines":['
  || o_orderkey % 4 || ',{"qty":' || o_orderkey % 9 || '}],"note":null},"receiptType":"' || o_orderpriority || '"}' AS doc FROM orders)"""


def golden_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON cases of their customer's dataset, keys in no order and with blanks."""
    k = F.col("o_orderkey")
    doc = F.concat(
        F.lit('{ "receiptType": "'), "o_orderpriority", F.lit('", "fields": {"note" : null, "lines":[ '), k % 4, F.lit(', {"qty": '), k % 9, F.lit('.0}], "date":"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('"},\n "caseId":"'), k,
        F.lit('","difficulty":"'), F.when(k % 3 == 0, "hard").otherwise("easy"), F.lit('", "amount": '), F.floor(F.col("o_totalprice") * 100 + 0.5).cast("bigint"), F.lit("}"),
    )
    return bind.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dataset"), k.cast("string").alias("case"), k.alias("k"), doc.alias("doc"))


@query(
    f"""WITH {CASE_SQL}, c AS (SELECT dataset, difficulty, count(*) AS n FROM (SELECT dataset, CASE WHEN k % 3 = 0 THEN 'hard' ELSE 'easy' END AS difficulty FROM d) GROUP BY ALL), e AS (SELECT dataset, string_agg(difficulty || '=' || n, ',' ORDER BY difficulty) AS difficulty FROM c GROUP BY dataset)
SELECT d.dataset, count(*) AS cases, 'sha256:' || sha256('[' || string_agg(doc, ',' ORDER BY "case") || ']') AS content_hash, e.difficulty FROM d JOIN e USING (dataset) GROUP BY d.dataset, e.difficulty"""
)
def c1_dataset_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of all customers' datasets: hash of the canonical cases and distribution of difficulty."""
    return documents.manifests(golden_cases(spark, sf_dir), "dataset", "case", "doc", ["difficulty"])


@query("SELECT o_custkey AS dataset, bool_and(o_orderkey % 50 <> 7) AS hash_matches FROM orders GROUP BY o_custkey")
def c1_verify_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests against cases of which some have one altered leaf."""
    cases = golden_cases(spark, sf_dir)
    tampered = cases.withColumn("doc", F.when(F.col("k") % 50 == 7, F.replace(F.col("doc"), F.lit('"qty": '), F.lit('"qty": 1'))).otherwise(F.col("doc")))
    return documents.verified(documents.manifests(cases, "dataset", "case", "doc", []), tampered, "dataset", "case", "doc")


@query("""SELECT o_orderkey::VARCHAR AS "case", '$.fields.lines[1].qty' AS path, (o_orderkey % 9)::VARCHAR AS before, '1' || o_orderkey % 9 AS after FROM orders WHERE o_orderkey % 50 = 7""")
def t16_altered_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which leaf of which case was altered."""
    cases = golden_cases(spark, sf_dir)
    tampered = cases.withColumn("doc", F.when(F.col("k") % 50 == 7, F.replace(F.col("doc"), F.lit('"qty": '), F.lit('"qty": 1'))).otherwise(F.col("doc")))
    return documents.altered(cases, tampered, ["case"], "doc")


@query(
    """SELECT o_orderkey::VARCHAR AS "case", concat_ws(',', floor(o_totalprice * 100 + 0.5)::BIGINT, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'hard' ELSE 'easy' END, o_orderdate::DATE, o_orderkey % 4, o_orderkey % 9, o_orderpriority) AS "values" FROM orders"""
)
def p13_flattened_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leaves of a nested document as texts."""
    return documents.flattened(golden_cases(spark, sf_dir), "case", "doc").select("case", F.array_join("values", ",").alias("values"))


# --- sanitised events --------------------------------------------------------------------------------


@query(
    """WITH e AS (SELECT event_id AS id, event_type || ' by ' || user_id AS words, event_type, user_id FROM events),
h AS (SELECT *, lower(lpad(to_hex(list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(words, ''), lambda c: ord(c)::HUGEINT)), lambda a, c: (xor(a, c) * 16777619) & 4294967295)::BIGINT), 8, '0')) AS fnv FROM e)
SELECT id, event_type AS provider, 'sensitive_field' AS api_key, length(words)::INT AS question_length, fnv AS question_hash, CASE WHEN id % 4 = 0 THEN 501 ELSE length(words) END::INT AS note_shown,
  least(50, user_id % 60 + 1)::INT AS attempts, CASE WHEN id % 3 = 0 THEN 'data_url' END AS picture, 'sensitive_field' AS token, fnv AS asked, 'en' AS lang, 'sensitive_field' AS deep_secret, '[depth-limited]' AS deepest FROM h"""
)
def p9_sanitised_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested audit data of every event, sanitised: structs, arrays, maps, data URLs and too deep a branch."""
    words = F.concat("event_type", F.lit(" by "), "user_id")
    deep = F.struct(words.alias("g"))
    for name in "fedcb":
        deep = F.struct(deep.alias(name), *([F.lit("x").alias("secretKey")] if name == "b" else []))
    data = F.struct(
        F.col("event_type").alias("providerId"), F.lit("SECRET").alias("apiKey"), words.alias("question"), F.when(F.col("event_id") % 4 == 0, F.repeat(F.lit("z"), F.lit(900))).otherwise(words).alias("note"),
        F.sequence(F.lit(0), (F.col("user_id") % 60).cast("int")).alias("attempts"), F.when(F.col("event_id") % 3 == 0, "data:image/png;base64,AAAA").otherwise("none").alias("picture"),
        F.create_map(F.lit("authToken"), F.lit("t"), F.lit("userQuery"), words, F.lit("lang"), F.lit("en")).alias("attributes"), deep.alias("a"),
    )
    rows = bind.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("ts").alias("at"), F.col("user_id").alias("execution"), F.lit(None).cast("string").alias("task"), data.alias("data"))
    d = "data."
    return sanitise.audit_events(rows).select(
        "id", F.col(d + "providerId.value").alias("provider"), F.col(d + "apiKey.kind").alias("api_key"), F.col(d + "question.length").alias("question_length"), F.col(d + "question.hash").alias("question_hash"),
        F.length(d + "note.value").alias("note_shown"), F.size(d + "attempts").alias("attempts"), F.col(d + "picture.kind").alias("picture"), F.col("data.attributes")["authToken"]["kind"].alias("token"),
        F.col("data.attributes")["userQuery"]["hash"].alias("asked"), F.col("data.attributes")["lang"]["value"].alias("lang"), F.col(d + "a.secretKey.kind").alias("deep_secret"), F.col(d + "a.b.c.d.e.f.g").alias("deepest"),
    )
