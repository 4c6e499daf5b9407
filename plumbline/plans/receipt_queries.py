"""Queries over receipt texts that are written from ``lineitem``; their SQL works from the numbers, not from the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import papers
from plumbline.plans.registry import query, r
from plumbline.sources import bindings as bind

MONTH_NAMES = ["ENERO", "FEBRERO", "MARZO", "ABRIL", "MAYO", "JUNIO", "JULIO", "AGOSTO", "SEPTIEMBRE", "OCTUBRE", "NOVIEMBRE", "DICIEMBRE"]
HEADS = ["OXXO SUCURSAL 12", "TIENDA EL FLORIDO", "Operadora del Norte SA de CV", "Restaurante Luna"]


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts as text: glued labels, misread currency signs, misleading totals, three kinds of dates, four kinds of heads."""
    k = F.col("receipt")
    money = lambda c: F.format_number(c / 100, 2)
    plain = lambda c: F.replace(F.format_number(c / 100, 2), F.lit(","), F.lit(""))
    day = bind.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("receipt"), F.add_months("o_orderdate", 120).alias("day"))
    rows = bind.receipts(spark, sf_dir).join(day, "receipt").withColumn("tax", F.floor(F.col("subtotal") * 0.16 + 0.5).cast("bigint") + F.when(k % 11 == 0, 300).otherwise(0))
    rows = rows.withColumn("total", F.col("subtotal") + F.col("tax") - F.when(k % 4 != 0, F.col("discount")).otherwise(0) + F.when(k % 7 == 0, 500).otherwise(0))
    months = F.element_at(F.array(*map(F.lit, MONTH_NAMES)), F.month("day"))
    written = F.when(k % 4 == 0, F.concat_ws("/", F.dayofmonth("day"), F.month("day"), F.year("day"))).when(k % 4 == 1, F.date_format("day", "yyyy-MM-dd")).when(k % 4 == 2, F.concat_ws(" DE ", F.dayofmonth("day"), months, F.year("day")))
    glue = F.when(k % 3 == 0, " ").otherwise("\n")
    sums = F.concat(F.lit("SUBTOTAL $ "), money(F.col("subtotal")), glue, F.lit("IVA 16% "), money(F.col("tax")))
    total = F.when(k % 5 == 0, F.concat(F.lit("TOTAL 5"), plain(F.col("total")))).otherwise(F.concat(F.lit("TOTAL: $"), money(F.col("total"))))
    text = F.concat_ws(
        "\n", F.element_at(F.array(*map(F.lit, HEADS)), (k % 4 + 1).cast("int")), F.lit("CALLE 5 NUM 10"), F.concat(F.lit("FECHA "), written), sums,
        F.when(k % 4 != 0, F.concat(F.lit("Descuento -"), money(F.col("discount")))), F.lit("TOTAL DE ARTICULOS 3"), total,
        F.when(k % 2 == 0, F.concat(F.lit("EFECTIVO $"), money(F.col("total") + 10_000), F.lit("\nCAMBIO $100.00"))), F.lit("GRACIAS POR SU COMPRA"),
    )
    return rows.select("receipt", text.alias("text"))


TRUTH = f"""WITH {bind.RECEIPTS}, x AS (SELECT receipt, receipt AS k, subtotal, floor(subtotal * 0.16::DOUBLE + 0.5)::BIGINT + CASE WHEN receipt % 11 = 0 THEN 300 ELSE 0 END AS tax,
  CASE WHEN receipt % 4 <> 0 THEN discount END AS discount, (o_orderdate + INTERVAL 120 MONTH)::DATE AS day FROM r JOIN orders ON o_orderkey = receipt),
y AS (SELECT *, subtotal + tax - coalesce(discount, 0) + CASE WHEN k % 7 = 0 THEN 500 ELSE 0 END AS real FROM x),
z AS (SELECT *, CASE WHEN k % 2 = 0 THEN real + 10000 END AS cash, CASE WHEN k % 2 = 0 THEN 10000::BIGINT END AS change,
  ('5' || real)::BIGINT AS misread FROM y),
t AS (SELECT *, k % 5 = 0 AND length(real::VARCHAR) <= 8 AND (k % 2 = 0 OR k % 7 <> 0) AS recovered FROM z),
f AS (SELECT *, CASE WHEN k % 5 <> 0 OR recovered THEN real ELSE misread END AS total FROM t)"""


def _fields(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = papers.lines_of(texts(spark, sf_dir), "receipt")
    return lines, papers.recovered_totals(papers.money_fields(lines, "receipt"))


@query(f"{TRUTH} SELECT receipt, subtotal, tax, discount, total, cash, change, recovered FROM f")
def r1_receipt_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir)[1].drop("total_raw", "rate")


@query(f"{TRUTH} SELECT receipt, total, recovered FROM f")
def r3_recovered_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals whose currency sign was read as a 5."""
    return _fields(spark, sf_dir)[1].select("receipt", "total", "recovered")


CHECKS = """c AS (SELECT receipt, 'cash-change-total' AS "check", cash - change AS expected, total AS actual, 1 AS slack FROM f WHERE cash IS NOT NULL
  UNION ALL SELECT receipt, 'subtotal-tax-total', subtotal + tax - coalesce(discount, 0), total, 2 FROM f
  UNION ALL SELECT receipt, 'subtotal-iva-rate-tax', floor(subtotal * 0.16::DOUBLE + 0.5)::BIGINT, tax, 2 FROM f),
d AS (SELECT receipt, "check", expected, actual, CASE WHEN abs(expected - actual) <= slack THEN 'supported' ELSE 'conflicted' END AS status FROM c)"""


def _checks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines, fields = _fields(spark, sf_dir)
    return lines, fields, papers.all_checks(fields, "receipt")


@query(f"{TRUTH}, {CHECKS} SELECT * FROM d")
def r4_all_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checks(spark, sf_dir)[2]


SPOKEN = ", ".join(f"('{c}', '{name}')" for c, names in papers.CHECK_FIELDS.items() for name in names)


@query(
    f"""{TRUTH}, {CHECKS}, m("check", field) AS (VALUES {SPOKEN}),
v AS (SELECT receipt, field, count(*) FILTER (status = 'supported') AS supports, count(*) FILTER (status = 'conflicted') AS conflicts FROM d JOIN m USING ("check") GROUP BY 1, 2),
u AS (UNPIVOT (SELECT receipt, subtotal, tax, discount, total, cash, change FROM f) ON subtotal, tax, discount, total, cash, change INTO NAME field VALUE value),
w AS (SELECT receipt, field, value, coalesce(supports, 0) AS supports, coalesce(conflicts, 0) AS conflicts FROM u LEFT JOIN v USING (receipt, field))
SELECT *, CASE WHEN supports > 0 AND conflicts = 0 THEN 0.97 WHEN conflicts > 0 AND supports = 0 THEN 0.74 WHEN conflicts > 0 THEN 0.9 ELSE 0.92 END::DOUBLE AS confidence FROM w"""
)
def r5_field_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, fields, checks = _checks(spark, sf_dir)
    return papers.evidence_confidence(fields, checks, "receipt")


@query(
    f"""{TRUTH}, {CHECKS}, v AS (SELECT receipt, count(*) FILTER (status = 'supported') AS supported, count(*) FILTER (status = 'conflicted') AS conflicted FROM d GROUP BY 1),
q AS (SELECT receipt, 3 + (discount IS NOT NULL)::INT + 2 * (cash IS NOT NULL)::INT + (k % 4 <> 3)::INT AS resolved, 1 + (k % 4 <> 3)::INT AS critical, supported, conflicted, recovered FROM f JOIN v USING (receipt))
SELECT receipt, resolved, critical, supported, conflicted, {r('''(0.9::DOUBLE * 0.25::DOUBLE + resolved / 8 * 0.20::DOUBLE + critical / 2 * 0.25::DOUBLE
  + least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE + supported * 0.25::DOUBLE - conflicted * 0.45::DOUBLE)) * 0.20::DOUBLE + 0.10::DOUBLE - recovered::INT * 0.015::DOUBLE) * 100''', 0)} AS score FROM q"""
)
def r6_receipt_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also the score of one reading (A30)."""
    lines, fields, checks = _checks(spark, sf_dir)
    return papers.quality(fields, checks, papers.dates(lines, "receipt"), "receipt")


@query(
    f"""{TRUTH} SELECT receipt, day::VARCHAR AS date, CASE k % 4 WHEN 0 THEN 'DMY_DATE_MATCH' WHEN 1 THEN 'ISO_DATE_MATCH' ELSE 'SPANISH_MONTH_DATE_MATCH' END AS rule FROM f WHERE k % 4 <> 3"""
)
def m2_receipt_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers.dates(papers.lines_of(texts(spark, sf_dir), "receipt"), "receipt").select("receipt", F.col("date").cast("string").alias("date"), "rule")


@query(
    """WITH m(k, merchant, kind, score, rival) AS (VALUES (0, 'OXXO', 'brand', 11, 0), (1, 'EL FLORIDO', 'brand', 13, 0), (2, 'Operadora del Norte SA de CV', 'legal_entity', 10, 0), (3, 'Restaurante Luna', 'header', 5, 0))
SELECT DISTINCT l_orderkey AS receipt, merchant, kind, score, floor(least(0.97::DOUBLE, 0.48::DOUBLE + score * 0.045::DOUBLE + score * 0.025::DOUBLE) * 10000 + 0.5) / 10000 AS confidence FROM lineitem JOIN m ON l_orderkey % 4 = k"""
)
def r7_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers.merchants(papers.lines_of(texts(spark, sf_dir), "receipt"), "receipt")


@query(
    """WITH s AS (SELECT DISTINCT l_orderkey AS receipt, l_orderkey % 4 = 3 AS restaurant, l_orderkey % 4 = 0 AS oxxo FROM lineitem)
SELECT receipt, CASE WHEN oxxo THEN 'convenience_store' ELSE 'retail_receipt' END AS type,
  CASE WHEN oxxo THEN 0.85 WHEN restaurant THEN 0.97 ELSE 0.98 END::DOUBLE AS type_confidence FROM s"""
)
def r8_receipt_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("receipt", papers.receipt_type(F.col("text")).alias("t")).select("receipt", "t.*")


@query(f"{TRUTH} SELECT receipt, 7 + (k % 4 <> 3)::INT + (discount IS NOT NULL)::INT + 2 * (cash IS NOT NULL)::INT AS n_lines FROM f")
def t7_label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines after cutting before strong labels."""
    return papers.lines_of(texts(spark, sf_dir), "receipt").groupBy("receipt").agg(F.count("*").cast("int").alias("n_lines"))


@query(
    """WITH p AS (SELECT p_partkey AS id, p_partkey % 5 AS kind, p_partkey AS k, p_size AS s, floor(p_retailprice * 100 + 0.5)::BIGINT AS price FROM part),
g AS (SELECT id, 'gas_station' AS type, unnest(['crePermit', 'fuelProduct', 'liters', 'pricePerLiter']) AS field, unnest(['PL-' || k, 'MAGNA', s || '.5', price::VARCHAR]) AS value FROM p WHERE kind = 0),
c AS (SELECT id, 'cfdi_invoice' AS type, unnest(['issuerRfc', 'receiverRfc', 'uuid', 'cfdiUse']) AS field,
  unnest(['ABC010203XY1', 'DEF040506ZZ9', '0A1B2C3D-0000-4000-8000-' || lpad(k::VARCHAR, 12, '0'), 'G03 - Gastos']) AS value FROM p WHERE kind = 1),
b AS (SELECT id, 'bank_transfer' AS type, unnest(['receiver', 'trackingKey', 'reference', 'amount', 'accountLast4']) AS field, unnest(['Ana ' || k, 'MB' || k, k::VARCHAR, price::VARCHAR, '4321']) AS value FROM p WHERE kind = 2),
t AS (SELECT id, 'restaurant' AS type, unnest(['tip', 'table', 'server', 'guests']) AS field, unnest([price::VARCHAR, 'T-' || s, 'Luis ' || k, s || '.0']) AS value FROM p WHERE kind = 3)
SELECT * FROM g UNION ALL SELECT * FROM c UNION ALL SELECT * FROM b UNION ALL SELECT * FROM t"""
)
def r9_special_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of four kinds, and one without a parser, written from ``part``."""
    k, s, price = F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.format_number("p_retailprice", 2)
    lines = [
        F.concat(F.lit("Estacion 5\nPERMISO C.R.E. PL-"), k, F.lit("\nMAGNA\nLITROS: "), s, F.lit(".5\nPRECIO POR LITRO $"), price),
        F.concat(F.lit("CFDI\nRFC EMISOR ABC010203XY1\nRFC RECEPTOR: def040506zz9\nFOLIO FISCAL 0a1b2c3d-0000-4000-8000-"), F.lpad(k, 12, "0"), F.lit("\nUSO CFDI G03 - Gastos")),
        F.concat(F.lit("SPEI\nBENEFICIARIO: Ana "), k, F.lit("\nCLAVE DE RASTREO MB"), k, F.lit("\nREFERENCIA "), k, F.lit("\nIMPORTE $"), price, F.lit("\nCUENTA ****4321")),
        F.concat(F.lit("Taqueria TACOS\nMESA T-"), s, F.lit("\nMESERO: Luis "), k, F.lit("\nCOMENSALES "), s, F.lit("\nPROPINA $"), price),
    ]
    text = F.coalesce(*[F.when(F.col("p_partkey") % 5 == n, x) for n, x in enumerate(lines)], F.lit("TOTAL DE ARTICULOS 2"))
    return papers.special_fields(bind.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text")), "id")
