"""JSON documents as variants: canonical text, leaves, comparison and manifests, without leaving the JVM.

A variant keeps an object's keys in order and writes numbers in their shortest form, so its text is canonical: equal documents have
equal texts, whatever their key order and spacing. (A number with an exponent keeps a ``.0``.) Trees are walked by lateral
explosions, one a level; documents deeper than ``depth`` keep the rest of a branch as one leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH = 8
_LEAF = "array<struct<path:string,at:string,kind:string,value:string,members:array<string>>>"


def canonical(text: Column) -> Column:
    """The canonical text of a JSON document; null where the text is none."""
    return F.to_json(F.try_parse_json(text))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical(text), 256))


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _step(key: Column) -> Column:
    """A path step that may hold any key."""
    return F.concat(F.lit("['"), F.replace(F.replace(key, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("']"))


def _walked(df: DataFrame, keys: list[str], arrays: bool, stops: Column, depth: int) -> DataFrame:
    """``(keys, path, at, v)``: one row a leaf of the variant ``v``. ``arrays``: elements are walked too; ``stops``: of ``v``, where not to go deeper."""
    rows = df.select(*keys, F.lit("$").alias("path"), F.lit("$").alias("at"), "v")
    for _ in range(depth):
        inner = (_is(F.col("v"), "OBJECT") | (_is(F.col("v"), "ARRAY") if arrays else F.lit(False))) & ~stops
        marked = rows.withColumn("inner", inner)
        below = marked.lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.when(F.col("inner").outer(), F.col("v").outer())))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), "pos", F.lit("]")))
        place = F.when(F.col("key").isNotNull(), _step(F.col("key"))).otherwise(F.concat(F.lit("["), "pos", F.lit("]")))
        down = F.col("pos").isNotNull()
        empty = F.col("inner") & ~down  # an object or array without members has no leaves
        rows = below.filter(~empty).select(
            *keys, F.when(down, F.concat("path", step)).otherwise(F.col("path")).alias("path"), F.when(down, F.concat("at", place)).otherwise(F.col("at")).alias("at"), F.when(down, F.col("value")).otherwise(F.col("v")).alias("v")
        )
    return rows


def leaves(df: DataFrame, keys: list[str], text: str, depth: int = DEPTH) -> DataFrame:
    """``(keys, path, value)`` of every leaf of the documents; values as JSON text, strings without quotes."""
    rows = _walked(df.select(*keys, F.try_parse_json(text).alias("v")).filter("v is not null"), keys, True, F.lit(False), depth)
    value = F.coalesce(F.when(_is(F.col("v"), "STRING"), F.try_variant_get("v", "$", "string")), F.to_json("v"))
    return rows.select(*keys, "path", value.alias("value"))


def flattened(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, values)``: all leaves of a document as texts, in order of their paths; without nulls."""
    rows = leaves(df, [key], text).filter("value <> 'null'")
    found = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "value"))), lambda x: x["value"]).alias("values"))
    # Spark halves its estimate with every level of the walk and would broadcast all documents
    return df.select(key).join(found.hint("merge"), key, "left").select(key, F.coalesce("values", F.array().cast("array<string>")).alias("values"))


def altered(before: DataFrame, after: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``(keys, path, before, after)`` of the leaves that differ."""
    old, new = (leaves(d, keys, text).withColumnRenamed("value", name) for d, name in ((before, "before"), (after, "after")))
    return old.join(new, [*keys, "path"], "full").filter(~F.col("before").eqNullSafe(F.col("after")))


def manifests(cases: DataFrame, dataset: str, case: str, text: str, counted: list[str]) -> DataFrame:
    """Per dataset ``cases, content_hash`` and, for each field of ``counted``, how often its values occur (``value=n``, by value).

    The hash is that of the canonical array of all documents in order of their case; a dataset is one document set that is published as a
    whole, so its text is put together in one task. Corpora of any size have tree digests instead.
    """
    rows = cases.select(dataset, case, F.try_parse_json(text).alias("v"))
    whole = rows.groupBy(dataset).agg(F.count("*").alias("cases"), F.array_sort(F.collect_list(F.struct(F.col(case).alias("c"), F.to_json("v").alias("t")))).alias("all"))
    out = whole.select(dataset, "cases", F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("["), F.array_join("all.t", ","), F.lit("]")), 256)).alias("content_hash"))
    for name in counted:
        value = F.coalesce(F.try_variant_get("v", f"$.{name}", "string"), F.lit("undefined"))
        counts = rows.groupBy(dataset, value.alias("value")).agg(F.count("*").alias("n"))
        out = out.join(counts.groupBy(dataset).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "value", "n"))), ",").alias(name)), dataset)
    return out


def verified(manifest: DataFrame, cases: DataFrame, dataset: str, case: str, text: str) -> DataFrame:
    """``(dataset, hash_matches)`` of published manifests against the cases as they are now."""
    now = manifests(cases, dataset, case, text, []).select(dataset, F.col("content_hash").alias("now"))
    return manifest.select(dataset, "content_hash").join(now, dataset, "left").select(dataset, F.coalesce(F.col("content_hash") == F.col("now"), F.lit(False)).alias("hash_matches"))


def expectations(texts: DataFrame, text: str, depth: int = DEPTH) -> DataFrame:
    """``(text, leaves)`` of expected documents: a leaf is a value, ``$oneOf`` or ``$includes``; arrays are values."""
    one, some = F.try_variant_get("v", "$['$oneOf']", "array<variant>"), F.try_variant_get("v", "$['$includes']", "array<variant>")
    stops = _is(F.col("v"), "OBJECT") & (F.try_variant_get("v", "$['$oneOf']", "variant").isNotNull() | F.try_variant_get("v", "$['$includes']", "variant").isNotNull())
    rows = _walked(texts.select(text, F.try_parse_json(text).alias("v")).filter("v is not null"), [text], False, stops, depth)
    object_of = _is(F.col("v"), "OBJECT")
    members = F.transform(F.coalesce(F.when(object_of, one), F.when(object_of, some)), lambda x: F.to_json(x))
    kind = F.when(object_of & one.isNotNull(), "$oneOf").when(object_of & some.isNotNull(), "$includes").otherwise("$eq")
    leaf = F.struct("path", "at", kind.alias("kind"), F.to_json("v").alias("value"), members.alias("members"))
    return rows.select(text, leaf.alias("leaf")).groupBy(text).agg(F.array_sort(F.collect_list("leaf")).alias("leaves"))


def same(a: Column, b: Column) -> Column:
    """Equal canonical texts, or equal numbers."""
    return F.coalesce((a == b) | F.coalesce(a.try_cast("double") == b.try_cast("double"), F.lit(False)), F.lit(False))


def met(actual: Column, leaf: Column) -> Column:
    """Whether the document has what an expected leaf asks for."""
    there = F.call_function("try_variant_get", actual, leaf["at"], F.lit("variant"))
    has = F.to_json(there)
    listed = F.transform(F.when(_is(there, "ARRAY"), there.try_cast("array<variant>")), lambda x: F.to_json(x))
    return (
        F.when(leaf["kind"] == "$eq", same(has, leaf["value"])).when(leaf["kind"] == "$oneOf", F.coalesce(F.exists(leaf["members"], lambda m: same(has, m)), F.lit(False)))
        .otherwise(F.coalesce(F.forall(leaf["members"], lambda m: F.exists(listed, lambda x: same(x, m))), F.lit(False)))
    )


def compared(df: DataFrame, key: str, expected: str = "expected", actual: str = "actual") -> DataFrame:
    """``(key, checks, score, passed, failures)``: leaves of the expected document that the actual one has.

    Expected documents are walked once each; their leaves are looked up by path in the actual document, row by row.
    """
    known = expectations(df.select(expected).filter(F.col(expected).isNotNull()).distinct(), expected)
    rows = df.select(key, expected, F.try_parse_json(F.nullif(F.col(actual), F.lit(""))).alias("_actual")).join(known, expected, "left")
    checked = rows.withColumn("_met", F.transform(F.coalesce("leaves", F.array().cast(_LEAF)), lambda e: F.struct(e["path"].alias("path"), met(F.col("_actual"), e).alias("ok"))))
    failures = F.array_join(F.array_sort(F.transform(F.filter("_met", lambda m: ~m["ok"]), lambda m: m["path"])), ",")
    good, checks = F.size(F.filter("_met", lambda m: m["ok"])), F.size("_met")
    score = F.when(checks > 0, F.floor(good / checks * 100 + 0.5)).otherwise(100).cast("int")
    return checked.select(key, checks.cast("bigint").alias("checks"), score.alias("score"), (failures == "").alias("passed"), failures.alias("failures"))
