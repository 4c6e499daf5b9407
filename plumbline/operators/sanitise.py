"""Sanitised audit data: a walk over the schema that builds one native expression for any nesting of structs, arrays and maps.

Sensitive fields keep nothing but the fact that they were there. Texts of telling fields become their length and hash, data URLs
their length, other texts stay up to a length. Text leaves are ``(value, redacted, kind, length, hash)``; arrays keep their first 50 elements;
what lies deeper than six levels is a mark. Numbers, booleans and nulls stay. Field names decide; for maps the keys do, row by row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import fnv1a32

# fixed values: names of fields that are secret or hold media, and of fields that hold what people wrote
SENSITIVE = r"(?i)api.?key|secret|token|password|credential|authorization|cookie|sessioncookie|dataurl|base64|media|imageblob|rawtext|extractedtext|conversation|payload"
TELLING = r"(?i)answer|question|prompt|content|message|userintent|query"
MAX_DEPTH, MAX_ITEMS, MAX_TEXT, MAX_TYPE, MAX_ID = 6, 50, 500, 80, 160


def units(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def text_leaf(value: Column, telling: Column, sensitive: Column | None = None) -> Column:
    """A text as audit data; nothing of it where it is sensitive."""
    sensitive = F.lit(False) if sensitive is None else sensitive
    url = value.rlike("(?i)^data:")
    kind = F.when(sensitive, "sensitive_field").when(url, "data_url").when(telling, "text")
    hidden = kind.isNotNull()
    short = F.when(units(value) > MAX_TEXT, F.concat(F.left(value, F.lit(MAX_TEXT)), F.lit("…"))).otherwise(value)
    hashed = F.lpad(F.lower(F.hex(fnv1a32(value))), 8, "0")
    leaf = F.struct(F.when(~hidden, short).alias("value"), hidden.alias("redacted"), kind.alias("kind"), F.when(~sensitive, units(value)).alias("length"), F.when(kind == "text", hashed).alias("hash"))
    return F.when(value.isNotNull() | sensitive, leaf)


def mark(kind: str) -> Column:
    return F.struct(F.lit(True).alias("redacted"), F.lit(kind).alias("kind"))


def sanitised(value: Column, kind: T.DataType, name: str = "", depth: int = 0, keep_text: bool = True) -> Column:
    """``value`` of type ``kind`` under a field ``name``. ``keep_text=False`` hides all texts."""
    telling = F.lit(bool(re.search(TELLING[4:], name, re.I)) or not keep_text)
    if depth > MAX_DEPTH:
        return F.when(value.isNotNull(), F.lit("[depth-limited]"))
    if isinstance(kind, T.StringType):
        return text_leaf(value, telling)
    if isinstance(kind, (T.NumericType, T.BooleanType, T.NullType)):
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(F.slice(value, 1, MAX_ITEMS), lambda x: sanitised(x, kind.elementType, name, depth + 1, keep_text))
    if isinstance(kind, T.StructType):
        fields = [
            (mark("sensitive_field") if re.search(SENSITIVE[4:], f.name, re.I) else sanitised(value.getField(f.name), f.dataType, f.name, depth + 1, keep_text)).alias(f.name)
            for f in kind.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.MapType):
        if isinstance(kind.valueType, T.StringType):
            return F.transform_values(value, lambda k, v: text_leaf(v, k.cast("string").rlike(TELLING) | F.lit(not keep_text), k.cast("string").rlike(SENSITIVE)))
        inner = lambda k, v: F.struct(F.when(~k.cast("string").rlike(SENSITIVE), sanitised(v, kind.valueType, "", depth + 1, keep_text)).alias("value"), k.cast("string").rlike(SENSITIVE).alias("redacted"))
        return F.transform_values(value, inner)
    if isinstance(kind, T.BinaryType):
        return F.when(value.isNotNull(), F.struct(F.lit(True).alias("redacted"), F.octet_length(value).alias("length"), F.sha2(value, 256).alias("hash")))
    return value.cast("string")


def sanitised_rows(df: DataFrame, keep: tuple[str, ...] = (), keep_text: bool = True) -> DataFrame:
    """The rows with all columns but those of ``keep`` sanitised."""
    out = []
    for f in df.schema.fields:
        if f.name in keep:
            out.append(F.col(f"`{f.name}`"))
        elif re.search(SENSITIVE[4:], f.name, re.I):
            out.append(mark("sensitive_field").alias(f.name))
        else:
            out.append(sanitised(F.col(f"`{f.name}`"), f.dataType, f.name, 1, keep_text).alias(f.name))
    return df.select(*out)


def audit_events(df: DataFrame) -> DataFrame:
    """``(id, type, at, execution, task, data)`` rows with sanitised ``data`` (any type) and short names."""
    data = df.schema["data"]
    cut = lambda c, n: F.left(F.col(c).cast("string"), F.lit(n)).alias(c)
    return df.select("id", cut("type", MAX_TYPE), "at", cut("execution", MAX_ID), cut("task", MAX_ID), sanitised(F.col("data"), data.dataType).alias("data"))
