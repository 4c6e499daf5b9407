"""Line dedup by a tree of line templates.

A line's place in the tree has a fixed depth: its number of tokens, then its first tokens, with tokens
that hold digits replaced by a wildcard. A leaf may hold several templates and frequent fixed lines, so each line is told from
its leaf by its own tokens: how many documents of the leaf have each token at that place. The tokens of one
template recur about equally often, those of a variable field far less; a token is fixed if its count is at least ``share`` of the
upper median of the line's counts after the first tokens, and any other place is a variable field. A line of
whose places after the first tokens at least ``similarity`` hold fixed words takes leaf and fixed tokens as its template. A line with
digits of whose tokens at least ``similarity`` hold none takes its masked tokens; lines that are mostly fields, such as rows of
numbers, are data and have no template. A line goes if, in a document other than the first (smallest id) that has it, its words recur in
``min_docs`` documents or its template with variable fields recurs in ``min_template_docs``. Lines of
fewer than ``min_tokens`` tokens recur by chance; they go if their words recur in ``min_short_docs`` documents, or, where at most half of their
tokens hold digits and ``short_words`` or more do not, their masked tokens in ``min_short_template_docs``; words of such lines are never taken for a field.
Blank lines stay.

DataFrame functions only. Lines are counted by two hashes; the texts themselves are shuffled once, to meet the
list of their dropped lines; texts of over ``many_lines`` lines are cut up and meet them line by line, so no text takes time beyond its length. A line of a third of all documents is counted by partial aggregation and
joined from written tables on both sides, so that adaptive execution can split it.

Edge cases: a null text stays null and an empty one empty; a text all of whose lines go becomes empty
and its row stays; rows with the same id are one document, as are rows with a null id and the same text, which come after all others;
lines repeated inside one document only are no recurrence; other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written

MIN_TOKENS, MIN_DOCS, MIN_TEMPLATE_DOCS, MIN_SHORT_DOCS, MIN_SHORT_TEMPLATE_DOCS = 5, 2, 5, 10, 20
MANY_LINES, SHORT_WORDS = 2048, 2
DEPTH, SIMILARITY, SHARE = 3, 0.5, 0.5
WILDCARD = "<*>"


def trimmed(line: Column) -> Column:
    """Without white space at its ends; a blank line becomes empty."""
    return F.btrim(line, F.lit(" \t\r\f\x0b"))


def tokens_of(line: Column) -> Column:
    """The words of a trimmed line; a regular expression only where single blanks do not part them."""
    odd = F.contains(line, F.lit("  "))
    for blank in "\t\r\f\x0b":
        odd = odd | F.contains(line, F.lit(blank))
    return F.when(odd, F.split(line, r"\s+")).otherwise(F.split(line, " "))


def line_key(line: Column) -> Column:
    return F.xxhash64(trimmed(line))


def named(df: DataFrame) -> DataFrame:
    """Adds ``part``, which tells documents without an id apart by their text; null where there is an id."""
    return df.withColumn("part", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))


def line_table(df: DataFrame, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, similarity: float = SIMILARITY, short_words: int = SHORT_WORDS) -> DataFrame:
    """``(doc_id, part, line, twin, short, fielded, tokens, masked, leaf)`` of every line that is not blank, once a document row.

    ``line`` and ``twin`` are hashes of the line; ``masked`` is null for short lines that are not ``fielded``, ``leaf`` for lines of fewer
    than ``min_tokens`` tokens; ``fielded``: some tokens hold digits and at least ``similarity`` of them hold none (``short_words`` at least).
    """
    raw = F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("raw")
    split = df.select("doc_id", "part", raw).withColumn("line", trimmed(F.col("raw"))).filter("line <> ''")
    split = split.select("doc_id", "part", F.xxhash64("line").alias("line"), F.hash("line").alias("twin"), tokens_of(F.col("line")).alias("words"), F.col("line").rlike("[0-9]").alias("digits"))
    masked = F.when(F.col("digits"), F.transform("words", lambda t: F.when(t.rlike("[0-9]"), WILDCARD).otherwise(t))).otherwise(F.col("words"))
    long = F.size("tokens") >= min_tokens
    words = F.size(F.filter("tokens", lambda t: t != WILDCARD))
    fielded = F.when(F.col("digits"), (words >= F.size("tokens") * similarity) & (words >= short_words)).otherwise(False)
    return split.select("doc_id", "part", "line", "twin", masked.alias("tokens"), fielded.alias("fielded")).withColumns(
        {"short": ~long, "masked": F.when(long | F.col("fielded"), F.xxhash64("tokens")), "leaf": F.when(long, F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth)))}
    )


def leaf_templates(lines: DataFrame, places: DataFrame, min_template_docs: int, depth: int, similarity: float, share: float) -> DataFrame:
    """``(masked, template)`` of the lines whose leaf gives them a template with variable fields."""
    shapes = places.filter("not short").groupBy("masked").agg(F.count_distinct(F.coalesce("doc_id", "part")).alias("docs"), F.first("leaf").alias("leaf"))
    shapes = written(shapes, "line-shapes")
    leaves = shapes.groupBy("leaf").agg(F.count("*").alias("n"), F.sum("docs").alias("leaf_docs"))
    mixed = written(leaves.filter((F.col("n") > 1) & (F.col("leaf_docs") >= min_template_docs)).select("leaf"), "mixed-leaves")
    words = lines.filter("not short").join(mixed, "leaf", "left_semi").select("masked", "leaf", "tokens").dropDuplicates(["masked"])
    known = written(words.join(shapes.select("masked", "docs"), "masked"), "leaf-lines")
    spots = known.select("masked", "leaf", "docs", F.posexplode("tokens").alias("at", "word")).filter(F.col("at") >= depth)
    spots = spots.select("masked", "leaf", "docs", "at", F.xxhash64("word").alias("token"), (F.col("word") == WILDCARD).alias("wild"))
    counts = written(spots.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("n")), "token-counts")
    counted = spots.join(counts, ["leaf", "at", "token"]).groupBy("masked").agg(F.sort_array(F.collect_list(F.struct("at", "token", "n", "wild"))).alias("spots"))
    middle = F.get(F.sort_array(F.transform("spots", lambda s: s["n"])), (F.size("spots") / 2).cast("int"))
    fixed = lambda m: F.filter("spots", lambda s: s["n"] >= m * share)
    # the median is bound by a transform over it alone, so that it is taken once a line and not once a token
    told = F.get(F.transform(F.array(middle), lambda m: F.struct(m.alias("median"), F.transform(fixed(m), lambda s: F.struct(s["at"], s["token"])).alias("fixed"), F.size(F.filter(fixed(m), lambda s: ~s["wild"])).alias("words"))), 0)
    size = F.size("spots")
    return (
        counted.select("masked", told.alias("t"), size.alias("size"))
        .filter((F.col("t.median") >= min_template_docs) & (F.size("t.fixed") < F.col("size")) & (F.col("t.words") >= F.col("size") * similarity))
        .join(known.select("masked", "leaf"), "masked")
        .select("masked", F.xxhash64("leaf", "t.fixed").alias("template"))
    )


def dropped_lines(
    df: DataFrame, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS, min_template_docs: int = MIN_TEMPLATE_DOCS, min_short_docs: int = MIN_SHORT_DOCS,
    min_short_template_docs: int = MIN_SHORT_TEMPLATE_DOCS, short_words: int = SHORT_WORDS, depth: int = DEPTH, similarity: float = SIMILARITY, share: float = SHARE,
) -> DataFrame:
    """``(doc_id, part, line)`` of lines (by hash) that go from that document."""
    lines = line_table(named(df.select("doc_id", "text")), depth, min_tokens, similarity, short_words)
    places = written(lines.select("doc_id", "part", "line", "twin", "short", "masked", "leaf", "fielded"), "line-places")
    templates = written(leaf_templates(lines, places, min_template_docs, depth, similarity, share), "line-templates")
    placed = places.join(templates, "masked", "left")
    variable = F.col("template").isNotNull() | F.col("fielded")
    least = F.when(F.col("short"), min_short_template_docs).otherwise(min_template_docs)
    keys = F.array_compact(
        F.array(
            F.struct(F.when(F.col("short"), min_short_docs).otherwise(min_docs).alias("least"), F.col("line").alias("key"), F.col("twin").alias("twin")),
            F.when(variable, F.struct(least.alias("least"), F.coalesce("template", "masked").alias("key"), F.lit(None).cast("int").alias("twin"))),
        )
    )
    long = written(placed.select("doc_id", "part", "line", F.explode(keys).alias("k")).select("doc_id", "part", "line", "k.least", "k.key", F.coalesce("k.twin", F.lit(0)).alias("twin"), F.col("k.twin").isNotNull().alias("words")), "line-keys")
    once = long.select("doc_id", "part", "words", "least", "key", "twin").distinct()
    counted = once.groupBy("words", "least", "key", "twin").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.min("part").alias("first_part"))
    often = written(counted.filter(F.col("n") >= F.col("least")).drop("n"), "recurring-lines")
    is_first = F.when(F.col("first").isNotNull(), F.coalesce(F.col("doc_id") == F.col("first"), F.lit(False))).otherwise(F.col("part") == F.col("first_part"))
    return long.join(often, ["words", "least", "key", "twin"]).filter(~is_first).select("doc_id", "part", "line").distinct()


def drop_recurring_lines(df: DataFrame, many_lines: int = MANY_LINES, **limits) -> DataFrame:
    """The rows with ``text`` rid of recurring lines; adds ``n_lines`` and ``n_dropped``."""
    own = {"_doc": F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text")), "_none": F.col("doc_id").isNull()}
    gone = written(dropped_lines(df, **limits).select(F.coalesce("doc_id", "part").alias("_doc"), F.col("doc_id").isNull().alias("_none"), "line"), "dropped-lines")
    sets = gone.groupBy("_doc", "_none").agg(F.collect_set("line").alias("_gone"))
    lines = F.split("text", "\n")
    long = F.coalesce((F.octet_length("text") >= many_lines) & (F.size(lines) > many_lines), F.lit(False))

    kept = F.filter(lines, lambda x: ~F.array_contains("_gone", line_key(x)))
    few = df.filter(~long).withColumns(own).join(sets, ["_doc", "_none"], "left").withColumn("_kept", F.when(F.col("_gone").isNotNull(), kept))

    keys = ["_doc", "_none", "_text"]
    many = df.filter(long).withColumns(own | {"_text": F.xxhash64("text")})
    each = many.select(*keys, F.posexplode(lines).alias("_at", "_line")).dropDuplicates([*keys, "_at"]).withColumn("line", line_key(F.col("_line")))
    left = each.join(gone, ["_doc", "_none", "line"], "left_anti").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_at", "_line")))["_line"].alias("_kept"))
    many = many.join(left, keys, "left").withColumn("_kept", F.coalesce("_kept", F.array().cast("array<string>")))

    joined = few.select(*df.columns, "_kept").unionByName(many.select(*df.columns, "_kept"))
    n, none = F.size(lines), F.col("_kept").isNull()
    return joined.withColumns(
        {
            "text": F.when(none, F.col("text")).otherwise(F.array_join("_kept", "\n")),
            "n_lines": F.coalesce(n, F.lit(0)),
            "n_dropped": F.when(none, 0).otherwise(n - F.size("_kept")),
        }
    ).drop("_kept")
