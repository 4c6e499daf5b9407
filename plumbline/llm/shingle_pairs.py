"""Near copies by SimHash with an exact check, and by prefix filter beyond its radius; none is lost.

A text is the set of its word shingles' XXH64 hashes. Two texts link at a Jaccard similarity of at least
0.8, which makes each share a shingle of the other's prefix: the first ``n - ceil(0.8 n) + 1`` shingles
in an order that all texts have in common. Any order gives all pairs; shingles that are frequent in a
sample of the texts come last, which keeps groups that share a prefix shingle small.

Equal sets are first made one. Pairs that SimHash finds (:mod:`simhash`, tiled exact comparison) are verified with those of round one. Only prefixes are kept of all texts; the sets themselves are made anew for the texts in a candidate
pair, from one text a set, which two hashes name. Round one verifies each set against the smallest set of each group that shares
a prefix shingle, which joins large groups of near copies in linear work; round two verifies all
pairs that share a prefix shingle and are not yet in one component, but for those whose sizes, number of common prefix shingles or place of the first
rule a similarity of 0.8 out; the sets of a shingle that very many of them share meet by bands of size, so that one shingle's sets are split over tasks.
A near pair shares so many prefix shingles that it nearly always shares one that few sets have. So the sets of a shingle that many have (a passage in
many texts) meet there only if their other common shingles may be such too, and if it may be their first: few of all pairs, and none is lost.

Edge cases: blank and null texts are equal to each other; a text of fewer words than a shingle is one shingle; rows
with a null id take the component of the rows near to them that have an id, else null; repeated rows share their component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm import simhash
from plumbline.llm.common import new_dir, remove_folders, written, written_at
from plumbline.llm.components import connected_components

SHINGLE = 5
#: Texts sampled for the order of shingles, how often a frequent one stands there, and how many are told apart.
SAMPLE, FREQUENT, MAX_FREQUENT = 10_000, 4, 200_000
#: Sets that share an undecided shingle from which they meet by bands of size, and beyond which it tells little.
LARGE, MANY = 1000, 8


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(line)], np.uint64).view(np.int64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-shingle] + 1).tolist()]
    return np.unique(np.array([digest(line[s:e]) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64).view(np.int64))


def text_keys(text: Column) -> dict[str, Column]:
    """Two hashes under which equal texts meet."""
    return {"k1": F.xxhash64(text), "k2": F.hash(text)}


def frequent_shingles(df: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """The shingles that many of about ``SAMPLE`` sampled texts share, the most frequent last; at most ``MAX_FREQUENT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, shingle))], ["shingle"])

    share = min(1.0, SAMPLE / max(1, df.count()))
    sampled = df.select(F.col("text").cast("binary")).sample(share, seed=5).mapInArrow(run, "shingle bigint")
    often = sampled.groupBy("shingle").count().filter(F.col("count") >= FREQUENT)
    rows = often.orderBy(F.col("count").desc(), "shingle").limit(MAX_FREQUENT).toArrow()
    return rows["shingle"].to_numpy()[::-1].copy()


def prefix_table(df: DataFrame, frequent: np.ndarray, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, k1, k2, key, size, rare, fp, prefix)`` of every row; ``fp``: the text's SimHash; equal sets have equal keys; the first ``rare`` shingles of a prefix are no frequent ones."""
    order = np.argsort(frequent)
    shared = df.sparkSession.sparkContext.broadcast((frequent[order], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        for batch in batches:
            keys, sizes, rare, prints, prefixes = [], [], [], [], []
            for text in batch.column(3).to_pylist():
                own = shingle_set(text, shingle)
                prints.append(simhash.fingerprint(text, shingle))
                place = np.full(len(own), -1)
                if len(known) and len(own):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    place = np.where(known[at] == own, rank[at], -1)
                keys.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                sizes.append(len(own))
                rare.append(int((place < 0).sum()))
                prefixes.append(own[np.lexsort((own, place))[: len(own) + (-4 * len(own) // 5) + 1]])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefixes)]), pa.int32()), pa.array(np.concatenate([*prefixes, np.zeros(0, np.int64)])))
            columns = [*batch.columns[:3], pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(rare, pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64)), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k1", "k2", "key", "size", "rare", "fp", "prefix"])

    narrow = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[c.alias(n) for n, c in text_keys(F.col("text")).items()], F.col("text").cast("binary").alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, k1 bigint, k2 int, key bigint, size int, rare int, fp bigint, prefix array<bigint>")


def sets_of(keys: DataFrame, sets: DataFrame, df: DataFrame, shingle: int) -> tuple[DataFrame, str]:
    """``(key, shingles)`` for the keys asked for, made from one text each, and the folder that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingle_set(t, shingle) for t in batch.column(1).to_pylist()]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, made)]), pa.int32()), pa.array(np.concatenate([*made, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["key", "shingles"])

    asked, place = written_at(sets.join(keys.distinct(), "key", "left_semi").select("key", "k1", "k2"), "asked-sets")
    texts = df.select("text", *[c.alias(n) for n, c in text_keys(F.col("text")).items()]).join(asked, ["k1", "k2"])
    one = texts.groupBy("key").agg(F.first(F.col("text").cast("binary")).alias("text"))
    made = written_at(one.mapInArrow(run, "key bigint, shingles array<bigint>"), "shingle-sets")
    remove_folders(df.sparkSession, [place])
    return made


def verified(pairs: DataFrame, sets: DataFrame, df: DataFrame, shingle: int, kind: str) -> DataFrame:
    """The pairs ``(src, dst)`` whose sets have a Jaccard similarity of at least 0.8, written; the sets, which are as large as the texts, go."""
    made, place = sets_of(pairs.select(F.col("src").alias("key")).union(pairs.select("dst")), sets, df, shingle)
    left = made.select(F.col("key").alias("src"), F.col("shingles").alias("a"))
    # most sets stand on one side only, and need not be shuffled for the other
    right = made.select(F.col("key").alias("dst"), F.col("shingles").alias("b")).join(pairs.select("dst").distinct(), "dst", "left_semi")
    both = F.size(F.array_intersect("a", "b")).cast("bigint")
    links = written(pairs.join(left, "src").join(right, "dst").filter(both * 9 >= (F.size("a") + F.size("b")) * 4).select("src", "dst"), kind)
    remove_folders(df.sparkSession, [place])
    return links


def shared_shingles(sets: DataFrame) -> DataFrame:
    """``(shingle, pos, key, size, first, first_size)`` of the prefix shingles that several sets have, with the smallest of these sets.

    Nearly all shingles stand in one set only. Those that are not frequent meet once, sorted, in one shuffle; the frequent ones, which are few
    and may be in very many sets, are counted by partial aggregation and joined, so that they can be split.
    """
    rows = sets.select("rare", F.posexplode("prefix").alias("pos", "shingle"), "key", "size")
    least = F.min(F.struct("key", "size"))
    alike = Window.partitionBy("shingle")
    seldom = rows.filter("pos < rare").withColumns({"n": F.count("*").over(alike), "f": least.over(alike)})
    often = rows.filter("pos >= rare")
    known = often.groupBy("shingle").agg(F.count("*").alias("n"), least.alias("f"))
    both = seldom.select("shingle", "pos", "key", "size", "n", "f").unionByName(often.join(known, "shingle").select("shingle", "pos", "key", "size", "n", "f"))
    return both.filter("n > 1").select("shingle", "pos", "key", "size", F.col("f.key").alias("first"), F.col("f.size").alias("first_size"))


def simhash_pairs(sets: DataFrame) -> DataFrame:
    """Pairs ``(src, dst)`` of keys that span the sets whose SimHash fingerprints are equal or linked within the radius."""
    prints = sets.filter("size > 0").select("key", "fp")
    nodes = written(prints.groupBy("fp").agg(F.min("key").alias("node")), "set-fingerprints")
    equal = prints.join(nodes, "fp").filter("key <> node").select(F.col("node").alias("src"), F.col("key").alias("dst"))
    return equal.union(simhash.fingerprint_links(nodes)).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))


def with_often(rows: DataFrame, many: int) -> DataFrame:
    """Adds how many of a set's undecided prefix shingles ``(shingle, key, n)`` more than ``many`` sets have."""
    often = rows.filter(F.col("n") > many).groupBy("key").agg(F.count("*").alias("often"))
    return rows.join(often, "key", "left").withColumn("often", F.coalesce("often", F.lit(0)))


def open_pairs(rows: DataFrame, many: int, large: int) -> DataFrame:
    """Pairs ``(src, dst)`` of sets of different components that may be near, from their undecided prefix shingles ``(shingle, pos, key, size, own, n, often)``.

    A near pair has at least ``4 / 9`` of its sizes in common. Common shingles that at most ``many`` sets have are counted; of others a pair
    has at most as many as each of its sets (``often``). A pair without any of the first kind meets at its first common shingle, if the sizes allow that no other is of that kind.
    """
    # both prefixes are known up to where the first of them ends: beyond it one of the sets has only what stands after its prefix
    beyond = lambda n: F.floor((F.col(n) * 4 + 4) / 5) - 1
    least = lambda name: F.least(f"a.{name}", f"b.{name}")
    enough = lambda n: n * 9 >= (F.col("a.size") + F.col("b.size")) * 4
    apart = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.own") != F.col("b.own")) & (least("size") * 5 >= F.greatest("a.size", "b.size") * 4)
    left = F.least(F.col("a.size") - F.col("a.pos"), F.col("b.size") - F.col("b.pos"))
    ends = [F.col(f"{x}.{n}").alias(f"{x}_{n}") for n in ("key", "size", "often") for x in "ab"]

    few = rows.filter(F.col("n") <= many)
    met = few.alias("a").join(few.alias("b"), apart & (F.col("a.key") < F.col("b.key"))).select(*ends, left.alias("left"))
    counted = met.groupBy("a_key", "b_key", "a_size", "b_size", "a_often", "b_often").agg(F.count("*").alias("common"), F.max("left").alias("left"))
    most = F.least("a_often", "b_often") + F.least(F.col("common") + F.greatest(beyond("a_size"), beyond("b_size")), F.col("left"))
    counted = counted.filter(most * 9 >= (F.col("a_size") + F.col("b_size")) * 4).select("a_key", "b_key")

    # the smaller set meets only where some size of the larger one (5 / 4 of its own at most) passes: pos and often bound that size from above and below
    wide = F.col("n") > large
    band = F.when(wide, F.floor(F.log("size") / F.log(F.lit(1.25)))).otherwise(0).cast("int")
    dense = rows.filter(F.col("n") > many)
    largest = F.least(F.floor(F.col("size") * 5 / 4), F.floor((F.col("size") - F.col("pos")) * 9 / 4) - F.col("size"))
    may = (largest >= F.col("size")) & ((F.col("often") + (largest * 4 + 4) / 5 - 1) * 9 >= (F.col("size") + largest) * 4)
    a = dense.filter(may).withColumn("band", F.explode(F.when(wide, F.array(band, band + 1, band + 2)).otherwise(F.array(F.lit(0))))).alias("a")
    b = dense.withColumn("band", band).alias("b")
    order = (F.col("a.band") == F.col("b.band")) & ((F.col("a.size") < F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.key") < F.col("b.key"))))
    reach = enough(left) & enough(least("often") + F.greatest(beyond("a.size"), beyond("b.size")))
    first = a.join(b, apart & order & reach).select(F.least("a.key", "b.key").alias("src"), F.greatest("a.key", "b.key").alias("dst"))
    return counted.toDF("src", "dst").union(first).distinct()


def near_links(sets: DataFrame, prefixes: DataFrame, df: DataFrame, shingle: int = SHINGLE, place: str | None = None) -> DataFrame:
    """Links ``(src, dst)`` between keys of the distinct ``sets(key, size, fp, k1, k2)`` of ``df`` whose components are those of all near pairs.

    ``prefixes(key, size, rare, prefix)`` are read once; then ``place``, their folder, is removed, as are tables made here once nothing reads them again.
    """
    spark = df.sparkSession
    shared, shared_place = written_at(shared_shingles(prefixes.filter("size > 0")), "shared-shingles")
    remove_folders(spark, [place] if place else [])
    reach = F.least("size", "first_size") * 5 >= F.greatest("size", "first_size") * 4  # sizes that allow a similarity of 0.8
    star = shared.filter(reach & (F.col("key") != F.col("first"))).select(F.col("first").alias("src"), F.col("key").alias("dst"))
    star = written(star.union(simhash_pairs(sets)).distinct(), "star-pairs")
    links = verified(star, sets, df, shingle, "star-links")
    found = connected_components(links)
    placed = shared.join(found, F.col("key") == F.col("node"), "left").select("shingle", "pos", "key", "size", F.coalesce("component", "key").alias("own"))
    placed, placed_place = written_at(placed, "placed-shingles")
    remove_folders(spark, [shared_place])
    mixed = placed.groupBy("shingle").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.count("*").alias("n")).filter("low <> high").select("shingle", "n")
    open_rows, open_place = written_at(placed.join(mixed, "shingle"), "open-shingles")
    remove_folders(spark, [placed_place])
    weighed, weighed_place = written_at(with_often(open_rows, MANY), "weighed-shingles")
    remove_folders(spark, [open_place])
    pairs = written(open_pairs(weighed, MANY, LARGE).join(star, ["src", "dst"], "left_anti"), "open-pairs")
    remove_folders(spark, [weighed_place])
    return links.union(verified(pairs, sets, df, shingle, "open-links"))


def near_duplicates(df: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, component_id)`` for every row; the component is the smallest id reachable by near pairs."""
    spark, path = df.sparkSession, new_dir(df.sparkSession, "prefixes")
    prefix_table(df, frequent_shingles(df, shingle), shingle).write.parquet(path)
    made = spark.read.parquet(path)
    marked = written(made.select("doc_id", "key"), "text-keys")
    sets = made.groupBy("key").agg(*(F.first(c).alias(c) for c in ("size", "rare", "prefix")), F.min("fp").alias("fp"), F.min("doc_id").alias("node"), F.min(F.struct("k1", "k2")).alias("k"))
    prefixes, place = written_at(sets.select("key", "node", "size", "rare", "fp", "prefix", "k.k1", "k.k2"), "set-prefixes")
    remove_folders(spark, [path])  # nothing reads it again
    sets = written(prefixes.drop("rare", "prefix"), "sets-once")
    nodes = sets.select("key", "node")
    found = connected_components(near_links(sets, prefixes, df, shingle, place))
    named = nodes.join(found.withColumnRenamed("node", "k"), F.col("key") == F.col("k"), "left").select("key", "node", F.coalesce("component", "key").alias("group"))
    named = written(named, "named-sets")
    first = named.groupBy("group").agg(F.min("node").alias("component_id"))
    named = written(named.join(first, "group").select("key", "component_id"), "set-components")
    return marked.join(named, "key").select("doc_id", "component_id")
