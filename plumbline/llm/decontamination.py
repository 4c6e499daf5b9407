"""Benchmark decontamination: rare word-pair seeds join texts to test items, then Smith-Waterman alignment.

Texts are cut into lower-case words. A text leaks an item if the best score of an alignment, in which a word in
common scores 1 and a changed, added or missing word -1, is at least ``THRESHOLD`` of the item's words; edited and
paraphrased copies with up to a quarter of the words changed reach it. An alignment of ``m`` common words and ``e`` edits
has at least ``m - e - 1`` pairs of neighbouring words in common, so a leak has at least a known number of the item's
pairs, ``need``. Of an item's pairs the rarest in the corpus are its seeds, so many that whatever pairs the
edits destroy, ``hits`` of them are left (all but ``need - hits`` of its pairs, counted with their repeats). Texts with fewer
hits cannot leak the item; all others are aligned. No leak is lost, wherever the edits are.

One pass over the texts keeps, as hashes, the pairs that a Bloom filter of the items' pairs lets through (at most ``MAX_BITS``
bits, whatever the benchmark's size; a fuller filter lets more through). Counts of pairs, seeds and candidates are joins over
that table, and candidates meet texts and items in joins. Equal texts count once. Hashes only find
candidates: the alignment compares words.

Edge cases: null and empty texts leak nothing; items of fewer than ``LEAST`` words cannot be told from
chance and never match; repeated items and rows are each reported; rows may have a null id.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import written

LEAST = 4
THRESHOLD = 0.5
#: Item words for which the filter has full size; its bits; the share of the needed pairs that must be found among the seeds.
BLOCK_WORDS, MAX_BITS = 16_000_000, 1 << 28
HIT_SHARE = 0.25
LEAK = "array<struct<item_id:bigint,score:double,first_word:int,n_words:int>>"
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def pair_codes(ids: np.ndarray) -> np.ndarray:
    """One code for each two neighbouring word numbers; 0 where a word is unknown (number 0)."""
    return np.where((ids[:-1] > 0) & (ids[1:] > 0), (ids[:-1] << 32) | ids[1:], 0)


def local_score(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best local alignment score and where it ends in the window (exclusive)."""
    steps = np.arange(len(window) + 1)
    row = np.zeros(len(window) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        hit = np.where(window == word, 1, -1) if word > 0 else np.full(len(window), -1)
        fresh = np.zeros_like(row)
        fresh[1:] = np.maximum(np.maximum(row[:-1] + hit, row[1:] - 1), 0)
        row = np.maximum.accumulate(fresh + steps) - steps
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
    return best, end


class Items:
    """A block of test items: their word numbers and which items have which word pairs."""

    def __init__(self, rows: list[tuple[int, str]], threshold: float = THRESHOLD):
        self.vocabulary: dict[str, int] = {}
        self.ids = [r[0] for r in rows]
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(r[1])], np.int64) for r in rows]
        self.least = [math.ceil(threshold * len(w) - 1e-9) for w in self.words]
        pairs = [np.unique(pair_codes(w)) if len(w) >= LEAST else np.zeros(0, np.int64) for w in self.words]
        code = np.concatenate([*pairs, np.zeros(0, np.int64)])
        owner = np.repeat(np.arange(len(pairs)), [len(x) for x in pairs])
        order = np.argsort(code, kind="stable")
        self.owner = owner[order]
        self.seeds, self.first, self.count = np.unique(code[order], return_index=True, return_counts=True)
        #: Seeds that a leak has at least, and words of the text that it spans at most.
        self.need = np.array([max(1, x - 1) for x in self.least], np.int64)
        self.span = np.array([2 * len(w) - x for w, x in zip(self.words, self.least, strict=True)], np.int64)

    def leaks(self, text: str | list[str] | None, aligned: dict) -> list[tuple]:
        """``(item_id, score, first word, words)``: the best window of every item that leaks into the text (or list of words)."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in (text if isinstance(text, list) else words(text))], np.int64)
        found = pair_codes(ids)
        hits = np.flatnonzero(_within(found, self.seeds))
        seed = np.searchsorted(self.seeds, found[hits])
        n = self.count[seed]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owner, at = self.owner[np.repeat(self.first[seed], n) + nth], np.repeat(hits, n)
        order = np.argsort(owner, kind="stable")
        owner, at = owner[order], at[order]
        last = np.arange(len(owner)) + self.need[owner] - 1
        inside = np.minimum(last, len(owner) - 1)
        dense = np.flatnonzero((last < len(owner)) & (owner[inside] == owner) & (at[inside] - at <= self.span[owner] - 2))
        spans: dict[int, list[list[int]]] = {}
        for k, first, end in zip(owner[dense].tolist(), at[dense].tolist(), at[last[dense]].tolist(), strict=True):
            low, high = max(0, end + 2 - int(self.span[k])), min(len(ids), first + int(self.span[k]))
            own = spans.setdefault(k, [])
            if own and low <= own[-1][1]:
                own[-1][1] = max(own[-1][1], high)
            else:
                own.append([low, high])
        out = []
        for k, own in spans.items():
            best = None
            for low, high in own:
                window = ids[low:high]
                name = (k, window.tobytes())
                if name not in aligned:
                    if len(aligned) > 200_000:
                        aligned.clear()
                    score, end = local_score(self.words[k], window)
                    if score >= self.least[k]:
                        back, length = local_score(self.words[k][::-1], window[:end][::-1])
                        aligned[name] = (score / len(self.words[k]), end - length, length)
                    else:
                        aligned[name] = None
                if (got := aligned[name]) and (best is None or got[0] > best[0]):
                    best = (got[0], low + got[1], got[2])
            if best:
                out.append((self.ids[k], float(best[0]), int(best[1]), int(best[2])))
        return out


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


class WordHashes(dict):
    """64-bit hashes of words, kept for the words of a task."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found

    def pairs(self, text: str | None) -> np.ndarray:
        """One hash for each two neighbouring words."""
        found = words(text)
        one = np.fromiter(map(self.__getitem__, found), np.uint64, len(found))
        mixed = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (one[1:] + (one[1:] << np.uint64(17)))
        return (mixed ^ (mixed >> np.uint64(31))).view(np.int64)


def text_keys(text: Column) -> dict[str, Column]:
    """Two hashes under which equal texts meet."""
    return {"_k1": F.xxhash64(text), "_k2": F.hash(text)}


def item_pairs(benchmark: DataFrame, threshold: float) -> DataFrame:
    """``(item, pair, times, words, need)`` for every distinct item text's distinct word pairs; ``item`` is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(words(text))
                if n >= LEAST:
                    need = max(1, math.ceil(threshold * n - 1e-9) - 1)
                    out += [(item, pair, times, n, need) for pair, times in zip(*(x.tolist() for x in np.unique(hashes.pairs(text), return_counts=True)), strict=True)]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["item", "pair", "times", "words", "need"])

    items = benchmark.select(F.xxhash64("text").alias("item"), "text").dropDuplicates(["item"])
    return written(items.mapInArrow(run, "item bigint, pair bigint, times int, words int, need int"), "item-pairs")


def pair_filter(pairs: DataFrame, block_words: int) -> np.ndarray:
    """A Bloom filter with one hash of the items' pairs, as bytes; a power of two of bits, at most ``MAX_BITS``."""
    n = min(pairs.count(), block_words)
    bits = min(MAX_BITS, 1 << max(10, (16 * n).bit_length()))
    place = F.pmod("pair", F.lit(bits).cast("bigint"))
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(32)).cast("int"))
    rows = pairs.groupBy(F.floor(place / 32).alias("at")).agg(F.bit_or(mask).alias("mask")).toArrow()  # at most bits / 32 rows
    filled = np.zeros(bits // 32, np.uint32)
    filled[rows["at"].to_numpy()] = rows["mask"].to_numpy().astype(np.uint32)
    return filled


def text_pairs(docs: DataFrame, pairs: DataFrame, block_words: int) -> DataFrame:
    """``(_k1, _k2, pairs)``: for every distinct text its distinct word pairs that the filter lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(pair_filter(pairs, block_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, hashes = shared.value, WordHashes()
        last = np.uint64(len(filled) * 32 - 1)
        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                found = hashes.pairs(text)
                at = found.view(np.uint64) & last
                rows.append(np.unique(found[(filled[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0]))
            kept = pa.array([k for k, x in enumerate(rows) if len(x)], pa.int32())
            rows = [x for x in rows if len(x)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate([*rows, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), lists], ["_k1", "_k2", "pairs"])

    keyed = docs.filter("text is not null").select(*[c.alias(n) for n, c in text_keys(F.col("text")).items()], "text")
    found = keyed.mapInArrow(run, "_k1 bigint, _k2 int, pairs array<bigint>")
    return written(found.groupBy("_k1", "_k2").agg(F.first("pairs").alias("pairs")), "text-pairs")


def candidates(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(_k1, _k2, item)``: texts and items with so many seeds in common that a leak is possible."""
    pairs = item_pairs(benchmark, threshold)
    long = text_pairs(docs, pairs, block_words).select("_k1", "_k2", F.explode("pairs").alias("pair"))
    counts = long.groupBy("pair").agg(F.count("*").alias("texts"))
    rarest = Window.partitionBy("item").orderBy(F.coalesce("texts", F.lit(0)), "pair").rowsBetween(Window.unboundedPreceding, -1)
    hits = F.greatest(F.lit(1), F.floor(F.col("need") * HIT_SHARE)).cast("int")
    ranked = pairs.join(counts, "pair", "left").withColumns({"hits": hits, "before": F.coalesce(F.sum("times").over(rarest), F.lit(0))})
    # all pairs but need - hits, counted with repeats, from the rarest on
    seeds = written(ranked.filter(F.col("before") < F.col("words") - 1 - F.col("need") + F.col("hits")).select("pair", "item", "times", "hits"), "pair-seeds")
    met = long.join(seeds, "pair").groupBy("_k1", "_k2", "item").agg(F.sum("times").alias("n"), F.first("hits").alias("hits"))
    return written(met.filter("n >= hits").select("_k1", "_k2", "item"), "leak-candidates")


def aligned(rows: DataFrame, threshold: float) -> DataFrame:
    """The leaks among rows ``(_text, item_id, _item, ...)``: other columns, ``item_id, score, first_word, n_words``."""
    others = [c for c in rows.columns if c not in ("_text", "_item", "item_id")]
    rows = rows.select("_text", "_item", "item_id", *others)
    names = ["item_id", *others, "score", "first_word", "n_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[Items, dict]] = {}
        last, found = None, []
        for batch in batches:
            kept, made = [], []
            for k, (text, item) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if text != last:
                    last, found = text, words(text)
                if item not in seen:
                    if len(seen) > 10_000:
                        seen.clear()
                    seen[item] = (Items([(0, item)], threshold), {})
                own, done = seen[item]
                if leak := own.leaks(found, done):
                    kept.append(k)
                    made.append(leak[0][1:])
            columns = list(zip(*made, strict=True)) or [()] * 3
            part = batch.take(pa.array(kept, pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns[2:], *(pa.array(c, t) for c, t in zip(columns, (pa.float64(), pa.int32(), pa.int32()), strict=True))], names)

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select("item_id", *others).dtypes) + ", score double, first_word int, n_words int"
    return rows.mapInArrow(run, schema)


def leak_table(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, item_id, score, first_word, n_words)`` for every leaked item of every row."""
    found = candidates(docs, benchmark, threshold, block_words)
    items = benchmark.select(F.xxhash64("text").alias("item"), "item_id", F.col("text").alias("_item"))
    texts = docs.select("doc_id", F.col("text").alias("_text"), *[c.alias(n) for n, c in text_keys(F.col("text")).items()])
    rows = texts.join(found, ["_k1", "_k2"]).join(items, "item").select("_text", "_item", "item_id", "doc_id")
    return aligned(rows, threshold).select("doc_id", "item_id", "score", "first_word", "n_words")


def with_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, out: str = "leaks", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds an array of the items that leak into each row's text, with score and place in words."""
    found = candidates(docs, benchmark, threshold, block_words)
    items = benchmark.select(F.xxhash64("text").alias("item"), F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("_item"))
    keys = [c.alias(n) for n, c in text_keys(F.col("text")).items()]
    texts = docs.select(*keys, F.col("text").alias("_text")).join(found, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2", "item"])
    leaks = aligned(texts.join(items, "item").select("_text", "_item", "item_id", "_k1", "_k2"), threshold)
    grouped = leaks.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_list(F.struct("item_id", "score", "first_word", "n_words"))).alias(out))
    joined = docs.drop(out).withColumns(text_keys(F.col("text"))).join(written(grouped, "leaks-by-text"), ["_k1", "_k2"], "left")
    return joined.withColumn(out, F.coalesce(out, F.array().cast(LEAK))).select(*[c for c in docs.columns if c != out], out)
