"""Spelling variants: words at one edit, found by two-dimensional range reporting with wavelet trees.

A word that has ``x`` inserted or replaced at place ``i`` of another keeps the ``i`` code points before and all those after it. Of
the words of one length, those with the same beginning are an interval in forward order and those with the same ending
an interval in reverse order; the words in both are the near words of that edit place. A wavelet tree over the
reverse ranks in forward order reports the points of the rectangle, for all words and places of a task at a time.
Deletions are insertions seen from the other word.

Spark deals the words out. The places of a length are cut into ``RANGES`` ranges, and words meet if they agree in
all code points outside a range, that is in about two thirds of them: words of length ``l`` as targets, and words of length ``l - 1``,
which lack one code point in the range, as sources of insertions. A task holds such groups by hash, about ``TASK_WORDS`` words;
it returns one row a word with near words: their number, and the one of largest count. Every pair is found at one
place (an insertion into a run of equal code points at the first of them) and so in one task.

Edge cases: a null text has no runs; a null id reads as nothing before the colon; counts add up over rows that repeat
an id or a text; an empty table gives no rows; words of any length take part. Other columns of the input play no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import shared_dir, written

RUN_PATTERN = re.compile("[a-zÀ-ÿ]+")
DELETED_ONE_IN, MIN_LENGTH, MIN_COUNT, FACTOR = 199, 6, 5, 5
RANGES, TASK_WORDS = 3, 8_000
FLUSH = 100_000


def words_of(doc_id: int | None, text: bytes) -> Counter:
    """The runs of a text and how often they occur; where the checksum says so, with one code point deleted."""
    runs = Counter(RUN_PATTERN.findall(text.lower().decode()))
    salt = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    found: Counter = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), salt)
        if h % DELETED_ONE_IN == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        found[run] += n
    return found


def word_table(df: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)`` of the words of ``(doc_id, text)`` that are long and frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in words_of(doc_id, text.as_py() or b"").items():
                    if len(word) >= min_length:
                        counts[word] += n
                if len(counts) >= FLUSH:
                    yield rows()
                    counts.clear()
        yield rows()

    found = df.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class WaveletTree:
    """Range reporting over a sequence of distinct ranks: levels of bits from the highest, zeros before ones on the next."""

    def __init__(self, ranks: np.ndarray) -> None:
        self.bits = max(1, int(len(ranks) - 1).bit_length())
        self.ones: list[np.ndarray] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (ranks >> level) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)])
            ranks = np.r_[ranks[bit == 0], ranks[bit == 1]]

    def report(self, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(query, rank)`` of every value in ``[least, most)`` at a place in ``[low, high)``, for many queries at once."""
        query, value = np.arange(len(low)), np.zeros(len(low), np.int64)
        for k, ones in enumerate(self.ones):
            level = self.bits - 1 - k
            zeros = len(ones) - 1 - ones[-1]
            one_low, one_high = ones[low], ones[high]
            low, high = np.r_[low - one_low, zeros + one_low], np.r_[high - one_high, zeros + one_high]
            value = np.r_[value, value + (1 << level)]
            query = np.r_[query, query]
            keep = np.flatnonzero((low < high) & (value < most[query]) & (value + (1 << level) > least[query]))
            low, high, value, query = low[keep], high[keep], value[keep], query[keep]
        return query, value


class Order:
    """Rows of a byte matrix in sorted order, and for a prefix length the interval of targets that each row shares it with."""

    def __init__(self, rows: np.ndarray, is_target: np.ndarray) -> None:
        n, width = rows.shape
        self.order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable")
        first = np.full(n, width, np.int64)  # of the first place in which a row differs from the row before
        for at in range(1, n, 1 << 16):
            part = self.order[at - 1 : at + (1 << 16)]
            apart = rows[part[1:]] != rows[part[:-1]]
            first[at : at + (1 << 16)] = np.where(apart.any(axis=1), apart.argmax(axis=1), width)
        first[0] = -1
        self.first = first
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        self.targets = np.r_[0, np.cumsum(is_target[self.order])]

    def intervals(self, prefix: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of targets, from and to, for every row in its own order."""
        starts = np.flatnonzero(self.first < prefix)
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(self.first)]))[self.place]
        ends = np.r_[starts[1:], len(self.first)]
        return self.targets[starts][group], self.targets[ends][group]


def near_pairs(words: list[bytes], length: int, places: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of distinct ``words`` (of ``length`` or one less bytes) at one edit in those places: the second has ``length``."""
    rows = np.frombuffer(b"".join(w.ljust(length, b"\0") for w in words), np.uint8).reshape(-1, length)
    sizes = np.array([len(w) for w in words])
    is_target = sizes == length
    targets = np.flatnonzero(is_target)
    if not len(targets) or len(words) < 2:
        return
    backward = np.frombuffer(b"".join(w[::-1].ljust(length, b"\0") for w in words), np.uint8).reshape(-1, length)
    forward, reverse = Order(rows, is_target), Order(backward, is_target)
    in_forward, in_reverse = forward.order[is_target[forward.order]], reverse.order[is_target[reverse.order]]
    rank = np.empty(len(words), np.int64)
    rank[in_reverse] = np.arange(len(targets))
    tree = WaveletTree(rank[in_forward])
    own = is_target.astype(np.int64)
    for i in places:
        low, high = forward.intervals(i)
        least, most = reverse.intervals(length - 1 - i)
        asked = np.flatnonzero((high - low > own) & (most - least > own))  # others share it with themselves alone
        query, value = tree.report(low[asked], high[asked], least[asked], most[asked])
        a, b = asked[query], in_reverse[value]
        replaced = is_target[a]
        fresh = np.where(replaced, a < b, rows[b, i] != rows[b, i - 1] if i else True)
        yield a[fresh], b[fresh]


def block_summary(words: list[bytes], n: np.ndarray, length: int, places: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (by index) that have near words in those places, how many, and the index of the one of largest count."""
    order = sorted(range(len(words)), key=lambda k: (-n[k], words[k]))
    standing = np.empty(len(words), np.int64)  # 0: largest count, then smallest word
    standing[order] = np.arange(len(words))
    near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
    for a, b in near_pairs(words, length, places):
        for x, y in ((a, b), (b, a)):
            near += np.bincount(x, minlength=len(words))
            np.minimum.at(best, x, standing[y])
    some = np.flatnonzero(near)
    return some, near[some], np.array(order, np.int64)[best[some]]


def bounds(length: int, ranges: int = RANGES) -> list[int]:
    return [length * k // ranges for k in range(ranges + 1)]


def near_table(words: DataFrame, ranges: int = RANGES, task_words: int = TASK_WORDS) -> DataFrame:
    """``(word, n_near, best)`` of the words of ``(word, n)`` that have near words; ``best`` is ``(-n, word)`` of the largest."""
    size = F.length("word")
    roles = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("len")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("range"), (F.col("len") - size).alias("short")
    )
    low, high = F.floor(F.col("len") * F.col("range") / ranges), F.floor(F.col("len") * (F.col("range") + 1) / ranges)
    outside = F.xxhash64(F.substring("word", F.lit(1), low.cast("int")), F.substring("word", (high + 1 - F.col("short")).cast("int"), F.col("len")))
    lengths = words.groupBy(size.alias("len")).agg(F.count("*").alias("n"))
    blocks = lengths.select("len", "n").union(lengths.select(F.col("len") + 1, "n")).groupBy("len").agg(F.ceil(F.sum("n") / task_words).alias("blocks"))
    keyed = roles.join(blocks, "len").select("word", "n", "len", "range", F.pmod(outside, F.col("blocks")).alias("block"))

    def run(table: pa.Table) -> pa.Table:
        length, k = table.column("len")[0].as_py(), table.column("range")[0].as_py()
        texts, n = table.column("word").to_pylist(), table.column("n").to_numpy()
        edges = bounds(length, ranges)
        some, near, best = block_summary([w.encode("latin-1") for w in texts], n, length, range(edges[k], edges[k + 1]))
        return pa.table({"word": pa.array([texts[i] for i in some], pa.string()), "n_near": near, "best_n": n[best], "best": pa.array([texts[i] for i in best], pa.string())})

    found = keyed.groupBy("len", "range", "block").applyInArrow(run, "word string, n_near bigint, best_n bigint, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for ``(word, form)``, following forms to the last by doubling; counts rise along forms, so there is no cycle."""
    shared_dir(forms.sparkSession)
    up = forms.select("word", F.col("form").alias("root")).checkpoint()
    while True:
        on = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = up.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")).checkpoint()
        up = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return up


def variants(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, factor: int = FACTOR
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word."""
    narrow = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    words = written(word_table(narrow, min_length, min_count), "words")
    near = near_table(words)
    strong: Column = -F.col("best.n") >= F.col("n") * factor
    known = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(strong, F.col("best.word")).alias("form"), F.when(strong, -F.col("best.n")).alias("form_n")
    )
    table = written(known, "near-words")
    last = roots(table.filter("form is not null").select("word", "form"))
    return table.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
