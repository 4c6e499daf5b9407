"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text becomes a sparse vector: statistics of its characters, words and lines and its length, its metadata (the recorded
number of characters, where there is one, and how far it is from the text's own), each also
cut into bins, and its words hashed into a fixed number of columns (unit length). The score is the
logistic of ``w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)``: all pairwise
interactions in time linear in the vector's entries.

The model is fitted in one task from at most ``MAX_TRAIN`` labelled rows, the first by a hash of their
id, whose vectors other tasks make; its size is fixed by ``BUCKETS`` and ``RANK``, and only the model comes to the driver. Every text is scored whole.

Edge cases: null and empty texts have no words and zero statistics and get a score; labels other than 0
and 1 and labels of unknown documents are ignored; without labelled rows every score is 0.5; rows are
scored one by one, so repeated rows and ids do no harm; columns besides id, text and n_chars are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TRAIN = 12_000
BUCKETS, RANK, BINS = 1 << 15, 6, 16
EPOCHS, BATCH, RATE, DECAY = 12, 256, 0.02, 1e-4
SYMBOLS = b"!#$%&*|~^<>{}[]=_\\/@"
STATS = 22
WORDS_AT = STATS * (1 + BINS)
WIDTH = WORDS_AT + BUCKETS
THRESHOLD = 0.7

_CLASS = np.zeros(256, np.int64)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[list(SYMBOLS)] = 4
_CLASS[[9, 11, 12, 13, 32]] = 5
_CLASS[10] = 6
_CLASS[128:] = 7
_columns: dict[bytes, int] = {}


def word_column(word: bytes) -> int:
    if (found := _columns.get(word)) is None:
        if len(_columns) > 1_000_000:
            _columns.clear()
        found = _columns[word] = WORDS_AT + zlib.crc32(word) % BUCKETS
    return found


def statistics(text: bytes, words: list[bytes], counts: Counter, recorded: int | None = None) -> np.ndarray:
    """Values from 0 to about 1. ``recorded``: the characters that the metadata state; without them the text's own count."""
    bytes_of = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    kinds = np.bincount(_CLASS, bytes_of, 8)
    n, w = max(len(text), 1), max(len(words), 1)
    lines = text.split(b"\n")
    repeats = sum(map(eq, words, words[1:]))
    letters = max(kinds[1] + kinds[2], 1)
    most = max(counts.values(), default=0)
    endings = bytes_of[list(b".,;:?")].sum()
    chars = len(text) - int(bytes_of[0x80:0xC0].sum())
    recorded = chars if recorded is None else max(0, recorded)
    return np.array(
        [
            np.log1p(len(text)) / 16, np.log1p(len(words)) / 14, np.log1p(len(lines)) / 10, kinds[1] / letters, kinds[3] / n, kinds[4] / n * 3,
            kinds[4] / w / 4, kinds[5] / n, kinds[6] / n * 10, kinds[7] / n, bytes_of[ord("!")] / w / 2, bytes_of[ord("|")] / w, bytes_of[ord(".")] / w,
            bytes_of[ord(",")] / w, len(counts) / w, most / w, repeats / w, (n / w) / 20, 1 - len(set(lines)) / len(lines), endings / w,
            np.log1p(recorded) / 16, abs(recorded - chars) / max(recorded, chars, 1),
        ]
    ).clip(0, 2)


def vector(text: bytes | None, recorded: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of one text and its metadata."""
    text = text or b""
    words = text.split()
    counts = Counter(text.lower().split())
    stats = statistics(text, words, counts, recorded)
    bins = np.minimum((stats * BINS).astype(int), BINS - 1)
    columns = np.fromiter((word_column(x) for x in counts), np.int64, len(counts))
    values = np.log1p(np.fromiter(counts.values(), float, len(counts)))
    values /= max(np.sqrt((values**2).sum()), 1e-9)
    at = np.concatenate([np.arange(STATS), STATS + np.arange(STATS) * BINS + bins, columns])
    return at.astype(np.int32), np.concatenate([stats, np.full(STATS, 0.5), values]).astype(np.float32)


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, columns: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
        if not columns:
            return np.array([])
        starts = np.r_[0, np.cumsum([len(c) for c in columns])[:-1]]
        at, x = np.concatenate(columns), np.concatenate(values)
        vx = self.factors[at] * x[:, None]
        total = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(vx * vx, starts, axis=0)
        return self.bias + np.add.reduceat(self.linear[at] * x, starts) + 0.5 * (total * total - squares).sum(axis=1)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(columns: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Adam over mini-batches of the logistic loss; the same rows in the same order give the same model."""
    rng = np.random.default_rng(seed)
    if not len(labels):
        return Model(0.0, np.zeros(WIDTH, np.float32), np.zeros((WIDTH, RANK), np.float32))
    share = np.clip(labels.mean(), 0.01, 0.99)
    table = np.zeros((WIDTH, RANK + 1), np.float32)
    table[:, 1:] = rng.normal(0, 0.02, (WIDTH, RANK))
    model = Model(float(np.log(share / (1 - share))), table[:, 0], table[:, 1:])
    mean, spread, step = np.zeros_like(table), np.zeros_like(table), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            lengths = [len(columns[r]) for r in rows]
            starts = np.r_[0, np.cumsum(lengths)[:-1]]
            at, x = np.concatenate([columns[r] for r in rows]), np.concatenate([values[r] for r in rows])
            v = table[at, 1:]
            vx = v * x[:, None]
            total = np.add.reduceat(vx, starts, axis=0)
            squares = np.add.reduceat(vx * vx, starts, axis=0)
            z = model.bias + np.add.reduceat(table[at, 0] * x, starts) + 0.5 * (total * total - squares).sum(axis=1)
            slope = (logistic(z) - labels[rows]).astype(np.float32) / len(rows)
            each = np.repeat(slope, lengths)
            part = np.empty((len(at), RANK + 1), np.float32)
            part[:, 0] = each * x
            part[:, 1:] = each[:, None] * x[:, None] * (np.repeat(total, lengths, axis=0) - vx)
            used, inverse = np.unique(at, return_inverse=True)
            by = np.argsort(inverse, kind="stable")
            first = np.searchsorted(inverse[by], np.arange(len(used)))
            gradient = np.add.reduceat(part[by], first, axis=0) + DECAY * table[used]
            step += 1
            mean[used] = 0.9 * mean[used] + 0.1 * gradient
            spread[used] = 0.99 * spread[used] + 0.01 * gradient**2
            table[used] -= RATE * (mean[used] / (1 - 0.9**step)) / (np.sqrt(spread[used] / (1 - 0.99**step)) + 1e-6)
            model.bias -= RATE * float(slope.sum())
    return model


def vectors(df: DataFrame) -> DataFrame:
    """``(label, turn, columns, values)`` of rows ``(text, n_chars, label, turn)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [vector(t, n) for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(3), pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.float32()))],
                ["label", "turn", "columns", "values"],
            )

    return df.select(F.col("text").cast("binary"), "n_chars", "label", "turn").mapInArrow(run, "label int, turn bigint, columns array<int>, values array<float>")


def recorded(docs: DataFrame) -> Column:
    """The metadata that a score reads: the column ``n_chars`` as a number, null where there is none."""
    return (F.col("n_chars").try_cast("bigint") if "n_chars" in docs.columns else F.lit(None).cast("bigint")).alias("n_chars")


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fits on ``labels(doc_id, label)``; at most ``max_train`` of them, the first by a hash of the id."""
    turn = F.xxhash64(F.lit("train"), "doc_id")
    known = labels.filter("doc_id is not null and label in (0, 1)").select("doc_id", F.col("label").cast("int"), turn.alias("turn"))
    sample = known.orderBy("turn", "label").limit(max_train)
    joined = docs.select("doc_id", "text", recorded(docs)).join(F.broadcast(sample), "doc_id")  # at most max_train rows of three numbers
    one = joined.groupBy("doc_id", "label", "turn").agg(F.min("text").alias("text"), F.min("n_chars").alias("n_chars"))  # documents that share an id count once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (parts := list(batches)):
            return
        got = pa.Table.from_batches(parts)
        order = np.lexsort((got["label"].to_numpy(), got["turn"].to_numpy()))[:max_train]

        def rows(name: str) -> list[np.ndarray]:
            column = got[name].combine_chunks()
            flat, ends = column.flatten().to_numpy(), np.r_[0, np.cumsum(np.diff(column.offsets.to_numpy()))]
            return [flat[ends[r] : ends[r + 1]] for r in order]

        model = fit(rows("columns"), rows("values"), got["label"].to_numpy()[order].astype(np.float32))
        yield pa.RecordBatch.from_arrays([pa.array([model.bias]), pa.array([model.linear.tobytes()]), pa.array([model.factors.tobytes()])], ["bias", "linear", "factors"])

    made = vectors(one).repartition(1).mapInArrow(run, "bias double, linear binary, factors binary").collect()  # the rows of the sample at most
    if not made:
        return fit([], [], np.array([]))
    return Model(made[0]["bias"], np.frombuffer(made[0]["linear"], np.float32), np.frombuffer(made[0]["factors"], np.float32).reshape(WIDTH, RANK))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the score of every row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.linear.copy(), model.factors.copy()))

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = Model(*shared.value)
        for texts, lengths in batches:
            found = []
            for k in range(0, len(texts), 64):
                made = [vector(t, None if pd.isna(n) else int(n)) for t, n in zip(texts.iloc[k : k + 64], lengths.iloc[k : k + 64], strict=True)]
                found.append(logistic(own.margins([m[0] for m in made], [m[1] for m in made])))
            yield pd.Series(np.concatenate(found) if found else np.array([], float))

    return docs.withColumn(out, run(F.col(text).cast("binary"), recorded(docs)))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
