"""Language-model scores by a hidden Markov model over words.

Latent states emit word classes: every frequent training word is a class of its own, other words fall into
classes by their ending, and the end of a text is a class. Inside a class of many words a word has
the share of its count (plus one) in the class, so ``P(word | state) = P(class | state) P(word | class)`` sums to one over all
training words and one unseen word a class. Texts are lower-cased (A-Z) and cut at ASCII white space.

Training is Baum-Welch over all training tokens. A round runs forward and backward recursions in every task and returns,
for each class, the expected counts of its states; Spark adds them up over the partitions, and the driver, which gets one
row a class, makes the next parameters from them. Sequences are trained in stretches: a stretch begins with the last
token of the one before it, so that every transition and every emission is counted once; stretches that
continue a text have a start distribution of their own. The first pass over all training texts goes by ``BLOCKS`` blocks of them and makes new parameters
after each (stepwise Baum-Welch); the rounds over everything follow. Scoring runs the scaled forward recursion over whole texts, which is the exact likelihood.

Counts of words grow with the corpus and stay in a table. The most frequent words of all documents, at most ``LOOKUP``, go to every
task; occurrences of other words are joined to the table, so no key of that join is frequent.

Edge cases: a null text is an empty one, whose only token is its end; rows with a null id are training rows;
rows that share an id or a text are counted and scored each; without training documents every class is equally likely in every state and
nothing is known; an empty table gives no rows. Other columns of the input play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written

WORDS, BUCKETS, LOOKUP = 8192, 512, 200_000
STATES, ROUNDS = 16, 2
BLOCKS = 20
STRETCH, STRETCHES = 128, 2048
ENDING = 4
SLICE = 8 << 20
FOLDS, HELD = 7, 2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def bucket(word: Column, buckets: int) -> Column:
    """The class of a word that has none of its own, by its last bytes."""
    return (F.crc32(F.substring(word.cast("binary"), -ENDING, ENDING)) % buckets).cast("int")


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[slice]:
    """Runs of rows of about ``most`` bytes of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, stop)
        at = stop


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the place among them of every word in order, and the number of words of every text."""
    whole = texts.take(pa.array(np.arange(len(texts))))  # the split below needs an array that begins at its buffers' start
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(whole.cast(pa.large_string()), "")))
    flat, lengths = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.not_equal(pc.binary_length(flat), 0)  # white space at an end leaves an empty piece
    owner = np.repeat(np.arange(len(lengths)), lengths)[real.to_numpy(zero_copy_only=False)]
    coded = flat.filter(real).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.bincount(owner, minlength=len(lengths))


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n, n_all)``: occurrences in training documents and in all of ``(held_out, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                words, at, sizes = tokens(batch.column(1)[part])
                train = np.repeat(~batch.column(0)[part].to_numpy(zero_copy_only=False).astype(bool), sizes)
                both = [pa.array(np.bincount(x, minlength=len(words))) for x in (at[train], at)]
                yield pa.RecordBatch.from_arrays([words.cast(pa.string()), *both], ["word", "n", "n_all"])

    found = docs.select("held_out", "text").mapInArrow(run, "word string, n bigint, n_all bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


@dataclass
class Lexicon:
    """The frequent words with their training counts and classes, and the totals that probabilities need.

    Class 0 is the end of a text, ``1..size`` are words, and buckets follow.
    """

    words: pa.Array
    n: np.ndarray
    classes: np.ndarray
    size: int
    buckets: int
    bucket_totals: np.ndarray  # training tokens and words of a bucket, plus one unseen word
    class_counts: np.ndarray
    tokens: int
    distinct: int

    @property
    def n_classes(self) -> int:
        return 1 + self.size + self.buckets


def frequent_words(counts: DataFrame, lookup: int) -> DataFrame:
    """The words of :func:`word_counts` above a number of occurrences, the lowest one that leaves at most ``lookup`` of them.

    The number comes from a histogram of some thousand bins, so that no task sends more than its share of the words.
    """
    place = F.floor(F.log(F.col("n_all")) * 50)
    bins = counts.groupBy(place.alias("bin")).agg(F.count("*").alias("words"), F.min("n_all").alias("least")).orderBy(F.desc("bin")).collect()
    total, least = 0, 1 << 62
    for b in bins:
        total += b["words"]
        if total > lookup:
            break
        least = b["least"]
    return counts.filter(F.col("n_all") >= least)


def lexicon(counts: DataFrame, train_docs: int, n_words: int = WORDS, buckets: int = BUCKETS, lookup: int = LOOKUP) -> Lexicon:
    """From a written table of :func:`word_counts`; collects at most ``lookup`` words and a row for each bucket."""
    top = frequent_words(counts, lookup).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    n = top.column("n").to_numpy().astype(np.int64)
    words = pa.concat_arrays(top.column("word").chunks) if top.num_rows else pa.array([], pa.string())
    size = int(min(n_words, (n > 0).sum()))
    of = np.array([zlib.crc32(w[-ENDING:]) % buckets for w in words.cast(pa.binary()).to_pylist()], np.int64).reshape(-1)
    classes = 1 + size + of
    classes[:size] = 1 + np.arange(size)
    sums, kinds = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    rows = counts.filter("n > 0").groupBy(bucket(F.col("word"), buckets).alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()
    for r in rows:
        sums[r["k"]], kinds[r["k"]] = r["n"], r["kinds"]
    all_tokens, all_kinds = int(sums.sum()), int(kinds.sum())
    sums -= np.bincount(of[:size], n[:size], buckets).astype(np.int64)
    kinds -= np.bincount(of[:size], minlength=buckets)
    return Lexicon(
        words, n, classes, size, buckets, sums + kinds + 1, np.r_[train_docs, n[:size], sums], all_tokens + train_docs, all_kinds + (train_docs > 0)
    )


def encoded(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """Class sequences (16-bit) of ``(doc_id, held_out, text)``, with sums over the words whose counts are at hand and the others with theirs.

    ``plus``: sum of ``log10(n + 1)``; ``inner``: of ``log10 P(word | class)``, as if words to be joined, in ``rare``, were unseen.
    """
    shared = docs.sparkSession.sparkContext.broadcast((lex.words, lex.n, lex.classes))
    size, buckets, totals, end = lex.size, lex.buckets, np.log10(lex.bucket_totals), int(lex.class_counts[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, classes = shared.value
        logs = np.log10(n + 1.0)
        for batch in batches:
            for part in slices(batch.column(2)):
                words, at, sizes = tokens(batch.column(2)[part])
                words = words.cast(pa.string())
                found = pc.fill_null(pc.index_in(words, known), -1).to_numpy(zero_copy_only=False)
                own = np.where(found >= 0, classes[found] if len(n) else 0, 0)
                missing = np.flatnonzero(found < 0)
                own[missing] = [1 + size + zlib.crc32(w[-ENDING:]) % buckets for w in words.take(pa.array(missing)).cast(pa.binary()).to_pylist()]
                plus_of = np.where(found >= 0, logs[found] if len(n) else 0.0, 0.0)
                known_of = np.where(found >= 0, n[found] > 0 if len(n) else False, False)
                inner_of = np.where(own > size, plus_of - totals[np.maximum(own - size - 1, 0)], 0.0)
                row = np.repeat(np.arange(len(sizes)), sizes)
                total = lambda of: np.bincount(row, of[at], len(sizes))  # noqa: E731, B023
                ends = np.cumsum(sizes + 1)
                sequence = np.zeros(len(at) + len(sizes), "<u2")
                sequence[np.arange(len(at)) + row] = own[at]  # what is left is 0, the end
                data = sequence.tobytes()
                rare = np.flatnonzero(found[at] < 0)
                keys, times = np.unique(row[rare] * (len(words) + 1) + at[rare], return_counts=True)
                starts = np.searchsorted(keys, np.arange(len(sizes) + 1) * (len(words) + 1)).astype(np.int32)
                items = pa.StructArray.from_arrays([words.take(pa.array(keys % (len(words) + 1))), pa.array(times.astype(np.int32))], ["word", "times"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[part], batch.column(1)[part], pa.array(sizes + 1), pa.array((total(known_of) + (end > 0)).astype(np.int64)),
                        pa.array(total(plus_of) + np.log10(end + 1)), pa.array(total(inner_of)),
                        pa.array([data[2 * e : 2 * s] for e, s in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(starts), items),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "plus", "inner", "classes", "rare"],
                )

    kind = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, plus double, inner double, classes binary, rare array<struct<word:string,times:int>>"
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, kind)


@dataclass
class Model:
    """``start``: of texts and of stretches that continue one; ``step``: state to state; ``emit``: class by state."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def first_model(class_counts: np.ndarray, states: int, seed: int = 0) -> Model:
    """Class frequencies, disturbed differently for every state."""
    rng = np.random.default_rng(seed)
    share = (class_counts + 1.0) / (class_counts + 1.0).sum()
    emit = share[:, None] * rng.uniform(0.5, 1.5, (len(share), states))
    step = rng.uniform(0.5, 1.5, (states, states)) + states * np.eye(states)
    return Model(np.full((2, states), 1 / states), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def next_model(start: np.ndarray, step: np.ndarray, emit: np.ndarray, class_counts: np.ndarray, prior: float = 10.0) -> Model:
    """Parameters from expected counts, with a prior of the class frequencies."""
    share = (class_counts + 1.0) / (class_counts + 1.0).sum()
    emit = emit + prior * share[:, None]
    start, step = start + 1.0, step + 1.0
    return Model(start / start.sum(axis=1, keepdims=True), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def stretches(sequences: list[bytes], length: int = STRETCH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(classes, sizes, continues)`` of at most ``STRETCHES`` stretches at a time; the classes one after the other."""
    parts: list[bytes] = []
    inner: list[bool] = []
    for s in sequences:
        for at in range(0, max(1, len(s) // 2 - 1), length):  # a stretch has one token of the one before it
            parts.append(s[2 * at : 2 * (at + length + 1)])
            inner.append(at > 0)
            if len(parts) == STRETCHES:
                yield np.frombuffer(b"".join(parts), "<u2"), np.array([len(p) // 2 for p in parts]), np.array(inner)
                parts, inner = [], []
    if parts:
        yield np.frombuffer(b"".join(parts), "<u2"), np.array([len(p) // 2 for p in parts]), np.array(inner)


def expected(model: Model, classes: np.ndarray, sizes: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts and steps, and the classes seen with those of their emissions."""
    order = np.argsort(-sizes, kind="stable")
    begins = (np.cumsum(sizes) - sizes)[order]
    sizes, kind = sizes[order], inner[order].astype(int)
    longest = int(sizes[0])
    alive = np.searchsorted(-sizes, -np.arange(longest), "left")  # stretches of more than t tokens
    seen = [classes[begins[:n] + t] for t, n in enumerate(alive)]
    likely = [model.emit[s] for s in seen]
    forward, scales = [], []
    now = model.start[kind] * likely[0]
    for t, n in enumerate(alive):
        if t:
            now = (now[:n] @ model.step) * likely[t]
        scale = now.sum(axis=1, keepdims=True)
        now = now / scale
        forward.append(now)
        scales.append(scale)
    step = np.zeros_like(model.step)
    back = np.ones((len(sizes), model.step.shape[0]))
    for t in range(longest - 1, 0, -1):
        n = alive[t]
        ahead = likely[t] * back[:n] / scales[t]
        forward[t] *= back[:n]  # now the states' probabilities
        step += forward[t - 1][:n].T @ ahead
        back[:n] = ahead @ model.step.T
    forward[0] *= back
    start = np.stack([forward[0][kind == k].sum(axis=0) for k in (0, 1)])
    seen[0], forward[0] = seen[0][kind == 0], forward[0][kind == 0]  # the stretch before has counted the others
    flat, weight = np.concatenate(seen), np.concatenate(forward)
    by = np.argsort(flat, kind="stable")
    flat = flat[by]
    at = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]][: len(flat)])
    sums = np.add.reduceat(weight[by], at, axis=0) if len(at) else np.zeros((0, len(step)))
    return start, step * model.step, flat[at].astype(np.int64), sums


def gathered(model: Model, sequences: Iterator[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts over lists of sequences."""
    start, step, emit = np.zeros_like(model.start), np.zeros_like(model.step), np.zeros_like(model.emit)
    for some in sequences:
        for part in stretches(some):
            a, b, classes, sums = expected(model, *part)
            start += a
            step += b
            emit[classes] += sums
    return start, step, emit


def counted(sequences: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts over all of ``(classes)``, added up by Spark; the driver gets a row a class."""
    states = model.step.shape[0]
    names = [f"s{k}" for k in range(states)]
    schema = "kind int, class bigint, " + ", ".join(f"{n} double" for n in names)
    shared = sequences.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = gathered(shared.value, (batch.column(0).to_pylist() for batch in batches))
        for kind, counts in enumerate(found):
            rows = np.flatnonzero(counts.sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), kind, np.int32)), pa.array(rows), *(pa.array(counts[rows, k]) for k in range(states))], ["kind", "class", *names]
            )

    rows = sequences.select("classes").mapInArrow(run, schema).groupBy("kind", "class").agg(*(F.sum(n).alias(n) for n in names)).collect()
    counts = (np.zeros_like(model.start), np.zeros_like(model.step), np.zeros_like(model.emit))
    for r in rows:
        counts[r["kind"]][r["class"]] = [r[n] for n in names]
    shared.unpersist()
    return counts


def train(sequences: DataFrame, lex: Lexicon, states: int = STATES, rounds: int = ROUNDS, blocks: int = BLOCKS) -> Model:
    """Baum-Welch over all of ``(doc_id, classes)``: one pass block by block, each block of texts once, then ``rounds`` over everything."""
    model = first_model(lex.class_counts, states)
    total = [np.zeros_like(x) for x in (model.start, model.step, model.emit)]
    block = F.pmod(F.xxhash64("doc_id", "classes"), F.lit(blocks))
    for k in range(blocks):
        own, rate = counted(sequences.filter(block == k), model), (k + 1) ** -0.7
        total = [(1 - rate) * t + rate * blocks * o for t, o in zip(total, own, strict=True)]
        model = next_model(*total, lex.class_counts)
    for _ in range(rounds):
        model = next_model(*counted(sequences, model), lex.class_counts)
    return model


def likelihood(model: Model, sequences: list[bytes]) -> np.ndarray:
    """``log10`` of the probability of each whole class sequence: the forward recursion, scaled at every token."""
    sizes = np.array([len(s) // 2 for s in sequences], np.int64)
    order = np.argsort(-sizes, kind="stable")
    flat, begins = np.frombuffer(b"".join(sequences), "<u2"), (np.cumsum(sizes) - sizes)[order]
    ranked = -sizes[order]
    out = np.zeros(len(sizes))
    now, n = None, len(sizes)
    for t in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(ranked[:n], -t, "left"))
        now = (model.start[0] if now is None else now[:n] @ model.step) * model.emit[flat[begins[:n] + t]]
        scale = now.sum(axis=1)
        out[:n] += np.log10(scale)
        now /= scale[:, None]
    back = np.empty_like(out)
    back[order] = out
    return back


def scored(table: DataFrame, model: Model) -> DataFrame:
    """Adds ``hmm``, the ``log10`` probability of the classes, in place of them."""
    shared = table.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in table.columns if c not in ("classes", "rare")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = likelihood(shared.value, batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], [*batch.schema.names[:-1], "hmm"])

    kinds = dict(table.dtypes)
    return table.select(*kept, "classes").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", hmm double")


def language_scores(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS, n_words: int = WORDS, buckets: int = BUCKETS, lookup: int = LOOKUP
) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row."""
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    counts = written(word_counts(docs), "word-counts")
    lex = lexicon(counts, docs.filter(~F.col("held_out")).count(), n_words, buckets, lookup)
    table = written(encoded(docs, lex).withColumn("row", F.monotonically_increasing_id()), "class-sequences")
    model = train(table.filter(~F.col("held_out")).select("doc_id", "classes"), lex, states, rounds)
    rare = table.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    met = rare.join(counts.filter("n > 0").select("word", "n"), "word").groupBy("row")
    met = met.agg(F.sum("times").alias("times"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"))
    more = F.coalesce("more", F.lit(0.0))
    base = F.col("plus") + more - F.col("n_tokens") * F.lit(float(np.log10(lex.tokens + lex.distinct + 1)))
    return scored(table, model).join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("times", F.lit(0))).alias("n_known"), F.lit(lex.tokens).cast("bigint").alias("train_tokens"),
        base.alias("base_score"), (F.col("hmm") + F.col("inner") + more).alias("score"),
    )
