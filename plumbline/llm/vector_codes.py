"""Vector codes: product quantisation whose nearest entries are found by partial-distance search.

Vectors become integers and are cut into equal consecutive parts; each part position has a codebook of
entries. In a round every task assigns its parts to the nearest entries and returns, for each entry, the
sum and number of its parts; Spark adds them up, and the driver, which gets one row an entry, replaces
each entry by the floor of its mean. What is sent to the tasks are the codebooks: ``PARTS x ENTRIES`` parts.

The search of a nearest entry is exact. Dimensions are processed in descending variance over the codebook. After the
first few, the entry that is nearest so far gets its distance completed: the current best complete distance.
From then on, pairs of a part and an entry whose accumulated integer distance strictly exceeds it are dropped by
vectorised masks, dimension by dimension, and the best is renewed from what is left half-way. Ties go to the lower index.

Edge cases: rows whose vector is null or holds null or non-finite components are dropped; a vector whose
length is no multiple of the parts, or is not that of the first kept vector (smallest id), stays with null code and error.
Integers beyond what a long can hold as squared distance of a part saturate there. Rows with a null id are coded
but come last as first entries; rows that share an id come in order of their values. Fewer rows than entries: the codebook has as many
entries as there are rows. An empty table gives no rows. Other columns of the input play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
HEAD = 4
RUN = 2048

Codebooks = list[np.ndarray]


def integers(values: np.ndarray, part: int, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)``, saturated where the squared distance of a part would leave a long."""
    limit = float(int((2**61 / max(1, part)) ** 0.5) // 2)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * scale), -limit, limit).astype(np.int64)


def nearest(parts: np.ndarray, entries: np.ndarray, head: int = HEAD, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and its squared distance for each part, by partial-distance search."""
    order = np.argsort(-entries.astype(np.float64).var(axis=0), kind="stable")
    head = min(head, len(order))
    codes, errors = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    for at in range(0, len(parts), run):
        x = parts[at : at + run]
        so_far = np.zeros((len(x), len(entries)), np.int64)
        for d in order[:head]:
            step = x[:, d, None] - entries[None, :, d]
            so_far += step * step
        guess = so_far.argmin(axis=1)
        best = ((x - entries[guess]) ** 2).sum(axis=1)
        row, entry = np.nonzero(so_far <= best[:, None])
        total = so_far[row, entry]
        for k, d in enumerate(order[head:], head):
            step = x[row, d] - entries[entry, d]
            total += step * step
            if k == (head + len(order)) // 2:
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                lead = np.flatnonzero(total == np.repeat(np.minimum.reduceat(total, first), np.diff(np.r_[first, len(row)])))
                np.minimum.at(best, row[lead], ((x[row[lead]] - entries[entry[lead]]) ** 2).sum(axis=1))
            alive = total <= best[row]
            row, entry, total = row[alive], entry[alive], total[alive]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(total, first)
        chosen = np.flatnonzero(total == np.repeat(least, np.diff(np.r_[first, len(row)])))
        chosen = chosen[np.unique(row[chosen], return_index=True)[1]]  # the lowest index of each part's nearest
        codes[at : at + run], errors[at : at + run] = entry[chosen], least
    return codes, errors


def matrix(column: pa.Array, dim: int, parts: int, scale: int) -> np.ndarray:
    """The integers of lists that all have ``dim`` components."""
    return integers(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim), dim // parts, scale)


def moved(codebooks: Codebooks, sums: dict[tuple[int, int], tuple[list[int], int]]) -> Codebooks:
    """The codebooks with each used entry replaced by the floor of its parts' mean."""
    out = [entries.copy() for entries in codebooks]
    for (part, entry), (total, n) in sums.items():
        out[part][entry] = [t // n for t in total]
    return out


def train(vectors: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks fitted to all of ``(vec_id, embedding)``, whose vectors have ``dim`` components."""
    width = dim // parts
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).toArrow()
    start = matrix(first.column("embedding").combine_chunks(), dim, parts, scale)
    codebooks = [start[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    names = [f"s{d}" for d in range(width)]
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], books: Codebooks = codebooks) -> Iterator[pa.RecordBatch]:
            size = len(books[0])
            sums, counts = np.zeros((parts, size, width), np.int64), np.zeros((parts, size), np.int64)
            for batch in batches:
                x = matrix(batch.column(0), dim, parts, scale)
                for p in range(parts):
                    own = x[:, p * width : (p + 1) * width]
                    codes, _ = nearest(own, books[p])
                    np.add.at(sums[p], codes, own)
                    counts[p] += np.bincount(codes, minlength=size)
            part, entry = np.nonzero(counts)
            columns = [pa.array(part), pa.array(entry), pa.array(counts[part, entry])]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(sums[part, entry, d]) for d in range(width)], ["part", "entry", "n", *names])

        found = vectors.select("embedding").mapInArrow(run, "part bigint, entry bigint, n bigint, " + ", ".join(f"{n} bigint" for n in names))
        rows = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(n).alias(n) for n in names)).collect()
        codebooks = moved(codebooks, {(r["part"], r["entry"]): ([r[n] for n in names], r["n"]) for r in rows})
    return codebooks


def digest(codebooks: Codebooks) -> str:
    """SHA-256 of all components in order of part, entry and place."""
    return hashlib.sha256(",".join(str(v) for entries in codebooks for v in entries.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, codebooks: Codebooks, scale: int = SCALE) -> DataFrame:
    """Adds ``code`` and ``error`` to ``(vec_id, label, embedding)``; null where the length does not fit."""
    parts, width = len(codebooks), codebooks[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = np.flatnonzero(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False) == parts * width)
            x = matrix(batch.column(2).take(pa.array(fits)), parts * width, parts, scale)
            found = [nearest(x[:, p * width : (p + 1) * width], codebooks[p]) for p in range(parts)]
            code, error = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
            code[fits] = ["".join(f"{c:02x}" for c in row) for row in zip(*(c.tolist() for c, _ in found), strict=True)]
            error[fits] = sum(e for _, e in found).tolist() if len(fits) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    kind = dict(vectors.dtypes)["label"]
    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id bigint, label {kind}, code string, error bigint")


def vector_codes(
    df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` of every row with a sound vector."""
    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).alias("label"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = rows.filter(F.col("embedding").isNotNull() & sound)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select(F.size("embedding")).first()
    dim = first[0] if first else 0
    if dim < parts or dim % parts:
        nothing = F.lit(None).cast("bigint")
        return kept.select("vec_id", F.lit(None).cast("string").alias("code"), nothing.alias("error"), nothing.alias("label_error"), F.lit(digest([])).alias("codebooks_sha256"))
    codebooks = train(kept.filter(F.size("embedding") == dim).select("vec_id", "embedding"), dim, parts, entries, rounds, scale)
    coded = written(encode(kept, codebooks, scale), "vector-codes")
    sums = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    labelled = coded.alias("v").join(sums.alias("s"), F.col("v.label").eqNullSafe(F.col("s.label")), "left")
    return labelled.select("v.vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
