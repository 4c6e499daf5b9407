"""Embedding near-duplicates by int8 tile products with exact error bounds.

Equal vectors are first made one, with their number. Each distinct vector is scaled to unit length and
quantised to int8; the length of what the quantisation took away is computed exactly for that vector. For
unit vectors x, y with quantised x', y' and errors e, f: ``|x.y - x'.y'| <= e + (1 + e) f``. Vectors are
dealt by hash into tiles and every pair of tiles is one task: an int8 product (exact in float32) gives the
estimate, pairs that the bound cannot decide are recomputed in double precision from the original values,
and nothing else is. A task returns, for each vector that has links in it, the number of linked vectors and
its root in a spanning forest: at most one row a vector, however dense the links.

The comparison is of all pairs, so its work is quadratic in the number of distinct vectors; tile pairs are
independent, of bounded size, and evenly dealt.

Edge cases: vectors that are null, empty, zero or hold null or non-finite values, and rows with a null id, link
with nothing: no links, themselves as component. Vectors of different lengths are not compared. Repeated
rows count as linked vectors; different vectors under one id share that id's count and component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written
from plumbline.llm.components import connected_components, forest

THRESHOLD = 0.9
TILE = 4096
RUN = 512
SLACK = 1e-5  # for rounding in the products themselves


def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and exact error lengths of the rows' unit vectors."""
    peak = np.abs(values).max(axis=1, keepdims=True)
    unit = values / peak
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - codes * scale[:, None], axis=1)
    return codes, scale, error


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; rows are first scaled by a power of two, which rounds nothing, so that squares neither overflow nor vanish."""
    x, y = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1]) for v in (x, y))
    return np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def quantised(distinct: DataFrame, tiles: int) -> DataFrame:
    """Adds codes, scale, error and tile to ``(embedding, node, weight)``; values and codes as bytes."""
    double = dict(distinct.dtypes)["embedding"] == "array<double>"
    kind = np.float64 if double else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
            flat, at = column.flatten().to_numpy(zero_copy_only=False).astype(kind), np.r_[0, np.cumsum(lengths)]
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                values = flat[at[rows][:, None] + np.arange(n)]
                codes, scale, error = quantise(values.astype(np.float64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).take(pa.array(rows)), batch.column(2).take(pa.array(rows)), pa.array(np.full(len(rows), n, np.int32)),
                        pa.array([v.tobytes() for v in values], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()),
                        pa.array(scale), pa.array(error),
                    ],
                    ["node", "weight", "dim", "vec", "codes", "scale", "error"],
                )

    out = distinct.select("embedding", "node", "weight").mapInArrow(
        run, "node bigint, weight bigint, dim int, vec binary, codes binary, scale double, error double"
    )
    return out.withColumn("tile", F.pmod(F.xxhash64("vec"), F.lit(tiles)).cast("int"))


def tile_links(a: dict, b: dict, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of ``a`` and ``b`` with a cosine of at least the threshold; ``same``: each pair once."""
    kind = np.float32 if a["codes"].shape[1] * 127 * 127 < 1 << 24 else np.float64
    right = b["codes"].astype(kind).T
    widest = b["error"].max()
    for i in range(0, len(a["codes"]), RUN):
        part = slice(i, i + RUN)
        estimate = a["codes"][part].astype(kind) @ right
        estimate *= a["scale"][part, None].astype(kind)
        estimate *= b["scale"][None, :].astype(kind)
        reach = a["error"][part] + (1 + a["error"][part]) * widest + SLACK
        x, y = np.nonzero(estimate >= (threshold - reach)[:, None].astype(kind) - kind(SLACK))
        guess = estimate[x, y].astype(np.float64)
        x = x + i
        if same:
            x, y, guess = x[x < y], y[x < y], guess[x < y]
        bound = a["error"][x] + (1 + a["error"][x]) * b["error"][y] + SLACK
        linked = guess - bound >= threshold
        unsure = np.flatnonzero(~linked & (guess + bound >= threshold))
        for k in range(0, len(unsure), 1 << 16):
            u = unsure[k : k + (1 << 16)]
            linked[u] = cosine(a["vec"][x[u]].astype(np.float64), b["vec"][y[u]].astype(np.float64)) >= threshold
        yield x[linked], y[linked]


def vector_links(distinct: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``(node, links, root)``: partial link counts and spanning links of distinct vectors ``(embedding, node, weight)``."""
    tiles = max(1, -(-distinct.count() // tile))
    double = dict(distinct.dtypes)["embedding"] == "array<double>"
    kind = np.float64 if double else np.float32
    rows = quantised(distinct, tiles)
    pairs = rows.withColumn("mate", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).select(
        "*", F.least("tile", "mate").alias("i"), F.greatest("tile", "mate").alias("j")
    )

    def side(table: pa.Table) -> dict:
        get = lambda name: table.column(name).to_numpy()
        dim = table.column("dim")[0].as_py()
        unpack = lambda name, t: np.frombuffer(b"".join(table.column(name).to_pylist()), t).reshape(-1, dim)
        return {k: get(k) for k in ("node", "weight", "scale", "error")} | {"vec": unpack("vec", kind), "codes": unpack("codes", np.int8)}

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        a = side(table.filter(pc.equal(table.column("tile"), i)))  if pc.any(pc.equal(table.column("tile"), i)).as_py() else None
        b = a if i == j else side(table.filter(pc.equal(table.column("tile"), j))) if pc.any(pc.equal(table.column("tile"), j)).as_py() else None
        if a is None or b is None:
            return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        shift = 0 if i == j else len(a["node"])
        node = a["node"] if i == j else np.r_[a["node"], b["node"]]
        links, label = np.zeros(len(node), np.int64), np.arange(len(node))
        for x, y in tile_links(a, b, i == j, threshold):
            links += np.bincount(x, b["weight"][y], len(node)).astype(np.int64)
            links += np.bincount(y + shift, a["weight"][x], len(node)).astype(np.int64)
            label = forest(len(node), x, y + shift, label)
        some = np.flatnonzero(links)
        return pa.table({"node": node[some], "links": links[some], "root": node[label[some]]})

    return pairs.groupBy("dim", "i", "j").applyInArrow(run, "node bigint, links bigint, root bigint")


def near_vectors(df: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", tile: int = TILE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row."""
    values = F.col("embedding")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = F.col("vec_id").isNotNull() & values.isNotNull() & finite & F.exists(values, lambda x: x != 0)
    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("embedding"))
    rows = rows.withColumn("embedding", F.when(sound, values))
    distinct = written(
        rows.filter("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")),
        "distinct-vectors",
    )
    found = written(vector_links(distinct, threshold, tile), "vector-links")
    components = connected_components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = (
        distinct.join(links, "node", "left").join(components, "node", "left")
        .select("embedding", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("c"))
    )
    joined = rows.join(written(known, "known-vectors"), "embedding", "left")
    component = F.coalesce("c", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
