"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint has a bit set if more than half of its word shingles' XXH64 hashes have it set.
Two fingerprints link at ``radius`` or fewer differing bits, and all such links are found. Fingerprints
are first made distinct. They are then tiled: of ``radius + 1`` blocks of bits two linked fingerprints
agree in at least one, so each tile holds fingerprints that agree in one block, in order of their
population counts. Inside a tile, numpy compares runs of fingerprints by exclusive-or and bit counts, and
skips runs whose population counts differ by more than the radius, which bounds their distance from below.

A block value that more than ``TILE`` fingerprints share (a large group of near copies) is cut into
tiles by population count, and a count that many share further by hash. Every pair of tiles is a task of its own;
pairs whose population counts differ by more than the radius are left out before anything is shuffled. A task
returns a spanning forest of the links it found, at most one row a fingerprint, so dense groups do not emit all their pairs.

Edge cases: a null or blank text has no shingles and fingerprint zero, and links like any other; a text
of fewer words than a shingle is one shingle; rows with a null id get a fingerprint and the component of
equal fingerprints that have an id, else null; repeated rows share their component; other columns of the
input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written
from plumbline.llm.components import connected_components, forest

SHINGLE, RADIUS = 4, 4
TILE = 4096
RUN = 512


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of UTF-8 bytes, unsigned."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(line, 42)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-shingle] + 1).tolist()]
    counts = np.zeros(64, np.int64)
    total = len(starts)
    stops = ends[shingle - 1 :].tolist()
    for at in range(0, total, 1 << 16):
        part = slice(at, at + (1 << 16))
        hashes = np.array([digest(line[s:e], 42) for s, e in zip(starts[part], stops[part], strict=True)], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` of every row; ``fp`` holds the unsigned value's bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    narrow = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, fp bigint")


def tile_links(fp: np.ndarray, other: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius, for ``fp`` against itself or against ``other``; both sorted by population count."""
    right = fp if other is None else other
    left_counts, right_counts = np.bitwise_count(fp).astype(int), np.bitwise_count(right).astype(int)
    for i in range(0, len(fp), RUN):
        a = fp[i : i + RUN]
        first = i if other is None else int(np.searchsorted(right_counts, left_counts[i] - radius))
        for j in range(first, len(right), RUN):
            if right_counts[j] - left_counts[min(i + RUN, len(fp)) - 1] > radius:
                break
            near = np.bitwise_count(a[:, None] ^ right[None, j : j + RUN]) <= radius
            x, y = np.nonzero(near)
            yield x + i, y + j


def tile_forest(pdf: pd.DataFrame, radius: int, piece: int | None = None) -> pd.DataFrame:
    """Links ``(src, dst)`` that span what is linked inside the tile. ``piece``: compare rows of that piece with the others."""
    fp = pdf["fp"].to_numpy().view(np.uint64)
    order = np.lexsort((np.bitwise_count(fp), pdf["value"].to_numpy()))
    fp, value, node = fp[order], pdf["value"].to_numpy()[order], pdf["node"].to_numpy()[order]
    label = np.arange(len(fp))
    if piece is not None:
        mine = pdf["piece"].to_numpy()[order] == piece
        left, right = np.flatnonzero(mine), np.flatnonzero(~mine)
        for x, y in tile_links(fp[left], fp[right] if len(right) else None, radius):
            label = forest(len(fp), left[x], (right if len(right) else left)[y], label)
    else:
        starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        sizes = np.diff(np.r_[starts, len(value)])
        for s, n in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
            for x, y in tile_links(fp[s : s + n], None, radius):
                label = forest(len(fp), x + s, y + s, label)
        small = np.repeat(sizes <= 64, sizes)
        rows = np.flatnonzero(small)
        f, v = fp[rows], value[rows]
        for d in range(1, 64):
            near = np.flatnonzero((v[d:] == v[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= radius)) if d < len(f) else np.array([], int)
            label = forest(len(fp), rows[near], rows[near + d], label)
    away = label != np.arange(len(fp))
    return pd.DataFrame({"src": node[away], "dst": node[label[away]]})


def banded(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(fp, node, value, ones)``: each fingerprint under its value in each of ``radius + 1`` blocks of bits."""
    cuts = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    values = [
        F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("bigint")) + F.lit(i << 40).cast("bigint")
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))
    ]
    return nodes.select("fp", "node", F.explode(F.array(*values)).alias("value"), F.bit_count("fp").alias("ones"))


def large_tiles(rows: DataFrame) -> DataFrame:
    """``(value, shelves)`` of the values that more than ``TILE`` fingerprints share: how many tiles each population count has."""
    counts = rows.groupBy("value", "ones").agg(F.count("*").alias("n"))
    shelf = F.struct("ones", F.ceil(F.col("n") / TILE).cast("int").alias("cuts"))
    return counts.groupBy("value").agg(F.sum("n").alias("all"), F.collect_list(shelf).alias("shelves")).filter(F.col("all") > TILE).select("value", "shelves")


def large_tile_pairs(rows: DataFrame, radius: int, large: DataFrame | None = None) -> DataFrame:
    """``(fp, node, value, piece, i, j)``: the fingerprints of large values in every pair of tiles within reach of each other."""
    large = large_tiles(rows) if large is None else large
    own = F.filter("shelves", lambda s: s["ones"] == F.col("ones"))[0]["cuts"]
    near = F.filter("shelves", lambda s: F.abs(s["ones"] - F.col("ones")) <= radius)
    tiles = F.flatten(F.transform(near, lambda s: F.transform(F.sequence(F.lit(0), s["cuts"] - 1), lambda k: tile_number(s["ones"], k))))
    piece = tile_number(F.col("ones"), F.pmod(F.xxhash64("fp"), own))
    cut = rows.join(large, "value").select("fp", "node", "value", piece.alias("piece"), F.explode(tiles).alias("mate"))
    return cut.select("fp", "node", "value", "piece", F.least("piece", "mate").alias("i"), F.greatest("piece", "mate").alias("j"))


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links that span the near groups of distinct fingerprints ``(fp, node)``."""
    rows = banded(nodes, radius)
    groups = max(1, -(-nodes.count() * (radius + 1) // 10_000))
    large = written(large_tiles(rows), "large-tiles")  # at most 65 shelves a value
    usual = rows.join(large, "value", "left_anti").withColumn("tile", F.pmod(F.xxhash64("value"), F.lit(groups)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return tile_forest(pdf, radius)

    links = usual.select("tile", "fp", "node", "value").groupBy("tile").applyInPandas(one, "src bigint, dst bigint")
    if large.isEmpty():
        return links

    def two(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return tile_forest(pdf, radius, piece=key[1])

    return links.union(large_tile_pairs(rows, radius, large).groupBy("value", "i", "j").applyInPandas(two, "src bigint, dst bigint"))


def tile_number(ones: Column, cut: Column) -> Column:
    """Numbers a tile by its population count and the part of it."""
    return ones.cast("bigint") * F.lit(1 << 32) + cut.cast("bigint")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row; the component is the smallest id reachable by links."""
    marked = written(fingerprints(df, doc_id, text, shingle), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct-fingerprints")
    found = connected_components(fingerprint_links(nodes.filter("node is not null"), radius))
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marked.join(written(named, "named-fingerprints"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
