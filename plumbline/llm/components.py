"""Connected components of a link table, wholly on executors.

Links are contracted in rounds. In a round every node gets a hash as its priority and points to the best of itself
and its neighbours; links are then drawn between the nodes pointed to. At least about half of the nodes that
still have links are expected to go in every round, whatever their numbers and the component's shape, so the rounds follow
the logarithm of the nodes; they end when no link is left, and no round is dropped. Pointers are put together from the
last round to the first, over tables that shrink in the same way.

Hub nodes are safe: links of one node are reduced by a partial aggregation, and the joins read from
checkpoints on both sides, so that adaptive execution can split a hot key.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import shared_dir


def forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the links ``a[i]-b[i]``, on top of ``label``."""
    label = np.arange(n) if label is None else label
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        low, high = np.minimum(la[apart], lb[apart]), np.maximum(la[apart], lb[apart])
        np.minimum.at(label, high, low)
        while not np.array_equal(label, up := label[label]):
            label = up
    return label


def contraction(links: DataFrame) -> list[DataFrame]:
    """One table ``(node, up)`` a round: where each node that still has links ``(src, dst)`` points."""
    pointers: list[DataFrame] = []
    while not links.isEmpty():
        turn = F.lit(len(pointers))
        best = links.groupBy(F.col("src").alias("node")).agg(F.min(F.struct(F.xxhash64("dst", turn).alias("p"), F.col("dst").alias("up"))).alias("m"))
        own = F.struct(F.xxhash64("node", turn).alias("p"), F.col("node").alias("up"))
        pointers.append(best.select("node", F.least(own, "m")["up"].alias("up")).checkpoint())
        a = pointers[-1].select(F.col("node").alias("src"), F.col("up").alias("a"))
        b = pointers[-1].select(F.col("node").alias("dst"), F.col("up").alias("b"))
        links = links.join(a, "src").join(b, "dst").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct().checkpoint()
    return pointers


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node in ``links(src, dst)``; the component is its smallest node.

    Null ends are ignored, as are links of a node to itself. No links: no rows.
    """
    shared_dir(links.sparkSession)
    real = links.filter("src is not null and dst is not null and src <> dst").select("src", "dst")
    both = real.union(real.select("dst", "src")).distinct().checkpoint()
    pointers = contraction(both)
    if not pointers:
        return both.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    roots = pointers.pop()
    while pointers:
        roots = roots.select(F.col("node").alias("up"), F.col("up").alias("root"))
        roots = pointers.pop().join(roots, "up", "left").select("node", F.coalesce("root", "up").alias("up")).checkpoint()
    smallest = roots.groupBy("up").agg(F.min("node").alias("component")).checkpoint()
    return roots.join(smallest, "up").select("node", "component")
