"""Resharding by minimum-cost flow.

From the bytes that old shards hold and the capacities that new shards shall have, a minimum-cost flow
says how many bytes go from which old shard to which new one; keeping bytes where they are costs
nothing, moving a byte costs one. The flow is then carried out in blocks: each old shard is cut by a
hash of its rows into a fixed number of blocks, laid out as a line, and consecutive stretches of the
line go to the shards that the flow names. Only rows of blocks at the edge of a stretch are told apart
row by row. Rows too large to fill a capacity evenly are placed first, one by one.

What the driver sees is bounded by parameters, not by rows: one size a block (``old shards x blocks``)
and the large rows, of which there are at most ``new shards / large_share``. Slots come from per-block
counts and a row number inside a block, so no shard is numbered in one task.

The layout is then carried out: shards that gain or lose rows are written whole, with their texts, by a row
number that each row got in the old files; files of other shards are left as they are.

Edge cases: a null text has no bytes and so size 1; a null id is hashed like any value; rows that are
equal in id and text are interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import new_dir, written

BLOCKS, BLOCK_BYTES = 256, 1 << 30
LARGE_SHARE = 1 / 1000


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus one; 1 for null."""
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("bigint") + F.lit(1).cast("bigint")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Amounts from each old to each new shard that ship all supply at the least cost (successive shortest paths)."""
    n, m = len(supply), len(capacity)
    left, room = list(supply), list(capacity)
    flow = [[0] * m for _ in range(n)]
    lift = [0] * (n + m)
    while any(left):
        dist: dict[int, int] = {i: 0 for i in range(n) if left[i]}
        came: dict[int, int] = {}
        heap = [(0, i) for i in dist]
        done: set[int] = set()
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            ways = ((n + j, cost[u][j]) for j in range(m)) if u < n else ((i, -cost[i][u - n]) for i in range(n) if flow[i][u - n])
            for v, c in ways:
                step = d + c + lift[u] - lift[v]
                if step < dist.get(v, step + 1):
                    dist[v], came[v] = step, u
                    heapq.heappush(heap, (step, v))
        ends = [(dist[n + j] + lift[n + j], j) for j in range(m) if room[j] and n + j in dist]
        if not ends:
            raise ValueError("capacities are smaller than the supply")
        end = min(ends)[1]
        top = max(dist.values())
        for v in range(n + m):
            lift[v] += dist.get(v, top)
        path, v = [], n + end
        while v in came:
            path.append((came[v], v))
            v = came[v]
        amount = min([left[v], room[end], *(flow[b][a - n] for a, b in path if a >= n)])
        left[v] -= amount
        room[end] -= amount
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
    return flow


def place_large(large: list[tuple], loads: list[int], target: list[int]) -> list[int]:
    """Shards for large rows ``(old, size)``, largest first: the old shard if it has room, else the emptiest."""
    chosen = [0] * len(large)
    for k in sorted(range(len(large)), key=lambda k: (-large[k][1], k)):
        old, size = large[k]
        stays = old < len(loads) and loads[old] + size <= target[old]
        shard = old if stays else min(range(len(loads)), key=lambda j: (loads[j] - target[j], j))
        loads[shard] += size
        chosen[k] = shard
    return chosen


def room_left(loads: list[int], target: list[int], need: int) -> list[int]:
    """Capacities for ``need`` more bytes: up to a common level, whole bytes."""
    order = sorted(range(len(loads)), key=lambda j: (target[j] - loads[j], j))
    gaps = [target[j] - loads[j] for j in order]
    for k in range(len(order)):
        free, rest = order[k:], need - sum(gaps[k:])
        share = [gaps[k + i] + rest // len(free) + (i < rest % len(free)) for i in range(len(free))]
        if min(share) >= 0:
            room = [0] * len(loads)
            for j, s in zip(free, share, strict=True):
                room[j] = s
            return room
    return [0] * len(loads)


def reshard(df: DataFrame, old: str, size: str, key: list[str], shards: int, capacities: list[int] | None = None, blocks: int | None = None, large_share: float = LARGE_SHARE) -> DataFrame:
    """Adds ``shard`` (near ``capacities`` bytes each, fewest bytes moved) and ``slot`` (gapless from 0 in a shard).

    ``old`` names the column with the old shard number, ``key`` the columns that order rows.
    """
    spark = df.sparkSession
    total, most = df.groupBy(old).agg(F.sum(size).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    # a block is one window partition: more of them where an old shard is large
    block = F.pmod(F.xxhash64(*key), F.lit(blocks or max(BLOCKS, -(-most // BLOCK_BYTES)))).cast("int")
    limit = max(2, int(total / shards * large_share))
    line = Window.partitionBy("_old", "_block").orderBy(*[F.col(k).asc_nulls_first() for k in key])
    laid = written(
        df.withColumns({"_old": F.col(old).cast("int"), "_block": F.when(F.col(size) > limit, -1).otherwise(block)})
        .withColumns({"_end": F.sum(size).over(line.rowsBetween(Window.unboundedPreceding, 0)), "_row": F.row_number().over(line).cast("bigint")}),
        "shard-line",
    )
    sizes = laid.filter("_block >= 0").groupBy("_old", "_block").agg(F.sum(size).alias("bytes")).collect()
    large = sorted(laid.filter("_block < 0").select("_old", F.col(size).alias("bytes"), "_row").collect())
    target = capacities or equal_capacities(total, shards)
    loads = [0] * shards
    chosen = place_large([(r["_old"], r["bytes"]) for r in large], loads, target)
    n_old = 1 + max([r["_old"] for r in sizes], default=0)
    lines: dict[int, list] = defaultdict(list)
    for r in sorted(sizes):
        lines[r["_old"]].append((r["_block"], r["bytes"]))
    supply = [sum(b for _, b in lines[i]) for i in range(n_old)]
    room = room_left(loads, target, sum(supply))
    flow = min_cost_flow(supply, room, [[int(i != j) for j in range(shards)] for i in range(n_old)])

    pieces = [(r["_old"], -1, r["_row"], r["_row"] + 1, s) for r, s in zip(large, chosen, strict=True)]
    for i in range(n_old):
        turns = iter([(j, flow[i][j]) for j in sorted(range(shards), key=lambda j: (j != i, j)) if flow[i][j]])
        shard, rest = next(turns, (0, 0))
        for b, n_bytes in lines[i]:
            at = 0
            while at < n_bytes:
                step = min(rest, n_bytes - at)
                if step:
                    pieces.append((i, b, at, at + step, shard))
                at, rest = at + step, rest - step
                if not rest:
                    shard, rest = next(turns, (shard, n_bytes))
    # the pieces are bounded by blocks, shards and large rows, and so are the counts below
    plan = spark.createDataFrame(pieces or [(0, 0, 0, 0, 0)], "p_old int, p_block int, p_from bigint, p_to bigint, shard int")
    start = F.when(F.col("_block") < 0, F.col("_row")).otherwise(F.col("_end") - F.col(size))
    placed = laid.join(
        F.broadcast(plan),
        (F.col("_old") == F.col("p_old")) & (F.col("_block") == F.col("p_block")) & (start >= F.col("p_from")) & (start < F.col("p_to")),
    )
    runs = sorted(placed.groupBy("shard", "p_old", "p_block", "p_from").agg(F.count("*").alias("n"), F.min("_row").alias("first")).collect())
    filled: dict[int, int] = defaultdict(int)
    bases = []
    for r in runs:
        bases.append((r["shard"], r["p_old"], r["p_block"], r["p_from"], filled[r["shard"]] - r["first"]))
        filled[r["shard"]] += r["n"]
    base = spark.createDataFrame(bases or [(0, 0, 0, 0, 0)], "shard int, p_old int, p_block int, p_from bigint, base bigint")
    return (
        placed.join(F.broadcast(base), ["shard", "p_old", "p_block", "p_from"])
        .withColumn("slot", F.col("_row") + F.col("base"))
        .drop("p_old", "p_block", "p_from", "p_to", "base", "_old", "_block", "_end", "_row")
    )


def rewrite(docs: DataFrame, assignment: DataFrame, key: list[str], old: str, path: str | None = None) -> str:
    """Writes the rows that change shard, one folder a new shard, and returns the path; other files stay as they are.

    The rows of ``docs`` with one key are dealt one by one to those of ``assignment`` with that key, nulls included.
    """
    path = path or new_dir(docs.sparkSession, "reshard")
    copy = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1)))
    plan = assignment.withColumn("_copy", copy).filter(F.col(old) != F.col("shard")).select(*[F.col(k).alias(f"_{k}") for k in key], F.col("_copy").alias("_nth"), "shard")
    same = F.col("_copy") == F.col("_nth")
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    docs.withColumn("_copy", copy).join(plan, same).drop("_copy", "_nth", *[f"_{k}" for k in key]).write.partitionBy("shard").parquet(path)
    return path


def write_layout(docs: DataFrame, old: str, path: str | None = None) -> DataFrame:
    """The rows written in one folder an old shard and read again, each with a ``row_id`` of its own."""
    path = path or new_dir(docs.sparkSession, "old-shards")
    numbered = docs.withColumn("row_id", F.monotonically_increasing_id())
    numbered.write.option("compression", "zstd").partitionBy(old).parquet(path)
    return docs.sparkSession.read.schema(numbered.schema).parquet(path)


def rewrite_shards(layout: DataFrame, plan: DataFrame, old: str, path: str | None = None) -> DataFrame:
    """The new layout: the rows of ``write_layout`` with the ``shard`` and ``slot`` that ``reshard`` gives each ``row_id``.

    Shards that gain or lose rows are written whole, one folder a shard under ``path``, which takes the place of
    their old files. All rows of other shards are read from the old files, which stay as they are.
    """
    spark = layout.sparkSession
    path = path or new_dir(spark, "new-shards")
    plan = written(plan.select("row_id", F.col(old).alias("_from"), "shard", "slot"), "shard-plan")
    moves = plan.filter("_from <> shard").select("_from", "shard").distinct().collect()
    affected = sorted({k for r in moves for k in r})
    plan = plan.drop("_from")
    rows = layout.join(plan.filter(F.col("shard").isin(affected)), "row_id")
    rows.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    left = layout.filter(~F.col(old).isin(affected)).join(plan.filter(~F.col("shard").isin(affected)), "row_id")
    return spark.read.schema(rows.schema).parquet(path).unionByName(left)
