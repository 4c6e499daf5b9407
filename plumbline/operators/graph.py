"""Task graphs: readiness, levels, descendants, validity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.places import new_dir


def ready_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Pending nodes all of whose dependencies are completed, or optional and failed or skipped."""
    states = nodes.select(F.col("id").alias("dep"), "state", "optional")
    done = (F.col("state") == "completed") | (F.col("optional") & F.col("state").isin("failed", "skipped"))
    met = edges.join(states, "dep", "left").groupBy("id").agg(F.bool_and(F.coalesce(done, F.lit(False))).alias("met"))
    return nodes.filter("state = 'pending'").join(met, "id", "left").filter(F.coalesce("met", F.lit(True))).select("id")


def _checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a walk: the rows written in the shared folder and read again.

    A checkpoint would keep the estimated size of its plan, which squares with every join of a walk with itself: after twenty rounds a number of millions of digits.
    """
    spark = df.sparkSession
    path = new_dir(spark, "walk")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _jumps(edges: DataFrame) -> DataFrame:
    """``(id, up, dist)`` of nodes with one dependency: the first node behind them that has none or several, and how far it is.

    Pointers double, so a chain of any length takes rounds by its logarithm. Nodes that only lead into a circle end up pointing to one of themselves.
    """
    one = edges.groupBy("id").agg(F.count("*").alias("n"), F.min("dep").alias("up")).filter("n = 1").select("id", "up", F.lit(1).cast("bigint").alias("dist"))
    jumps = _checkpointed(one)
    for _ in range(max(1, jumps.count()).bit_length() + 1):
        on = jumps.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("dist").alias("more"))
        moved = _checkpointed(jumps.join(on, "up", "left").select("id", F.coalesce("next", "up").alias("up"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.col("next").isNotNull().alias("moved")))
        jumps = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            break
    return jumps


def _contracted(edges: DataFrame, jumps: DataFrame) -> DataFrame:
    """``(id, to, dist)``: the edges of nodes with several dependencies, each led through nodes that have one."""
    several = edges.join(jumps.select("id"), "id", "left_anti")
    behind = jumps.select(F.col("id").alias("dep"), "up", F.col("dist").alias("more"))
    return _checkpointed(several.join(behind, "dep", "left").select("id", F.coalesce("up", "dep").alias("to"), (F.coalesce("more", F.lit(0)) + 1).alias("dist")))


def _placed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(id, level)`` of nodes by rounds that place nodes all of whose dependencies are placed, and the nodes left over: on or behind a cycle.

    Chains are contracted first, so the rounds are those of the nodes with several dependencies that stand behind one another.
    """
    ids = _checkpointed(nodes.select("id").distinct())
    known = _checkpointed(edges.select("id", "dep").distinct().join(ids.select(F.col("id").alias("dep")), "dep", "left_semi").join(ids, "id", "left_semi"))
    jumps = _jumps(known)
    open_edges = _contracted(known, jumps)
    placed = _checkpointed(ids.join(known.select("id"), "id", "left_anti").select("id", F.lit(0).cast("bigint").alias("level")))
    while True:
        at = placed.select(F.col("id").alias("to"), "level")
        met = open_edges.join(at, "to", "left").groupBy("id").agg(F.bool_and(F.col("level").isNotNull()).alias("all"), F.max(F.col("level") + F.col("dist")).alias("level"))
        front = _checkpointed(met.filter("all").select("id", "level"))
        if front.isEmpty():
            break
        placed = placed.unionByName(front)
        open_edges = _checkpointed(open_edges.join(front, "id", "left_anti"))
    led = jumps.join(placed.select(F.col("id").alias("up"), "level"), "up").select("id", (F.col("level") + F.col("dist")).alias("level"))
    placed = _checkpointed(placed.unionByName(led).select("id", F.col("level").cast("int").alias("level")))
    return placed, ids.join(placed, "id", "left_anti")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, level)`` by longest chain of known dependencies; nodes on or behind a cycle have none."""
    return _placed(nodes, edges)[0]


def descendants(edges: DataFrame, root: str) -> DataFrame:
    """All nodes that depend on ``root``, itself included, however far; a node with one dependency is reached when that is."""
    others = _checkpointed(edges.select("id", "dep").distinct().filter(F.col("id") != root))
    jumps = _jumps(others)
    steps = _contracted(others, jumps).select("id", "to").distinct()
    found = front = _checkpointed(edges.sparkSession.createDataFrame([(root,)], "id string"))
    while True:
        reached = steps.join(front.withColumnRenamed("id", "to"), "to").select("id").distinct()
        front = _checkpointed(reached.join(found, "id", "left_anti"))
        if front.isEmpty():
            break
        found = _checkpointed(found.union(front))
    led = jumps.join(found.select(F.col("id").alias("up")), "up").select("id")
    return _checkpointed(found.union(led).distinct())


def issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, issue)``: duplicate ids, unknown dependencies, nodes on or behind a cycle."""
    duplicate = nodes.groupBy("id").count().filter("count > 1").select("id", F.lit("duplicate_id").alias("issue"))
    unknown = edges.join(nodes.select(F.col("id").alias("dep")), "dep", "left_anti").select("id", F.lit("unknown_dependency").alias("issue"))
    cycle = _placed(nodes, edges)[1].select("id", F.lit("cycle").alias("issue"))
    return duplicate.union(unknown).union(cycle).distinct()
