"""What several operators share: table reading and shared scratch folders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local session (tests on one machine) gets a temporary folder; on a cluster it is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
        return context._jsc.sc().getCheckpointDir().get()
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(named)
    return named


#: Where the folders made in this context are noted, if someone collects them.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def new_dir(spark: SparkSession, kind: str) -> str:
    """A path under the shared folder that nothing has used yet."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def written_at(df: DataFrame, kind: str) -> tuple[DataFrame, str]:
    """The rows written as Parquet in the shared folder and read again, and the folder; cuts the lineage."""
    spark = df.sparkSession
    path = new_dir(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, kind: str) -> DataFrame:
    return written_at(df, kind)[0]


@contextmanager
def noted_folders() -> Iterator[list[str]]:
    """The folders that are made inside, in order; those of other threads and runs are not among them."""
    made: list[str] = []
    before = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(before)


def remove_folders(spark: SparkSession, paths: list[str]) -> None:
    """Removes folders of whose tables nothing more will be read."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
