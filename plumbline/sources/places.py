"""Folders that driver and executors share, and folders that become visible at once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session that names none gets a temporary folder, a cluster an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named is None and context._jsc.sc().getCheckpointDir().isDefined():
        return context._jsc.sc().getCheckpointDir().get()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="plumbline-")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(named)
    return named


def new_dir(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


class Versions:
    """Numbered folders ``<path>/<kind>/v=<n>`` of Parquet files. A folder is written elsewhere and renamed, so that readers see all of it or nothing.

    The rename must be atomic and must fail where the name is taken, as on HDFS and local disks.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.jvm = spark, path.rstrip("/"), spark._jvm

    def _place(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _system(self):
        return self._place("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def all(self, kind: str) -> list[int]:
        """The numbers that are there, in ascending order."""
        place, system = self._place(kind), self._system()
        names = [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []
        return sorted(int(n[2:]) for n in names if n.startswith("v="))

    def folder(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}/v={number}"

    def stage(self, df: DataFrame) -> str:
        """Writes the rows where no reader looks."""
        name = f"staging/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def publish(self, staged: str, kind: str, number: int) -> bool:
        """Makes a staged folder version ``number``; false if another writer has that number."""
        target = self._place(f"{kind}/v={number}")
        self._system().mkdirs(self._place(kind))
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(self.spark._jsc.hadoopConfiguration()).getUri(), self.spark._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs.Options, "Rename"), 0)
        try:
            context.rename(self._place(staged), target, no_options)
        except Exception as error:
            if self._system().exists(target):
                return False
            raise error
        return True

    def append(self, df: DataFrame, kind: str, base: str) -> int:
        """Publishes the rows under the next free number, after all of ``kind`` and of the ``base`` that holds older ones."""
        staged, number = self.stage(df), max([0, *self.all(kind), *self.all(base)]) + 1
        while not self.publish(staged, kind, number):
            number += 1
        return number

    def delete(self, name: str) -> None:
        self._system().delete(self._place(name), True)

    def read(self, kind: str, numbers: list[int]) -> DataFrame:
        """The rows of these versions, with their number as ``v``."""
        return self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*[self.folder(kind, n) for n in numbers])
