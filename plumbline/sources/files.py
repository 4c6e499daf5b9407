"""File sources and sinks: JSON manifests, content-addressed assets, portable archives, an append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from plumbline.operators.sanitise import sanitised_rows
from plumbline.sources.keyed_store import listed

CASES = "struct<id:string,modality:string,assetRef:string,category:string,language:string,tags:array<string>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a case of JSON files ``{"cases": [...]}``; a file without cases is an error."""
    rows = spark.read.schema(f"cases array<{CASES}>").option("multiLine", True).json(path)
    cases = F.when(F.col("cases").isNotNull(), F.col("cases")).otherwise(F.raise_error(F.lit("manifest without cases")).cast(f"array<{CASES}>"))
    return rows.select(F.inline(cases))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """``path, digest, bytes`` of files; contents are digested where they lie."""
    return spark.read.format("binaryFile").load(path).select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("path"), F.sha2("content", 256).alias("digest"), F.col("length").alias("bytes")
    )


def export_archive(df: DataFrame, path: str, key: str, payload: str) -> None:
    """Payload rows and a manifest of their digests, as two Parquet folders."""
    df.select(F.col(key).cast("string").alias("path"), F.col(payload).alias("payload")).write.mode("overwrite").parquet(f"{path}/entries")
    spark = df.sparkSession
    entries = spark.read.parquet(f"{path}/entries")
    entries.select("path", F.sha2("payload", 256).alias("digest")).write.mode("overwrite").parquet(f"{path}/manifest")


def verify_archive(spark: SparkSession, path: str) -> DataFrame:
    """``path, status`` of every manifest line and entry: ok, mismatched, missing or unexpected."""
    from plumbline.operators.corpus import verify_assets

    entries = spark.read.parquet(f"{path}/entries").select("path", F.sha2("payload", 256).alias("digest"))
    return verify_assets(spark.read.parquet(f"{path}/manifest"), entries)


def append_log(df: DataFrame, path: str, keep_text: bool = False) -> None:
    """Appends events of any nesting as sanitised audit data; all texts become length and hash unless ``keep_text``."""
    sanitised_rows(df, ("id", "type", "at", "execution", "task"), keep_text).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, execution: str | None = None, task: str | None = None, last: int | None = None) -> DataFrame:
    """Events of the log, of one execution or task if given; ``last``: only the latest so many by ``at`` and ``id``."""
    rows = listed(spark.read.parquet(path), execution=execution, task=task)
    return rows if last is None else rows.orderBy(F.desc("at"), F.desc("id")).limit(last)


def retain_log(spark: SparkSession, path: str, kept: str, per_execution: int = 1000) -> None:
    """Writes to ``kept`` the latest events of every execution, at most ``per_execution`` of each."""
    place = F.row_number().over(Window.partitionBy("execution").orderBy(F.desc("at"), F.desc("id")))
    spark.read.parquet(path).withColumn("_place", place).filter(F.col("_place") <= per_execution).drop("_place").write.mode("overwrite").parquet(kept)


class JsonSearchSource(DataSource):
    """Search results from a list of JSON lines files, one partition a file: ``format("plumbline_search")``. ``limit``: the first so many of each, a page size."""

    @classmethod
    def name(cls) -> str:
        return "plumbline_search"

    def schema(self) -> str:
        return "id string, title string, url string, snippet string"

    def reader(self, schema) -> DataSourceReader:
        return _SearchReader(self.options)


class _SearchReader(DataSourceReader):
    def __init__(self, options):
        self.files = options.get("files", "").split(",")
        self.limit = int(options.get("limit", "10"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.files if f]

    def read(self, partition: InputPartition):
        import json

        with open(partition.value) as lines:
            for k, line in enumerate(lines):
                if k == self.limit:
                    break
                row = json.loads(line)
                yield (row.get("id"), row.get("title"), row.get("url"), row.get("snippet"))
