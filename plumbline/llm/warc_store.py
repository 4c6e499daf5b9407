"""Content-addressed WARC archive.

A payload is stored once, under the SHA-256 of its bytes; the exact header bytes of every record are
kept apart, one row a record, with the digest of the payload they speak of. Original records are
rebuilt by joining the two tables on the digest. Both are Parquet in a folder that all executors
share. The first payload of a digest group is chosen by a partial aggregation, so a group of copies
that holds a third of all rows leaves each task as one row.

Edge cases: a null payload is the empty payload; a null id is kept (it never wins a group that has
other ids); rows repeated with the same id and payload are all the group's ``response``; line breaks
in a url are percent-encoded in the header, and a null url leaves out the header line; an empty
table gives an archive without records. A blob that does not match its digest stops the read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS_SCHEMA = "header binary, sha256 string"
BLOBS_SCHEMA = "sha256 string, holder bigint, n_bytes bigint, payload binary"


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: four groups of 40 bits."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*groups), DIGITS32, BASE32)


def write_archive(df: DataFrame, path: str, record_id: str, url: str, payload: Column, min_revisit_bytes: int = 0) -> None:
    """Writes ``blobs`` and ``headers`` under ``path``; of equal payloads the one with the largest id is the response."""
    spark = df.sparkSession
    records = df.select(
        F.col(record_id).cast("bigint").alias("record_id"), F.col(url).alias("url"), payload.alias("payload")
    ).withColumn("sha256", F.sha2("payload", 256))
    blobs = records.groupBy("sha256").agg(F.max("record_id").alias("holder"), F.first("payload").alias("payload"))
    blobs.select("sha256", "holder", F.octet_length("payload").cast("bigint").alias("n_bytes"), "payload").write.option(
        "compression", "zstd"
    ).parquet(f"{path}/blobs")

    holders = spark.read.schema(BLOBS_SCHEMA).parquet(f"{path}/blobs").select("sha256", "holder", "n_bytes")
    narrow = records.withColumn("digest", sha1_base32(F.col("payload"))).drop("payload")
    known = narrow.join(holders, "sha256")
    original = (F.col("n_bytes") < min_revisit_bytes) | F.col("record_id").eqNullSafe(F.col("holder"))

    def urn(c: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))

    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(original, F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", urn("record_id")),
        F.lit(f"WARC-Date: {DATE}\r\n"),
        F.coalesce(line("WARC-Target-URI", target), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(original, F.lit("")).otherwise(
            F.concat(line("WARC-Refers-To", urn("holder")), F.lit(f"WARC-Profile: {REVISIT}\r\n"))
        ),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.when(original, F.col("n_bytes")).otherwise(F.lit(0)).cast("string")),
        F.lit("\r\n"),
    )
    known.select(F.encode(header, "UTF-8").alias("header"), "sha256").write.option("compression", "zstd").parquet(f"{path}/headers")


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads; every blob's bytes are digested again and must match the name they are stored under."""
    blobs = spark.read.schema(BLOBS_SCHEMA).parquet(f"{path}/blobs")
    good = (F.sha2("payload", 256) == F.col("sha256")) & (F.octet_length("payload") == F.col("n_bytes"))
    sound = F.when(good, F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("damaged blob "), F.col("sha256"))))
    return blobs.select(
        sound.cast("string").alias("sha256"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        sha1_base32(F.col("payload")).alias("payload_digest"),
        "payload",
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record: header fields parsed from the exact header bytes, joined to its verified payload.

    ``record`` holds the record as it stands in a WARC file (a revisit has an empty block). Columns that a
    query leaves out, such as the payload, are pruned before the join.
    """
    headers = spark.read.schema(HEADERS_SCHEMA).parquet(f"{path}/headers")
    text = F.decode("header", "UTF-8")

    def field(name: str, pattern: str = "([^\r\n]*)") -> Column:
        found = F.regexp_extract(text, f"\r\n{name}: {pattern}\r\n", 1)
        return F.when(found != "", found)

    parsed = headers.select(
        "sha256",
        "header",
        field("WARC-Record-ID", "<urn:page:(-?\\d*)>").cast("bigint").alias("record_id"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Target-URI").alias("target_uri"),
        field("WARC-Payload-Digest", "sha1:([A-Z2-7]*)").alias("header_digest"),
        field("WARC-Refers-To", "<urn:page:(-?\\d*)>").cast("bigint").alias("refers_to"),
    )
    joined = parsed.join(read_blobs(spark, path), "sha256")
    agreed = F.when(
        F.col("header_digest") == F.col("payload_digest"), F.col("payload_digest")
    ).otherwise(F.raise_error(F.lit("header and payload digests differ")).cast("string"))
    end = F.encode(F.lit("\r\n\r\n"), "UTF-8")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8"))
    return joined.withColumns({"payload_digest": agreed, "record": F.concat(F.col("header"), block, end)})


def export_warc(spark: SparkSession, path: str, out: str) -> None:
    """Writes the rebuilt records as text parts, byte for byte, in no order; the line end closes a record's last two."""
    record = F.substring(F.col("record"), F.lit(1), F.octet_length("record") - 1)
    read_records(spark, path).select(record.cast("string").alias("value")).write.option("lineSep", "\n").text(out)
