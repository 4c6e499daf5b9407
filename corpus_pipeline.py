"""The corpus pipeline: from raw documents to token ids in five stages.

Each stage is a function of ``(spark, docs, sf_dir)`` that returns a DataFrame; its result is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns of ``documents``.
Null texts are scored as empty; rows with a null id pass where a decision needs an id; rows that share
an id stay or go together; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontamination, line_templates, quality_fm, sentencepiece_lattice, shingle_pairs
from plumbline.llm.common import noted_folders, remove_folders, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine accepts; it learns from labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality_fm.train(docs, labels.filter(~quality_fm.held_out(F.col("doc_id"))))
    return quality_fm.score(docs.select(*COLUMNS), model).filter(F.col("score") >= quality_fm.THRESHOLD).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that other documents have before them; no document goes."""
    kept = line_templates.drop_recurring_lines(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("bigint")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard of five-word shingles from 0.8): that with the smallest id.

    No radius of a 64-bit SimHash holds all such pairs, so candidates come from the shingles themselves.
    """
    groups = shingle_pairs.near_duplicates(docs.select("doc_id", "text"))
    first = groups.filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(first, "doc_id", "left_semi")
    return named.unionByName(docs.filter("doc_id is null")).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no test item leaks."""
    marked = decontamination.with_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return marked.filter(F.size("leaks") == 0).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text and whether they decode to it."""
    pieces = sentencepiece_lattice.default_pieces(spark)
    return sentencepiece_lattice.encode_and_check(docs.select(*COLUMNS), pieces).select(
        "doc_id", "lang", "source", "n_chars", "ids", F.size("ids").alias("n_ids"), "round_trip"
    )


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding and decoding", tokenize),
]

#: SQL cannot express the classifier, the alignment or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. When a stage is written, what this run's stages before it left in the shared folder is removed."""
    docs = table(spark, sf_dir, "documents")
    with noted_folders() as made:
        for k, (_, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k + 1 < len(STAGES):
                docs = written(docs, f"stage-{k}")
                remove_folders(spark, made[:-1])
                del made[:-1]
    return docs
