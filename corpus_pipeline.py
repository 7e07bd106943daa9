"""The corpus pipeline: quality, exact copies, near copies, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs``, and returns a DataFrame that is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of documents, whatever others there are and whatever
their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import bpe, decontaminate, exact_dedup, jaccard, quality
from gridloom.llm.common import remove, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go, each row by its own content; without labelled documents of both kinds none goes."""
    return quality.drop_unfit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays, null ids being smallest; null texts are empty, and of rows that repeat id and text one stays."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, of a Jaccard similarity of 0.8 or more over five words, the one with the smallest id stays, null ids being largest.

    SimHash fingerprints, compared bit-sliced, find the candidates; sets of shingles decide. Texts that share an id stay or go each by itself.
    """
    return jaccard.drop_near_copies(docs)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold benchmark passages go; null and empty texts, and those that share an id with one that goes, stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as doc_id and token_ids, with the counts and digests of the round trip; null and empty texts have no tokens."""
    return bpe.encoded_and_checked(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", leak_stage),
    ("byte-level BPE", token_stage),
]

#: The classifier is fitted and the tokens come from a rank file, which SQL cannot say; tests compare every stage with a version of its own.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on documents; each stage's table is removed when the next one's is written."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (_, stage) in enumerate(STAGES):
        before = path
        docs, path = written(stage(spark, docs, sf_dir), f"stage{number}")
        if before:
            remove(spark, before)
    return docs
