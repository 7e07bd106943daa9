"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Three combining stages, each of which groups by the whole normalised text beside its SHA-256, so equal
digests alone never merge two texts:

1. *local*: every task combines its own equal texts (the partial half of the first aggregation);
2. *salted*: task winners meet in digest groups dealt over ``salts`` salts, the salt being the map task,
   so a text that fills a third of all rows arrives as at most one row a task, in ``salts`` places;
3. *global*: at most ``salts`` winners of a text combine into the class.

The classes then go back to the rows by digest. A digest that stands for two different texts stops the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ascii_lower, filled

SALTS = 8


def normalised(text: Column) -> Column:
    """Null as empty, A-Z in lower case, all else as it is."""
    return ascii_lower(filled(text))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct normalised text: text_sha256, keep_id (largest id), group_size."""
    norm = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), norm.alias("_norm"), (F.spark_partition_id() % salts).alias("_salt"))
    rows = rows.withColumn("_sha", F.sha2("_norm", 256))
    salted = rows.groupBy("_sha", "_norm", "_salt").agg(F.max("_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    merged = salted.groupBy("_sha", "_norm").agg(F.max("_id").alias("_id"), F.sum("_n").alias("_n"))
    single = merged.groupBy("_sha").agg(F.max("_id").alias("keep_id"), F.sum("_n").alias("group_size"), F.count(F.lit(1)).alias("_texts"))
    # The check is part of the key that classes are joined by, so no plan can leave it out.
    sure = F.when(F.col("_texts") == 1, F.col("_sha")).otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("string"))
    return single.select(sure.alias("text_sha256"), "keep_id", "group_size")


def _apart(winners: DataFrame, sha: str) -> DataFrame:
    """The classes with their digest turned round as ``_key``, to be joined by.

    As it isn't what the classes were grouped by, both sides of the join are shuffled for it alone, and so a digest
    that a third of all rows have can be split over tasks as the job runs; the other side has one row for it.
    """
    return winners.withColumn("_key", F.reverse(sha)).drop(sha)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Every row of ``docs`` as (id, keep_id, group_size, kept, text_sha256).

    Null texts count as empty, and empty texts equal each other. Of equal texts the row with the largest id
    stays; null ids sort below all others, and a class of null ids alone has a null ``keep_id``, its rows kept.
    Rows that repeat both id and text are one document given twice: both are reported, both with the
    class's answer, and ``drop_copies`` leaves one. An empty table gives an empty result. Other columns, clashing names
    included, are not looked at.
    """
    members = docs.select(F.col(id_col).alias(id_col), F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"))
    return members.join(_apart(classes(docs, id_col, text_col, salts), "text_sha256"), F.reverse("text_sha256") == F.col("_key")).select(
        id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct text, columns unchanged.

    Nulls, ties and repeats count as in ``exact_dedup``; of rows that repeat both id and text one stays. Rows are matched by id and
    text together, so an id that other texts have too loses nothing by it.
    """
    winners = _apart(classes(docs, id_col, text_col).select(F.col("text_sha256").alias("_sha"), F.col("keep_id").alias("_keep")), "_sha")
    # Whole rows in a structure, so that no column of theirs has the name of one of these.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.sha2(normalised(F.col(f"`{text_col}`")), 256).alias("_sha"))
    kept = rows.join(winners, F.reverse("_sha") == F.col("_key")).where(F.col("_id").eqNullSafe(F.col("_keep")))
    # Where no id is repeated, which the ids alone tell, a text's winner is one row, and whole rows need no further shuffle.
    if not docs.groupBy(id_col).count().where(F.col("count") > 1).isEmpty():
        kept = kept.dropDuplicates(["_sha"])
    return kept.select("_row.*")
