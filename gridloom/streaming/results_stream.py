"""Results that are still being written, as a stream: the best time of each automaton and implementation so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.results import SCHEMA, implementation, normalised_ps


def results_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Rows of the results files that appear in a folder."""
    return spark.readStream.schema(SCHEMA).option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(folder)


def running_best(rows: DataFrame) -> DataFrame:
    """Best picoseconds a cell and step, and runs so far, by automaton and implementation; state is one row a pair. For update or complete mode."""
    named = rows.fillna("", ["traverser", "evaluator", "layout", "reference_impl"])
    return named.withColumns({"impl": implementation(), "ps": normalised_ps()}).where("impl is not null").groupBy("automaton", "impl").agg(F.min("ps").alias("best_ps"), F.count(F.lit(1)).alias("runs"))
