"""What the jobs share: their command line, their configuration and reading what may not be there yet."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

Settings = dict[str, object]


def log_of(name: str) -> logging.Logger:
    return logging.getLogger(f"jobs.{name}")


def defaults(name: str) -> Settings:
    """The settings that come with a job, from the file beside its module."""
    return json.loads(Path(__file__).with_name(f"{name}.json").read_text())


def settings(spark: SparkSession, name: str, path: str | None = None) -> Settings:
    """The job's defaults, and over them those of a file on any file system; names that the job doesn't have are refused."""
    known = defaults(name)
    if not path:
        return known
    said = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if unknown := set(said) - set(known):
        raise ValueError(f"settings that {name} doesn't have: {', '.join(sorted(unknown))}")
    return known | said


def read_if_there(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A Parquet folder, or no rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def command_line(name: str, about: str, run: Callable[[SparkSession, str, str, Settings], object], argv: list[str] | None = None) -> None:
    """Parse the arguments, make a session, run the job and stop the session."""
    p = argparse.ArgumentParser(prog=f"jobs.{name}", description=about)
    p.add_argument("--input", required=True, help="folder of the tables")
    p.add_argument("--output", required=True, help="folder of the job's output and marks")
    p.add_argument("--config", help="JSON file of settings in place of the defaults")
    args = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, args.input.rstrip("/"), args.output.rstrip("/"), settings(spark, name, args.config))
    finally:
        spark.stop()
