"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where that is unset and all runs on one machine (tests) one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        _at_end(spark, found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
        _at_end(spark, spark.sparkContext.getCheckpointDir())
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` now and keep it in the shared folder till the program ends, so lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A path for a new folder in the shared one, which is removed when the program ends."""
    path = f"{shared_dir(spark)}/gridloom-{name}-{uuid.uuid4().hex}"
    _at_end(spark, path)
    return path


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to a new folder of the shared one and read again, and that folder."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, with whatever file system it is on."""
    _delete(spark._jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration())


def _delete(folder, conf) -> None:  # noqa: ANN001
    folder.getFileSystem(conf).delete(folder, True)


def _at_end(spark: SparkSession, path: str) -> None:
    folder, conf = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration()

    def run() -> None:
        with suppress(Py4JError, OSError):  # the JVM may have gone before
            _delete(folder, conf)

    atexit.register(run)


def short_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Texts may be long, so Python workers are to get them in batches of at most ``rows`` rows, and no further row once ``size`` bytes are reached.

    Spark reads these bounds as a plan starts to run, so they are set for the session; a byte bound or fewer rows that a user has set stay.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, spark.conf.get(key, str(size)))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; texts of ASCII alone take the quick way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def filled(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
