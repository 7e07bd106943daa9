"""Grids from tables: rows are counted into cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.grid import Grid, States, skeleton


def rasterised(rows: DataFrame, x: Column | str, y: Column | str, width: int, height: int, states: States) -> Grid:
    """The number of rows of each cell, modulo the number of states; keys are taken modulo the grid's size.

    Rows with a null key fall on no cell. The table is aggregated before it meets the grid, so what is shuffled is at most a row a cell and task.
    """
    key = lambda k, n: F.pmod((F.col(k) if isinstance(k, str) else k).cast("long"), F.lit(n)).cast("int")
    counts = rows.select(key(x, width).alias("x"), key(y, height).alias("y")).where("x is not null and y is not null").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    cells = skeleton(rows.sparkSession, width, height).join(counts, ["x", "y"], "left")
    return Grid(cells.select("x", "y", (F.coalesce("n", F.lit(0)) % len(states.ordinals)).cast("int").alias("s")), width, height, states)


BAND = 4096


def read_cells(spark: SparkSession, path: str, width: int, height: int, states: States) -> Grid:
    """Cells written by ``write_cells``, or by others as x, y, s."""
    return Grid(spark.read.schema("x int, y int, s int").parquet(path).select("x", "y", "s"), width, height, states)


def read_rows(spark: SparkSession, path: str, first: int, last: int, rows_per_band: int = BAND) -> DataFrame:
    """The cells of rows ``first`` to ``last`` of a grid written by ``write_cells``; other bands are not read."""
    bands = F.col("band").between(first // rows_per_band, last // rows_per_band)
    return spark.read.schema("x int, y int, s int, band int").parquet(path).where(bands & F.col("y").between(first, last)).select("x", "y", "s")


def write_cells(grid: Grid, path: str, rows_per_band: int = BAND) -> None:
    """Cells as Parquet in bands of rows."""
    banded = grid.cells.withColumn("band", F.expr(f"int(y div {rows_per_band})"))
    banded.repartition("band").sortWithinPartitions("y", "x").write.partitionBy("band").mode("errorifexists").parquet(path)
