"""Stored grids of words: windows, cells, and comparison by trees of digests, against whole grids."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridloom.automata import AUTOMATA
from gridloom.operators.results import differences
from gridloom.plans import words
from gridloom.plans.run import run
from gridloom.sources import stored
from gridloom.sources.seeded import random_words

LIFE = AUTOMATA["game-of-life"]


@pytest.fixture(scope="module")
def grid(spark):
    return random_words(spark, LIFE, 1088, 1100, seed=5, block=64)


@pytest.fixture(scope="module")
def kept(spark, grid, tmp_path_factory):
    """Paths of the grid, of it with three cells turned in two blocks, and of its copy."""
    paths = [str(tmp_path_factory.mktemp("stored") / n) for n in ("a", "b", "c")]
    turned = (F.col("x") == 1087) & F.col("y").isin(0, 3) | (F.col("x") == 70) & (F.col("y") == 700)
    cells = grid.grid()
    other = cells.with_cells(cells.cells.withColumn("s", F.when(turned, 1 - F.col("s")).otherwise(F.col("s"))))
    for g, p in zip((grid, words.from_grid(other, 64), grid), paths):
        stored.write(g, p)
    return paths


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_round_trip_and_windows(spark, grid, kept):
    back = stored.read(spark, kept[0])
    assert back.checksum().collect() == grid.checksum().collect()
    assert run(back, LIFE.rule, 3).checksum().collect() == run(grid, LIFE.rule, 3).checksum().collect()
    cells = grid.grid().cells.select("x", "y", "s")
    for x0, y0, x1, y1 in ((60, 500, 200, 530), (0, 0, 1, 1), (1087, 1099, 1088, 1100)):
        inside = F.col("x").between(x0, x1 - 1) & F.col("y").between(y0, y1 - 1)
        assert rows(stored.window(spark, kept[0], x0, y0, x1, y1)) == rows(cells.where(inside))
    assert rows(stored.get_cell(spark, kept[0], 700, 3)) == rows(cells.where("x = 700 and y = 3"))
    with pytest.raises(IndexError):
        stored.window(spark, kept[0], 0, 0, 1089, 1)


def test_a_window_reaches_the_files(spark, kept):
    """By what the scan gave out: the row groups that can't hold the window's blocks are left out."""
    df = stored.window(spark, kept[0], 64, 128, 128, 140)
    assert df.count() == 64 * 12 and (df.collect() and True)
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    files = spark.read.parquet(f"{kept[0]}/blocks").groupBy("_metadata.file_path").agg(*[f(c).alias(n + c) for c in ("by", "bx") for n, f in (("l", F.min), ("m", F.max))], F.count("*").alias("n"))
    met = files.where("lby <= 2 and mby >= 2 and lbx <= 1 and mbx >= 1")
    assert 1 <= met.count() < files.count()
    assert scan.metrics().apply("numOutputRows").value() == met.agg(F.sum("n")).first()[0] < 306 // 2


def test_what_differs_is_found_from_the_root(spark, kept):
    a, b, c = kept
    assert stored.changed_blocks(spark, a, b).count() == 2
    found = stored.changed_cells(spark, a, b)
    want = differences(stored.read(spark, a).grid().cells, stored.read(spark, b).grid().cells)
    assert rows(found.select("x", "y", "left", "right")) == rows(want) and found.count() == 3
    assert stored.changed_cells(spark, a, c).count() == 0
    assert spark.read.parquet(f"{a}/tree/level=2").count() == 1


def test_other_layouts_are_refused(spark, kept, tmp_path):
    stored.write(random_words(spark, LIFE, 128, 64, seed=1, block=64), str(tmp_path / "d"))
    with pytest.raises(ValueError, match="other sizes"):
        stored.changed_blocks(spark, kept[0], str(tmp_path / "d"))
