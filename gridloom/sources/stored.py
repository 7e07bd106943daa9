"""Grids of words kept as Parquet: blocks in the order of a space-filling curve, with a tree of their digests beside them.

A folder holds

* ``blocks``: (code, by, bx, digest, words), ranged and sorted by ``code``, the bits of by and bx interleaved. Blocks that are near each other are
  near each other in the files, so the least and largest by and bx of row groups and pages leave out what a window doesn't need;
* ``tree/level=k``: (node, digest), node being ``code >> 8k``: up to 256 nodes of the level below, whose digests it digests. The last level is one node;
* ``layout``: one row with the edges of the blocks and the states.

Two stored grids are compared from the roots of their trees down, and only blocks whose digests differ are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.planes import unpacked_planes
from gridloom.operators.grid import States
from gridloom.plans.lineage import cut
from gridloom.plans.words import LANES, WordGrid

BLOCKS = "code long, by int, bx int, digest string, words binary"
TREE = "node long, digest string"
LAYOUT = "ys array<int>, xs array<int>, ordinals array<int>"
#: Bits of a code that a level of the tree takes off.
FANOUT = 8
#: Bytes of a row group; some 64 blocks of 1024 x 1024 cells of two states.
ROW_GROUP = 8 << 20


def curve(by: Column, bx: Column, bits: int) -> Column:
    """The lowest ``bits`` bits of two numbers, interleaved."""
    one = F.lit(1).cast("long")
    code = F.lit(0).cast("long")
    for k in range(bits):
        for c, to in ((bx, 2 * k), (by, 2 * k + 1)):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), k).bitwiseAND(one), to))
    return code


def _bits(ys: list[int], xs: list[int]) -> int:
    return max(1, (max(len(ys), len(xs)) - 2).bit_length())


def _levels(ys: list[int], xs: list[int]) -> int:
    """Levels of the tree, that of blocks and that of the root among them."""
    return 1 + -(-2 * _bits(ys, xs) // FANOUT)


def write(grid: WordGrid, path: str) -> None:
    """Keep a grid in a new folder. A folder that is there already is an error; one that broke off has no ``layout`` and can't be read."""
    spark = grid.rows.sparkSession
    coded = grid.rows.select(curve(F.col("by"), F.col("bx"), _bits(grid.ys, grid.xs)).alias("code"), "by", "bx", F.sha2("words", 256).alias("digest"), "words")
    ranged = coded.repartitionByRange(grid.partitions, "code").sortWithinPartitions("code")
    ranged.write.option("parquet.block.size", ROW_GROUP).parquet(f"{path}/blocks")
    nodes = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select(F.col("code").alias("node"), "digest")
    for level in range(_levels(grid.ys, grid.xs)):
        if level:
            below = spark.read.schema(TREE).parquet(f"{path}/tree/level={level - 1}")
            children = F.array_sort(F.collect_list(F.struct("node", "digest")))
            nodes = below.groupBy(F.shiftright("node", FANOUT).alias("up")).agg(F.sha2(F.to_json(children), 256).alias("digest")).select(F.col("up").alias("node"), "digest")
        nodes.sortWithinPartitions("node").write.parquet(f"{path}/tree/level={level}")
    spark.createDataFrame([(grid.ys, grid.xs, list(grid.states.ordinals))], LAYOUT).coalesce(1).write.parquet(f"{path}/layout")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> WordGrid:
    """The whole grid, to run on."""
    ys, xs, ordinals = spark.read.schema(LAYOUT).parquet(f"{path}/layout").first()
    return WordGrid(_blocks(spark, path).select("by", "bx", "words"), ys, xs, States(tuple(ordinals)))


def window(spark: SparkSession, path: str, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """The cells (x, y, s) of x0 <= x < x1 and y0 <= y < y1. Only blocks that meet the window are read; a window that isn't on the grid is an error."""
    grid = read(spark, path)
    if not (0 <= x0 < x1 <= grid.width and 0 <= y0 < y1 <= grid.height):
        raise IndexError(f"the window {x0}, {y0} to {x1}, {y1} is not on a grid of {grid.width} x {grid.height}")
    of = lambda edges, at: int(np.searchsorted(edges, at, "right")) - 1
    met = F.col("by").between(of(grid.ys, y0), of(grid.ys, y1 - 1)) & F.col("bx").between(of(grid.xs, x0), of(grid.xs, x1 - 1))
    cells = grid.with_rows(grid.rows.where(met)).grid().cells
    return cells.where(F.col("x").between(x0, x1 - 1) & F.col("y").between(y0, y1 - 1))


def get_cell(spark: SparkSession, path: str, x: int, y: int) -> DataFrame:
    """The one cell at (x, y), of the one block that holds it."""
    return window(spark, path, x, y, x + 1, y + 1)


def changed_blocks(spark: SparkSession, left: str, right: str) -> DataFrame:
    """(code): the blocks whose digests differ, found from the roots down; below nodes that agree nothing is compared."""
    mine, its = read(spark, left), read(spark, right)
    if (mine.ys, mine.xs, mine.states.ordinals) != (its.ys, its.xs, its.states.ordinals):
        raise ValueError("grids of other sizes, blocks or states can't be compared block by block")
    differ = None
    for level in reversed(range(_levels(mine.ys, mine.xs))):
        sides = [spark.read.schema(TREE).parquet(f"{p}/tree/level={level}") for p in (left, right)]
        if differ is not None:
            up = differ.select(F.col("node").alias("up"))
            sides = [s.join(up, F.shiftright("node", FANOUT) == F.col("up"), "left_semi") for s in sides]
        a, b = sides[0].withColumnRenamed("digest", "mine"), sides[1].withColumnRenamed("digest", "its")
        differ = cut(a.join(b, "node", "full").where(~F.col("mine").eqNullSafe(F.col("its"))).select("node"))
        if differ.isEmpty():
            break
    return differ.select(F.col("node").alias("code"))


def changed_cells(spark: SparkSession, left: str, right: str) -> DataFrame:
    """(x, y, left, right): the cells in which two stored grids of one layout differ."""
    codes = changed_blocks(spark, left, right)
    first, last = codes.agg(F.min("code"), F.max("code")).first()
    near = F.col("code").between(first if first is not None else 0, last if last is not None else -1)  # reaches the files, the exact codes don't
    a, b = [_blocks(spark, p).where(near).join(codes, "code", "left_semi") for p in (left, right)]
    pairs = a.select("code", "by", "bx", F.col("words").alias("mine")).join(b.select("code", F.col("words").alias("its")), "code")
    grid = read(spark, left)
    ys, xs, states, shape = grid.ys, grid.xs, grid.states, grid.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for by, bx, *raws in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                size = shape(by, bx)
                one, two = (unpacked_planes(states, list(np.frombuffer(r, "<u8").reshape(size)), 0, size[2] * LANES) for r in raws)
                y, x = np.nonzero(one != two)
                columns = [x + xs[bx], y + ys[by], one[y, x], two[y, x]]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype("i4")) for c in columns], names=["x", "y", "left", "right"])

    return pairs.select("by", "bx", "mine", "its").mapInArrow(run, "x int, y int, left int, right int")
