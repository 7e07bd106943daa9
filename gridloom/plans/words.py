"""Grids as blocks of bit planes from the source to the checksum: temporal blocking without a row a cell anywhere.

A grid is rows (by, bx, words), each the planes of one block, 64 cells a word. In a round every block sends its edges to the
blocks around it: ``depth`` rows above and below, a word of columns on both sides; a block with its halo advances ``depth`` generations by
itself and sends its new edges in the same task. Blocks are dealt to partitions by their number, so all partitions hold
equally many whatever the hash, and what a round shuffles is a bit a cell and state bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import rules as R
from gridloom.functions.planes import advance_words, packed_planes, unpacked_planes
from gridloom.operators.grid import TILES, Grid, States, checksum_of
from gridloom.plans.blocks import to_blocks
from gridloom.plans.lineage import cut

LANES = 64
#: Cells on a block's edge, and words on it in x.
EDGE = 1024
#: Generations between exchanges at most; the halo in x is one word.
DEPTH = 64
#: Rounds between lineage cuts.
CUT_EVERY = 8
#: Blocks of a partition at most.
DEALT = 64
BLOCK = "by int, bx int, words binary"
PIECE = "by int, bx int, dy int, dx int, words binary"


def _edges(units: int, most: int) -> list[int]:
    n = -(-units // most)
    return [units * i // n for i in range(n + 1)]


def layout(spark: SparkSession, width: int, height: int, block: int = 0) -> tuple[list[int], list[int]]:
    """Edges of the blocks in y and x: ``block`` cells or as many as suit the grid and the cores, whole words in x."""
    if width % LANES:
        raise ValueError(f"a grid of words has a multiple of {LANES} columns")
    edge = block or EDGE
    while not block and edge > 2 * LANES and -(-width // edge) * -(-height // edge) < 2 * spark.sparkContext.defaultParallelism:
        edge //= 2
    return _edges(height, edge), [LANES * x for x in _edges(width // LANES, max(1, edge // LANES))]


@dataclass(frozen=True)
class WordGrid:
    """Rows (by, bx, words): the planes of each block, one after the other, row by row. ``ys`` and ``xs`` are the blocks' edges."""

    rows: DataFrame
    ys: list[int]
    xs: list[int]
    states: States

    @property
    def width(self) -> int:
        return self.xs[-1]

    @property
    def height(self) -> int:
        return self.ys[-1]

    @property
    def blocks(self) -> int:
        return (len(self.ys) - 1) * (len(self.xs) - 1)

    @property
    def partitions(self) -> int:
        spark = self.rows.sparkSession
        return max(min(self.blocks, 2 * spark.sparkContext.defaultParallelism), -(-self.blocks // DEALT))

    @property
    def shape(self) -> Callable[[int, int], tuple[int, int, int]]:
        """Planes, rows and words of a block, as a function that tasks can take along."""
        bits, ys, xs = self.states.bits, self.ys, self.xs
        return lambda by, bx: (bits, ys[by + 1] - ys[by], (xs[bx + 1] - xs[bx]) // LANES)

    def _each(self, make: Callable, schema: str) -> DataFrame:
        """Rows made of each block's ordinals; ``make`` gets by, bx and the array and gives columns."""
        shape, states, names = self.shape, self.states, [c.split()[0] for c in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for by, bx, raw in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                    size = shape(by, bx)
                    planes = list(np.frombuffer(raw, "<u8").reshape(size))
                    for columns in make(by, bx, unpacked_planes(states, planes, 0, size[2] * LANES)):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        return self.rows.select("by", "bx", "words").mapInArrow(run, schema)

    def grid(self) -> Grid:
        """The cells, a row each."""
        ys, xs = self.ys, self.xs

        def make(by: int, bx: int, cells):  # noqa: ANN001, ANN202
            for a in range(0, len(cells), 64):
                part = cells[a : a + 64]
                x = np.tile(np.arange(xs[bx], xs[bx + 1], dtype="i4"), len(part))
                yield x, np.repeat(np.arange(ys[by] + a, ys[by] + a + len(part), dtype="i4"), xs[bx + 1] - xs[bx]), part.reshape(-1).astype("i4")

        return Grid(self._each(make, "x int, y int, s int"), self.width, self.height, self.states)

    def tile_sums(self) -> DataFrame:
        """As ``Grid.tile_sums``, summed within blocks first."""
        th, tw = -(-self.height // TILES), -(-self.width // TILES)
        ys, xs = self.ys, self.xs

        def make(by: int, bx: int, cells):  # noqa: ANN001, ANN202
            rows, cols = (np.arange(e[i], e[i + 1]) // t for e, i, t in ((ys, by, th), (xs, bx, tw)))
            ends = lambda k: np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            sums = np.add.reduceat(np.add.reduceat(cells, ends(cols), axis=1, dtype="i8"), ends(rows), axis=0)
            tiles = rows[ends(rows)][:, None] * TILES + cols[ends(cols)][None, :]
            yield tiles.reshape(-1).astype("i4"), sums.reshape(-1)

        sums = self._each(make, "tile int, part long").groupBy("tile").agg(F.sum("part").alias("sum"))
        all_tiles = self.rows.sparkSession.range(TILES * TILES).select(F.col("id").cast("int").alias("tile"))
        return all_tiles.join(sums, "tile", "left").select("tile", F.coalesce("sum", F.lit(0)).cast("long").alias("sum"))

    def checksum(self) -> DataFrame:
        return checksum_of(self.tile_sums())

    def histogram(self) -> DataFrame:
        def make(by: int, bx: int, cells):  # noqa: ANN001, ANN202
            s, n = np.unique(cells, return_counts=True)
            yield s.astype("i4"), n

        return self._each(make, "s int, cells long").groupBy("s").agg(F.sum("cells").alias("cells"))

    def write(self, path: str) -> None:
        self.rows.write.parquet(path)

    def with_rows(self, rows: DataFrame) -> WordGrid:
        return WordGrid(rows, self.ys, self.xs, self.states)


def read(spark: SparkSession, path: str, width: int, height: int, states: States, block: int) -> WordGrid:
    """A grid that ``write`` wrote; ``block`` is the edge that its layout was made with."""
    return WordGrid(spark.read.schema(BLOCK).parquet(path), *layout(spark, width, height, block), states)


def generated(spark: SparkSession, width: int, height: int, states: States, fill: Callable, block: int = 0) -> WordGrid:
    """A grid whose blocks the executors make: ``fill(y0, y1, x0, x1)`` gives the ordinals of a block."""
    ys, xs = layout(spark, width, height, block)
    grid = WordGrid(spark.createDataFrame([], BLOCK), ys, xs, states)
    across = len(xs) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column(0).to_pylist():
                by, bx = divmod(n, across)
                planes = packed_planes(states, fill(ys[by], ys[by + 1], xs[bx], xs[bx + 1]))
                yield pa.RecordBatch.from_arrays([pa.array([by], pa.int32()), pa.array([bx], pa.int32()), pa.array([np.stack(planes).tobytes()], pa.binary())], names=["by", "bx", "words"])

    return grid.with_rows(spark.range(0, grid.blocks, 1, grid.partitions).mapInArrow(run, BLOCK))


def from_grid(grid: Grid, block: int = 0) -> WordGrid:
    """The blocks of a table of cells."""
    ys, xs = layout(grid.cells.sparkSession, grid.width, grid.height, block)
    states = grid.states
    dtype = "i1" if max(states.ordinals) < 128 else "i4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for by, bx, raw in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                cells = np.frombuffer(raw, dtype).reshape(ys[by + 1] - ys[by], -1)
                yield pa.RecordBatch.from_arrays([pa.array([by], pa.int32()), pa.array([bx], pa.int32()), pa.array([np.stack(packed_planes(states, cells)).tobytes()], pa.binary())], names=["by", "bx", "words"])

    return WordGrid(to_blocks(grid, ys, xs, dtype).mapInArrow(run, BLOCK), ys, xs, states)


def run(grid: WordGrid, rule: R.Node, steps: int, first: int = 0, depth: int = 0) -> WordGrid:
    """``steps`` generations, ``depth`` of them between exchanges."""
    if not steps:
        return grid
    ys, xs, states, shape, reach = grid.ys, grid.xs, grid.states, grid.shape, R.reach(rule)
    width, height = grid.width, grid.height
    least = min(b - a for a, b in zip(ys, ys[1:]))
    most = min(DEPTH, least) // reach
    if not most:
        raise ValueError(f"the rule reads {reach} cells far, further than {LANES} or a block of {least} rows")

    def advance(by: int, bx: int, whole, t: int, long: int):  # noqa: ANN001, ANN202
        w = whole.shape[2] - 2
        planes = advance_words(rule, states, list(whole), t, long, xs[bx] - LANES, (w + 2) * LANES, ys[by], width, height)
        return np.stack(planes)[:, :, 1:-1]

    sizes = len(ys) - 1, len(xs) - 1, grid.partitions
    return grid.with_rows(in_rounds(grid.rows, sizes, shape, lambda long: (long * reach, 1), advance, lengths_of(steps, min(depth or most, most)), first))


def lengths_of(steps: int, depth: int) -> list[int]:
    """Generations of each round, nearly equally many, and at most ``depth``."""
    rounds = -(-steps // depth)
    return [steps * (k + 1) // rounds - steps * k // rounds for k in range(rounds)]


def in_rounds(rows: DataFrame, sizes: tuple[int, int, int], shape: Callable, halo: Callable[[int], tuple[int, int]], advance: Callable, lengths: list[int], first: int, dtype: str = "<u8") -> DataFrame:
    """Blocks (by, bx, words) after rounds of ``lengths`` generations, one shuffle each.

    ``sizes`` are the blocks in y and in x and the partitions, ``shape`` gives a block's planes, rows and words, ``halo`` the rows and words around a block that a round of so
    many generations needs, and ``advance(by, bx, whole, t, generations)`` makes a block of it and its halo.
    """
    ny, nx, n = sizes
    kinds = [pa.int32()] * 4 + [pa.binary()]

    def pieces(by: int, bx: int, planes, long: int) -> pa.RecordBatch:  # noqa: ANN001
        """The block itself, and the edges that the eight blocks around it need."""
        deep, wide = halo(long)
        down = {-1: slice(0, deep), 0: slice(None), 1: slice(-deep, None)}
        side = {-1: slice(0, wide), 0: slice(None), 1: slice(-wide, None)}
        # What is on this block's dy side is on the -dy side of the block there.
        rows = [((by + dy) % ny, (bx + dx) % nx, -dy, -dx, planes[:, down[dy], side[dx]].tobytes()) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["by", "bx", "dy", "dx", "words"])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for by, bx, raw in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                yield pieces(by, bx, np.frombuffer(raw, dtype).reshape(shape(by, bx)), lengths[0])

    def work(t: int, long: int, onward: int) -> Callable:
        def advanced(by: int, bx: int, part: dict) -> pa.RecordBatch:
            if len(part) != 9:
                raise ValueError(f"block ({by}, {bx}) lacks a neighbour")
            (bits, h, w), (deep, wide) = shape(by, bx), halo(long)
            sized = lambda dy, dx: np.frombuffer(part[dy, dx], dtype).reshape(bits, deep if dy else h, wide if dx else w)
            whole = np.concatenate([np.concatenate([sized(dy, dx) for dx in (-1, 0, 1)], axis=2) for dy in (-1, 0, 1)], axis=1)
            planes = advance(by, bx, whole, t, long)
            if onward:
                return pieces(by, bx, planes, onward)
            return pa.RecordBatch.from_arrays([pa.array([by], pa.int32()), pa.array([bx], pa.int32()), pa.array([planes.tobytes()], pa.binary())], names=["by", "bx", "words"])

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, part = None, {}
            for batch in batches:
                for by, bx, dy, dx, raw in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                    if (by, bx) != now and now:
                        yield advanced(*now, part)
                        part = {}
                    now = (by, bx)
                    if (dy, dx) in part:
                        raise ValueError(f"block {now} is given twice")
                    part[dy, dx] = raw
            if now:
                yield advanced(*now, part)

        return each

    dealt = F.expr(f"int((by * {nx} + bx) * {n}L div {ny * nx})")
    rows, t = rows.mapInArrow(begin, PIECE), first
    for k, long in enumerate(lengths):
        onward = lengths[k + 1] if k + 1 < len(lengths) else 0
        rows = rows.repartitionById(n, dealt).sortWithinPartitions("by", "bx").mapInArrow(work(t, long, onward), PIECE if onward else BLOCK)
        t += long
        if onward and (k + 1) % CUT_EVERY == 0:
            rows = cut(rows)
    return rows
