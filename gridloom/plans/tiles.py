"""Temporal blocking on tiles: blocks of 8-wide tiles with halos of whole tiles that advance several generations between shuffles.

A word holds a tile of 8 by word/8 cells, so a step in any direction moves lanes within a word and takes the rest from one word beside it, and a block
of tiles is about as high as wide in cells, whose halo is small on all four sides. A round is one shuffle, as with planes of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.functions import rules as R
from gridloom.functions.bitslice import Lanes, Word, full, pattern
from gridloom.functions.planes import Compiler, across
from gridloom.operators.grid import Grid, States
from gridloom.operators.layouts import TILE_X
from gridloom.plans.blocks import from_blocks, to_blocks
from gridloom.plans.planes import near_lanes
from gridloom.plans.rewrite import optimised, period
from gridloom.plans.words import BLOCK, DEALT, in_rounds, lengths_of

#: Cells of a block's edge at most, and generations between exchanges unless told otherwise.
EDGE, DEPTH = 1024, 32


class ArrayTiles(Compiler):
    """Planes of tiles, rows by columns of tiles. All keep their size: what lies within the rule's reach of the border becomes meaningless."""

    def __init__(self, planes: list[np.ndarray], states: States, t: int, word: int, keys: dict[int, object]):
        self.kind = planes[0].dtype.type
        super().__init__(states, t, word, self.literal, keys)
        self.source = planes

    def literal(self, value: int) -> Word:
        return Word(self.kind(value & (1 << self.w) - 1))

    def neighbor(self, dx: int, dy: int) -> Lanes:
        if ("n", dx, dy) not in self.known:
            (tx, lanes), (ty, rows) = divmod(dx, TILE_X), divmod(dy, self.w // TILE_X)
            kind, near = self.kind, self.kind(near_lanes(self.w, lanes) & full(64) & (1 << self.w) - 1)

            def column(p: np.ndarray, x: int) -> np.ndarray:
                side = across(p, x, 1)
                here = across(side, ty, 0)
                return here >> kind(TILE_X * rows) | across(side, ty + 1, 0) << kind(self.w - TILE_X * rows) if rows else here

            planes = []
            for p in self.source:
                q = column(p, tx)
                if lanes:
                    q = q >> kind(lanes) & near | column(p, tx + 1) << kind(TILE_X - lanes) & ~near
                planes.append(Word(q))
            self.keep(("n", dx, dy), Lanes(tuple(planes), self.w, self.lit), False)
        return self.known["n", dx, dy][0]

    def toward(self, axis: str) -> Word:
        """Tiles have even sizes and begin at even places, so one word says it for all."""
        even = pattern(self.w, 1 if axis == "x" else TILE_X)
        return self.literal(even if self.t % 2 == 0 else ~even)


def advance_tiles(rule: R.Node, states: States, planes: list[np.ndarray], t: int, steps: int, word: int, halo: tuple[int, int]) -> list[np.ndarray]:
    """``steps`` generations of planes of tiles that have a halo of (rows, columns) of tiles on all sides, which goes. A rule that gives something that is no state is an error."""
    trees: dict[int, tuple[R.Node, dict[int, object]]] = {}
    inner = tuple(slice(h, n - h) for h, n in zip(halo, planes[0].shape))
    every = period(rule)
    for k in range(steps):
        step = (t + k) % every
        if step not in trees:
            trees[step] = (optimised(rule, t + k), {})
        tree, keys = trees[step]
        value, _ = ArrayTiles(planes, states, t + k, word, keys).lanes(tree)
        shape = planes[0].shape
        if value.bits > states.bits and reduce(np.bitwise_or, [np.broadcast_to(p.v, shape)[inner] for p in value.planes[states.bits :]]).any():
            raise ValueError("the rule gives numbers that are no states")
        planes = [np.ascontiguousarray(np.broadcast_to(p.v, shape)) for p in value.resized(states.bits).planes]
    return [p[inner] for p in planes]


def packed_tiles(states: States, cells: np.ndarray, word: int) -> np.ndarray:
    """(bits, rows, columns) of tiles, of an array of ordinals."""
    table = np.zeros(max(states.ordinals) + 1, "u1")
    table[list(states.ordinals)] = np.arange(len(states.ordinals))
    index, high = table[cells], word // TILE_X
    h, w = index.shape
    lanes = index.reshape(h // high, high, w // TILE_X, TILE_X).swapaxes(1, 2).reshape(h // high, w // TILE_X, word)
    return np.stack([np.packbits(lanes >> i & 1, axis=-1, bitorder="little").view(f"<u{word // 8}")[..., 0] for i in range(states.bits)])


def unpacked_tiles(states: States, planes: np.ndarray, word: int) -> np.ndarray:
    """The ordinals of tiles; an index of no state is an error."""
    bits, th, tw = planes.shape
    lanes = np.zeros((th, tw, word), "u1")
    for i, p in enumerate(planes):
        lanes |= np.unpackbits(np.ascontiguousarray(p).view("u1").reshape(th, tw, word // 8), axis=-1, bitorder="little") << np.uint8(i)
    if len(states.ordinals) < 1 << bits and lanes.size and lanes.max() >= len(states.ordinals):
        raise ValueError("the rule gives numbers that are no states")
    high = word // TILE_X
    return np.array(states.ordinals)[lanes.reshape(th, tw, high, TILE_X).swapaxes(1, 2).reshape(th * high, tw * TILE_X)]


def _mapped(rows: DataFrame, change: Callable[[int, int, bytes], bytes], name: str, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for by, bx, raw in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                yield pa.RecordBatch.from_arrays([pa.array([by], pa.int32()), pa.array([bx], pa.int32()), pa.array([change(by, bx, raw)], pa.binary())], names=["by", "bx", name])

    return rows.mapInArrow(run, schema)


class TileGrid:
    """A grid as blocks of tiles (by, bx, words); ``ys`` and ``xs`` are the blocks' edges in tiles."""

    def __init__(self, rows: DataFrame, ys: list[int], xs: list[int], states: States, word: int):
        self.rows, self.ys, self.xs, self.states, self.word = rows, ys, xs, states, word

    @property
    def edges(self) -> tuple[list[int], list[int]]:
        return [y * (self.word // TILE_X) for y in self.ys], [x * TILE_X for x in self.xs]

    @property
    def shape(self) -> Callable[[int, int], tuple[int, int, int]]:
        bits, ys, xs = self.states.bits, self.ys, self.xs
        return lambda by, bx: (bits, ys[by + 1] - ys[by], xs[bx + 1] - xs[bx])

    def with_rows(self, rows: DataFrame) -> TileGrid:
        return TileGrid(rows, self.ys, self.xs, self.states, self.word)

    def grid(self) -> Grid:
        """The cells, a row each."""
        shape, states, word, (ys, xs) = self.shape, self.states, self.word, self.edges
        cells = lambda by, bx, raw: unpacked_tiles(states, np.frombuffer(raw, f"<u{word // 8}").reshape(shape(by, bx)), word).astype("i4").tobytes()
        return Grid(from_blocks(_mapped(self.rows, cells, "cells", "by int, bx int, cells binary"), ys, xs, "i4"), xs[-1], ys[-1], states)


def from_grid(grid: Grid, word: int = 64, block: int = 0) -> TileGrid:
    """The tiles of a table of cells; the grid must divide into tiles, of 32 or 64 cells. ``block`` is the edge of a block in cells, by default what suits the grid and the cores."""
    high, states = word // TILE_X, grid.states
    if word not in (32, 64) or grid.width % TILE_X or grid.height % high:
        raise ValueError(f"a grid of {grid.width} x {grid.height} does not divide into tiles of {TILE_X} x {high} cells, of 32 or 64")
    cores, edge = grid.cells.sparkSession.sparkContext.defaultParallelism, block or EDGE
    while not block and edge > 128 and -(-grid.width // edge) * -(-grid.height // edge) < 2 * cores:
        edge //= 2
    parted = lambda tiles, most: [tiles * i // -(-tiles // most) for i in range(-(-tiles // most) + 1)]
    made = TileGrid(grid.cells, parted(grid.height // high, max(1, edge // high)), parted(grid.width // TILE_X, max(1, edge // TILE_X)), states, word)
    ys, xs = made.edges
    pack = lambda by, bx, raw: packed_tiles(states, np.frombuffer(raw, "i4").reshape(ys[by + 1] - ys[by], -1), word).tobytes()
    return made.with_rows(_mapped(to_blocks(grid, ys, xs, "i4").select("by", "bx", "cells"), pack, "words", BLOCK))


def run(grid: TileGrid, rule: R.Node, steps: int, first: int = 0, depth: int = 0) -> TileGrid:
    """``steps`` generations, ``depth`` of them between exchanges, or as many as blocks have tiles for."""
    if not steps:
        return grid
    word, states, reach, shape = grid.word, grid.states, R.reach(rule), grid.shape
    high = word // TILE_X
    least = [min(b - a for a, b in zip(e, e[1:])) for e in (grid.ys, grid.xs)]
    halo = lambda long: (-(-long * reach // high), -(-long * reach // TILE_X))
    fits = lambda long: all(h <= n for h, n in zip(halo(long), least))
    depth = min(depth or DEPTH, steps)
    while depth and not fits(depth):
        depth -= 1
    if not depth:
        raise ValueError(f"the rule reads {reach} cells far, further than a block of {least[1] * TILE_X} x {least[0] * high}")

    def advance(by: int, bx: int, whole: np.ndarray, t: int, long: int) -> np.ndarray:
        return np.stack(advance_tiles(rule, states, list(whole), t, long, word, halo(long)))

    ny, nx = len(grid.ys) - 1, len(grid.xs) - 1
    parts = max(min(ny * nx, 2 * grid.rows.sparkSession.sparkContext.defaultParallelism), -(-ny * nx // DEALT))
    return grid.with_rows(in_rounds(grid.rows, (ny, nx, parts), shape, halo, advance, lengths_of(steps, depth), first, f"<u{word // 8}"))
