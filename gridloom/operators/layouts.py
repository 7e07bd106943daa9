"""Packed layouts of grids, and back: several cells a word, bit planes, and planes of 8-wide tiles.

Words are LONG columns; 32-bit words are zero-extended. Packed tables hold dictionary indices, cells hold ordinals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.grid import Grid, States

WIDTHS = (8, 16, 32, 64)
TILE_X = 8


@dataclass(frozen=True)
class Packed:
    """A grid in a packed layout: ``kind`` is bit_array (y, wx, w), bit_planes (y, wx, p0..) or tiled (ty, tx, p0..)."""

    words: DataFrame
    kind: str
    width: int
    height: int
    states: States
    word: int

    @property
    def tile(self) -> tuple[int, int]:
        """Cells of a word in x and y."""
        return {"bit_array": (self.word // self.states.bits, 1), "bit_planes": (self.word, 1), "tiled": (TILE_X, self.word // TILE_X)}[self.kind]

    @property
    def logical_size(self) -> tuple[int, int]:
        return self.width, self.height

    @property
    def physical_size(self) -> tuple[int, int]:
        return self.width // self.tile[0], self.height // self.tile[1]

    @property
    def planes(self) -> list[str]:
        return [f"p{i}" for i in range(self.states.bits)]

    @property
    def bytes(self) -> int:
        """Memory of the words alone."""
        x, y = self.physical_size
        return x * y * self.word // 8 * (1 if self.kind == "bit_array" else self.states.bits)

    def unpacked(self) -> Grid:
        return Grid(_cells(self), self.width, self.height, self.states)

    def get_cell(self, x: int, y: int) -> DataFrame:
        """(x, y, s) of one cell, read from its word alone; off the grid is an error."""
        if not (0 <= x < self.width and 0 <= y < self.height):
            raise IndexError(f"({x}, {y}) is not on a grid of {self.width} x {self.height}")
        tx, ty = self.tile
        keys = ("ty", "tx") if self.kind == "tiled" else ("y", "wx")
        word = self.words.where((F.col(keys[0]) == y // ty) & (F.col(keys[1]) == x // tx))
        index = _lane(self, F.lit((x % tx) + (y % ty) * tx))
        return word.select(F.lit(x).alias("x"), F.lit(y).alias("y"), self.states.to_ordinal(index).alias("s"))


def _shape(kind: str, states: States, word: int, width: int, height: int) -> tuple[int, int]:
    if word not in WIDTHS:
        raise ValueError(f"words have {WIDTHS} bits")
    tx, ty = Packed(None, kind, width, height, states, word).tile  # type: ignore[arg-type]
    if not tx or not ty:
        raise ValueError("a word holds no cell of this size")
    if width % tx or height % ty:
        raise ValueError(f"a grid of {width} x {height} does not divide into words of {tx} x {ty} cells")
    return tx, ty


def _lane(p: Packed, lane: Column) -> Column:
    """Index held by a lane of a word row."""
    if p.kind == "bit_array":
        bits = p.states.bits
        return F.expr("w").bitwiseAND(F.lit(-1).cast("long")) if bits == 64 else F.call_function("shiftrightunsigned", F.col("w"), (lane * bits).cast("int")).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")
    out = F.lit(0)
    for i, name in enumerate(p.planes):
        out = out.bitwiseOR(F.shiftleft(F.call_function("shiftrightunsigned", F.col(name), lane.cast("int")).bitwiseAND(F.lit(1).cast("long")).cast("int"), i))
    return out


def _word(grid: Grid, kind: str, word: int) -> Packed:
    tx, ty = _shape(kind, grid.states, word, grid.width, grid.height)
    bits = grid.states.bits
    lane = F.expr(f"(x % {tx}) + (y % {ty}) * {tx}")
    rows = grid.cells.select(F.expr(f"int(y div {ty})").alias("_y"), F.expr(f"int(x div {tx})").alias("_x"), lane.alias("lane"), grid.states.to_index(F.col("s")).cast("long").alias("v"))
    keys = ("ty", "tx") if kind == "tiled" else ("y", "wx")
    moved = lambda v, by: F.call_function("shiftleft", v, by.cast("int"))
    if kind == "bit_array":
        aggs = [F.bit_or(moved(F.col("v"), F.col("lane") * bits)).alias("w")]
    else:
        aggs = [F.bit_or(moved(F.shiftright("v", i).bitwiseAND(F.lit(1).cast("long")), F.col("lane"))).alias(f"p{i}") for i in range(bits)]
    words = rows.groupBy(F.col("_y").alias(keys[0]), F.col("_x").alias(keys[1])).agg(*aggs)
    return Packed(words, kind, grid.width, grid.height, grid.states, word)


def to_bit_array(grid: Grid, word: int = 32) -> Packed:
    """As many cells a word as fit, lowest bits first."""
    return _word(grid, "bit_array", word)


def to_bit_planes(grid: Grid, word: int = 32) -> Packed:
    """A word for each bit of ``word`` cells in a row."""
    return _word(grid, "bit_planes", word)


def to_tiled_planes(grid: Grid, word: int = 32) -> Packed:
    """A word for each bit of a tile of 8 by word/8 cells."""
    return _word(grid, "tiled", word)


def _cells(p: Packed) -> DataFrame:
    tx, ty = p.tile
    keys = ("ty", "tx") if p.kind == "tiled" else ("y", "wx")
    rows = p.words.select(F.col(keys[0]).alias("_y"), F.col(keys[1]).alias("_x"), *(["w"] if p.kind == "bit_array" else p.planes), F.explode(F.sequence(F.lit(0), F.lit(tx * ty - 1))).alias("lane"))
    return rows.select(
        (F.col("_x") * tx + F.col("lane") % tx).cast("int").alias("x"), (F.col("_y") * ty + F.expr(f"lane div {tx}")).cast("int").alias("y"), p.states.to_ordinal(_lane(p, F.col("lane"))).alias("s")
    )
