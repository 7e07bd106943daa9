"""Spatial blocking in Catalyst: a record is a band of whole rows of words, and of a band only its edge rows are exchanged.

A band holds an array of words for each plane, so all neighbours of a cell are in its own record, save those above its first row and below its last; they come from
the bands there, ``reach`` rows of each. In a generation the band gets these edges by a join, is taken apart into words within the task, is advanced by the same bitwise column
expressions as planes of words, and put together again. Bands keep their partitioning from the first generation on: what is shuffled are
edges, where planes of words send every word to each place that reads it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import rules as R
from gridloom.operators.grid import Grid, States
from gridloom.operators.layouts import Packed, to_bit_planes
from gridloom.plans.lineage import cut
from gridloom.plans.planes import ColumnPlanes, _col, _moves
from gridloom.plans.rewrite import optimised

#: Words of a band's plane, about; a band has a row at least.
BAND_WORDS = 1 << 14
#: Generations between lineage cuts; those between are kept in memory or on disk.
CUT_EVERY = 4


@dataclass(frozen=True)
class Bands:
    """Rows (band, p0..) of arrays of words, row by row; ``bands`` is their number and ``parts`` that of the partitions they are dealt to."""

    rows: DataFrame
    width: int
    height: int
    states: States
    word: int
    bands: int
    parts: int

    @property
    def planes(self) -> list[str]:
        return [f"p{i}" for i in range(self.states.bits)]

    @property
    def across(self) -> int:
        """Words of a row."""
        return self.width // self.word

    def with_rows(self, rows: DataFrame) -> Bands:
        return Bands(rows, self.width, self.height, self.states, self.word, self.bands, self.parts)

    def first_row(self, band: Column | str) -> Column:
        """Bands are of nearly equal height."""
        return F.expr(f"int({band} * {self.height}L div {self.bands})")

    def unpacked(self) -> Grid:
        nth = F.explode(F.sequence(F.lit(0), F.size("p0") - 1)).alias("k")
        words = self.rows.select("band", nth, *self.planes).select(self.y(), F.expr(f"k % {self.across}").alias("wx"), *[F.get(p, F.col("k")).alias(p) for p in self.planes])
        return Packed(words, "bit_planes", self.width, self.height, self.states, self.word).unpacked()

    def y(self) -> Column:
        return (self.first_row("band") + F.expr(f"int(k div {self.across})")).alias("y")


def _gathered(words: DataFrame, planes: list[str]) -> DataFrame:
    """Arrays of the words (band, k, p0..) of each band, in order; no shuffle where words are dealt by band already."""
    whole = words.groupBy("band").agg(F.sort_array(F.collect_list(F.struct("k", *planes))).alias("_words"))
    return whole.select("band", *[F.col(f"_words.{p}") for p in planes])


def from_grid(grid: Grid, word: int = 64, rows: int = 0, reach: int = 1) -> Bands:
    """Bands of about ``rows`` rows, by default of BAND_WORDS words, and no lower than a rule reads."""
    p = to_bit_planes(grid, word)
    across = grid.width // word
    spark = grid.cells.sparkSession
    cores = spark.sparkContext.defaultParallelism
    rows = rows or max(1, min(BAND_WORDS // across, -(-grid.height // (2 * cores))))
    bands = max(1, grid.height // max(rows, reach))
    parts = min(bands, max(2 * cores, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))
    out = Bands(p.words, grid.width, grid.height, grid.states, word, bands, parts)
    # The band that holds row y: the last that begins at it or before.
    band = F.expr(f"int(((y + 1L) * {bands} - 1) div {grid.height})").alias("band")
    placed = p.words.select(band, "y", "wx", *p.planes)
    placed = placed.select("band", ((F.col("y") - out.first_row("band")) * across + F.col("wx")).cast("int").alias("k"), *p.planes)
    return out.with_rows(_gathered(placed.repartition(parts, "band"), p.planes))


def _with_edges(b: Bands, reach: int) -> DataFrame:
    """The bands with ``reach`` rows more above and below."""
    if b.bands == 1:
        return b.rows
    n, names = reach * b.across, b.planes
    below = F.struct(F.pmod(F.col("band") - 1, F.lit(b.bands)).alias("band"), F.lit(True).alias("below"), *[F.slice(p, 1, n).alias(p) for p in names])
    above = F.struct(F.pmod(F.col("band") + 1, F.lit(b.bands)).alias("band"), F.lit(False).alias("below"), *[F.slice(p, -n, n).alias(p) for p in names])
    edges = b.rows.select(F.inline(F.array(below, above))).repartition(b.parts, "band")
    of = lambda p, below: F.max(F.when(F.col("below") == below, F.col(p)))
    edges = edges.groupBy("band").agg(*[of(p, below).alias(f"{p}_{name}") for p in names for name, below in (("below", True), ("above", False))])
    return b.rows.join(edges, "band").select("band", *[F.concat(f"{p}_above", p, f"{p}_below").alias(p) for p in names])


def step(b: Bands, rule: R.Node, t: int) -> Bands:
    """One generation."""
    tree = optimised(rule, t)
    reach, across = R.reach(tree), b.across
    alone = b.bands == 1
    if not alone and b.height // b.bands < reach:
        raise ValueError(f"the rule reads {reach} rows far, further than a band of {b.height // b.bands}")
    halo = 0 if alone else reach
    p = Packed(b.rows, "bit_planes", b.width, b.height, b.states, b.word)
    inner = F.sequence(F.lit(0), F.size("p0") - 2 * halo * across - 1)
    words = _with_edges(b, reach).select("band", *b.planes, F.explode(inner).alias("k"))
    row, at = F.expr(f"int(k div {across})"), F.expr(f"k % {across}")

    def moved(dx: int, dy: int, plane: str) -> Column:
        there = F.pmod(row + dy, F.lit(b.height)) if alone else row + (halo + dy)
        return F.get(plane, there * across + F.pmod(at + dx, F.lit(across)))

    names = [(moved(dx, dy, q), _col(dx, dy, i)) for dx, dy in _moves(p, tree) for i, q in enumerate(b.planes)]
    c = ColumnPlanes(words.select("band", "k", b.y(), *[w.alias(n) for w, n in names]), p, t)
    c.read(tree)
    value, _ = c.lanes(tree)
    return b.with_rows(_gathered(c.frame.select("band", "k", *[x.alias(n) for n, x in zip(b.planes, value.resized(b.states.bits).planes)]), b.planes))


def run_bands(b: Bands, rule: R.Node, steps: int, first: int = 0) -> Bands:
    """``steps`` generations. Each is computed once, as both the edges and the bands of the next need it."""
    held: list[DataFrame] = []
    for k in range(steps):
        b = step(b, rule, first + k)
        last = k + 1 == steps
        if not last and (k + 1) % CUT_EVERY:
            held.append(b.rows.persist(StorageLevel.MEMORY_AND_DISK))
            b = b.with_rows(held[-1])
        elif not last:
            b = b.with_rows(cut(b.rows))
            for df in held:
                df.unpersist()
            held = []
    return b


def run(grid: Grid, rule: R.Node, steps: int, first: int = 0, word: int = 64, rows: int = 0) -> Grid:
    """``steps`` generations of a grid whose width is a multiple of ``word``."""
    b = from_grid(grid, word, rows, R.reach(rule))
    return run_bands(b.with_rows(b.rows.persist(StorageLevel.MEMORY_AND_DISK)), rule, steps, first).unpacked()
