"""Grids: dense tables of cells (x, y, s) with their size and states beside them, and the operations on whole grids."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TILES = 4  # of a checksum, each way


@dataclass(frozen=True)
class States:
    """The ordered states of an automaton. ``ordinals`` are what cells hold; a state's place in them is its index in packed layouts."""

    ordinals: tuple[int, ...]
    labels: tuple[str, ...] = ()
    glyphs: dict[int, str] = field(default_factory=dict, hash=False)

    @classmethod
    def integers(cls, bits: int) -> States:
        return cls(tuple(range(1 << bits)))

    @property
    def bits(self) -> int:
        """Bits that an index needs, one at least."""
        return max(1, (len(self.ordinals) - 1).bit_length())

    def index(self, ordinal: int) -> int:
        if ordinal not in self.ordinals:
            raise KeyError(f"unknown state {ordinal}")
        return self.ordinals.index(ordinal)

    def ordinal(self, index: int) -> int:
        if not 0 <= index < len(self.ordinals):
            raise IndexError(f"no state has index {index}")
        return self.ordinals[index]

    def glyph(self, ordinal: int) -> str:
        return self.glyphs.get(ordinal, str(ordinal))

    @property
    def plain(self) -> bool:
        return self.ordinals == tuple(range(len(self.ordinals)))

    def _mapped(self, value: Column, pairs: list[tuple[int, int]], what: str) -> Column:
        out = None
        for a, b in pairs:
            out = F.when(value == a, b) if out is None else out.when(value == a, b)
        return out.otherwise(F.raise_error(F.concat(F.lit(f"unknown {what} "), value.cast("string"))).cast("int"))

    def to_index(self, value: Column) -> Column:
        """Index column of an ordinal column; unknown ordinals stop the job."""
        if self.plain:
            return F.when(value.between(0, len(self.ordinals) - 1), value).otherwise(F.raise_error(F.concat(F.lit("unknown state "), value.cast("string"))).cast("int"))
        return self._mapped(value, [(o, i) for i, o in enumerate(self.ordinals)], "state")

    def to_ordinal(self, value: Column) -> Column:
        if self.plain:
            return F.when(value.between(0, len(self.ordinals) - 1), value).otherwise(F.raise_error(F.concat(F.lit("unknown index "), value.cast("string"))).cast("int"))
        return self._mapped(value, [(i, o) for i, o in enumerate(self.ordinals)], "index")


@dataclass(frozen=True)
class Grid:
    """``cells`` has columns x, y, s (int), one row for each cell of a torus of ``width`` by ``height``."""

    cells: DataFrame
    width: int
    height: int
    states: States = States((0, 1))

    def __post_init__(self) -> None:
        if self.width <= 0 or self.height <= 0:
            raise ValueError("a grid has at least one column and one row")

    def with_cells(self, cells: DataFrame, width: int | None = None, height: int | None = None) -> Grid:
        return Grid(cells, width or self.width, height or self.height, self.states)

    @property
    def logical_size(self) -> tuple[int, int]:
        return self.width, self.height

    def checked(self) -> Grid:
        """This grid if it has each cell exactly once, else an error."""
        good = (F.col("x").between(0, self.width - 1)) & F.col("y").between(0, self.height - 1) & F.col("s").isNotNull()
        rows, inside, distinct = self.cells.agg(F.count(F.lit(1)), F.count_if(good), F.count_distinct("x", "y")).first()
        if not rows == inside == distinct == self.width * self.height:
            raise ValueError(f"{self.width * self.height} cells were expected: {rows} rows, {inside} on the grid, {distinct} distinct")
        return self

    def get_cell(self, x: int, y: int) -> DataFrame:
        """The one cell at (x, y); off the grid is an error."""
        if not (0 <= x < self.width and 0 <= y < self.height):
            raise IndexError(f"({x}, {y}) is not on a grid of {self.width} x {self.height}")
        return self.cells.where((F.col("x") == x) & (F.col("y") == y))

    def with_margins(self, mx: int, my: int, state: int = 0) -> Grid:
        """The grid with ``mx`` columns and ``my`` rows of one state added on every side."""
        w, h = self.width + 2 * mx, self.height + 2 * my
        moved = self.cells.select((F.col("x") + mx).cast("int").alias("x"), (F.col("y") + my).cast("int").alias("y"), "s")
        inside = F.col("x").between(mx, mx + self.width - 1) & F.col("y").between(my, my + self.height - 1)
        border = skeleton(self.cells.sparkSession, w, h).where(~inside).withColumn("s", F.lit(state))
        return self.with_cells(moved.unionByName(border), w, h)

    def without_margins(self, mx: int, my: int) -> Grid:
        """The grid without its outer ``mx`` columns and ``my`` rows on every side."""
        w, h = self.width - 2 * mx, self.height - 2 * my
        inside = self.cells.where(F.col("x").between(mx, mx + w - 1) & F.col("y").between(my, my + h - 1))
        return self.with_cells(inside.select((F.col("x") - mx).cast("int").alias("x"), (F.col("y") - my).cast("int").alias("y"), "s"), w, h)

    def tile_sums(self) -> DataFrame:
        """(tile, sum) of the 16 checksum tiles in row-major order; tiles that small grids leave empty have 0."""
        tw, th = -(-self.width // TILES), -(-self.height // TILES)
        tile = F.expr(f"(y div {th}) * {TILES} + (x div {tw})").cast("int")
        sums = self.cells.groupBy(tile.alias("tile")).agg(F.sum(F.col("s").cast("long")).alias("sum"))
        all_tiles = self.cells.sparkSession.range(TILES * TILES).select(F.col("id").cast("int").alias("tile"))
        return all_tiles.join(sums, "tile", "left").select("tile", F.coalesce("sum", F.lit(0)).cast("long").alias("sum"))

    def checksum(self) -> DataFrame:
        """One row: the tile sums joined by hyphens."""
        return checksum_of(self.tile_sums())

    def histogram(self) -> DataFrame:
        return self.cells.groupBy("s").agg(F.count(F.lit(1)).alias("cells"))

    def lines(self) -> DataFrame:
        """(y, line): each row's glyphs with a gap after every eight columns."""
        glyph = F.create_map(*[x for o in self.states.ordinals for x in (F.lit(o), F.lit(self.states.glyph(o)))])[F.col("s")]
        pairs = F.array_sort(F.collect_list(F.struct("x", glyph.alias("g"))))
        groups = F.transform(F.sequence(F.lit(0), F.lit((self.width - 1) // 8)), lambda k: F.array_join(F.transform(F.slice(pairs, k * 8 + 1, F.lit(8)), lambda p: p["g"]), ""))
        return self.cells.groupBy("y").agg(F.array_join(groups, " ").alias("line"))

    def rendered(self) -> str:
        """All lines with a gap after every eight; the driver holds the text alone."""
        out = []
        for r in self.lines().orderBy("y").toLocalIterator():
            out += [""] * bool(r.y and r.y % 8 == 0) + [r.line]
        return "\n".join(out)


def checksum_of(tile_sums: DataFrame) -> DataFrame:
    """One row: the sums of (tile, sum) joined by hyphens."""
    pairs = F.array_sort(F.collect_list(F.struct("tile", "sum")))
    return tile_sums.agg(F.array_join(F.transform(pairs, lambda p: p["sum"].cast("string")), "-").alias("checksum"))


def skeleton(spark: SparkSession, width: int, height: int) -> DataFrame:
    """Every (x, y) of a grid, made without a shuffle."""
    cell = F.col("id")
    return spark.range(width * height).select((cell % width).cast("int").alias("x"), F.expr(f"id div {width}").cast("int").alias("y"))


def from_values(spark: SparkSession, rows: list[list[int]], states: States = States((0, 1))) -> Grid:
    """A grid from literal rows."""
    width = len(rows[0]) if rows else 0
    if any(len(r) != width for r in rows):
        raise ValueError("rows differ in length")
    cells = [(x, y, s) for y, row in enumerate(rows) for x, s in enumerate(row)]
    return Grid(spark.createDataFrame(cells, "x int, y int, s int"), width, len(rows), states)
