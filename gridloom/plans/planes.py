"""Generations on packed words in bitwise column expressions: bit planes in rows or in tiles, 32 or 64 cells at a time, and arrays of cells in a word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import columns
from gridloom.functions import rules as R
from gridloom.functions.bitslice import Lanes, column_word, full, pattern
from gridloom.functions.planes import Compiler
from gridloom.operators.grid import Grid
from gridloom.operators.layouts import TILE_X, Packed, to_bit_array, to_bit_planes, to_tiled_planes
from gridloom.plans.lineage import cut
from gridloom.plans.rewrite import optimised

CUT_EVERY = 4
PACK = {"bit_array": to_bit_array, "bit_planes": to_bit_planes, "tiled": to_tiled_planes}


def _col(dx: int, dy: int, i: int) -> str:
    return f"w_{dx}_{dy}_{i}".replace("-", "m")


def _moves(p: Packed, rule: R.Node) -> list[tuple[int, int]]:
    """Where the words lie that hold the cells a rule reads."""
    out = set()
    for dx, dy in R.offsets(rule):
        (qx, rx), (qy, ry) = divmod(dx, p.tile[0]), divmod(dy, p.tile[1])
        out.update((x, y) for x in (qx, qx + bool(rx)) for y in (qy, qy + bool(ry)))
    return sorted(out)


def _keys(p: Packed) -> tuple[str, str]:
    return ("ty", "tx") if p.kind == "tiled" else ("y", "wx")


def _columns(p: Packed) -> list[str]:
    return ["w"] if p.kind == "bit_array" else p.planes


def exchanged(p: Packed, rule: R.Node) -> DataFrame:
    """The keys and, as w_., the words around each word that the rule reads from, in one shuffle."""
    nx, ny = p.physical_size
    (ky, kx), names = _keys(p), _columns(p)
    moves = _moves(p, rule)
    at = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in moves])
    rows = p.words.select(F.col(ky).alias("_y"), F.col(kx).alias("_x"), *names, F.inline(at))
    rows = rows.select(F.pmod(F.col("_y") - F.col("dy"), F.lit(ny)).alias(ky), F.pmod(F.col("_x") - F.col("dx"), F.lit(nx)).alias(kx), "dx", "dy", *names)
    aggs = [F.max(F.when((F.col("dx") == dx) & (F.col("dy") == dy), F.col(n))).alias(_col(dx, dy, i)) for dx, dy in moves for i, n in enumerate(names)]
    return rows.groupBy(ky, kx).agg(*aggs)


class ColumnPlanes(Compiler):
    """Each part that is kept becomes columns of its own, so that no expression is repeated within another."""

    def __init__(self, frame: DataFrame, p: Packed, t: int):
        super().__init__(p.states, t, p.word, column_word)
        self.frame, self.made = frame, 0

    def keep_all(self, parts: list[tuple[object, Lanes, bool]]) -> list[Lanes]:
        """One projection for all of them."""
        made = []
        for key, value, flag in parts:
            names = [f"k{self.made}_{i}" for i in range(value.bits)]
            self.made += 1
            made.append((key, value, flag, names))
        self.frame = self.frame.select("*", *[c.alias(n) for _, value, _, names in made for n, c in zip(names, value.planes)])
        return [super(ColumnPlanes, self).keep(key, Lanes(tuple(F.col(n) for n in names), self.w), flag)[0] for key, _, flag, names in made]

    def keep(self, key: object, value: Lanes, flag: bool) -> tuple[Lanes, bool]:
        self.keep_all([(key, value, flag)])
        return self.known[key]

    def moved(self, dx: int, dy: int) -> Lanes:
        """The cells at an offset, from the words that hold them."""
        words, lanes = divmod(dx, self.w)
        planes = []
        for i in range(self.states.bits):
            here = F.col(_col(words, dy, i))
            if lanes:
                here = F.shiftrightunsigned(here, lanes).bitwiseOR(F.shiftleft(F.col(_col(words + 1, dy, i)), self.w - lanes).bitwiseAND(self.lit(full(self.w))))
            planes.append(here)
        return Lanes(tuple(planes), self.w)

    def read(self, rule: R.Node) -> None:
        """Have all cells at hand that the rule reads."""
        self.keep_all([(("n", dx, dy), self.moved(dx, dy), False) for dx, dy in sorted(R.offsets(rule))])

    def neighbor(self, dx: int, dy: int) -> Lanes:
        return self.known["n", dx, dy][0]

    def toward(self, axis: str) -> Column:
        """Lanes with even x + t, as words are of even width; whole rows for y."""
        if axis == "x":
            even = pattern(self.w, 1)
            return self.lit(even if self.t % 2 == 0 else even ^ full(self.w))
        return F.when((F.col("y") + self.t) % 2 == 0, self.lit(full(self.w))).otherwise(self.lit(0))


def near_lanes(width: int, moved: int) -> int:
    """The lanes of a tile whose cell ``moved`` places on in x lies in the same tile."""
    word = sum(1 << i for i in range(width) if i % TILE_X < TILE_X - moved)
    return word - (word >> 63 << 64)


class TiledPlanes(ColumnPlanes):
    """Words are tiles of 8 by word/8 cells: a step in y moves by eight lanes, one in x within rows of eight."""

    def moved(self, dx: int, dy: int) -> Lanes:
        (tx, lanes), (ty, rows) = divmod(dx, TILE_X), divmod(dy, self.w // TILE_X)
        near = near_lanes(self.w, lanes)
        left = lambda c, n: F.shiftleft(c, n).bitwiseAND(self.lit(full(self.w)))
        right = F.shiftrightunsigned

        def column(x: int, i: int) -> Column:
            """A tile's column of tiles, moved by dy."""
            here = F.col(_col(x, ty, i))
            return right(here, TILE_X * rows).bitwiseOR(left(F.col(_col(x, ty + 1, i)), self.w - TILE_X * rows)) if rows else here

        planes = []
        for i in range(self.states.bits):
            word = column(tx, i)
            if lanes:
                word = right(word, lanes).bitwiseAND(self.lit(near)).bitwiseOR(left(column(tx + 1, i), TILE_X - lanes).bitwiseAND(self.lit(full(self.w) ^ near)))
            planes.append(word)
        return Lanes(tuple(planes), self.w)

    def toward(self, axis: str) -> Column:
        if axis == "x":
            return super().toward("x")
        rows = pattern(self.w, TILE_X)
        even = (F.col("ty") * (self.w // TILE_X) + self.t) % 2 == 0
        return F.when(even, self.lit(rows)).otherwise(self.lit(rows ^ full(self.w)))


def _array_step(p: Packed, rule: R.Node, t: int) -> Packed:
    """Each cell of a word by itself, by the rule for cells; all of a word's cells are at hand where its neighbours are, so they are packed without a shuffle."""
    bits, k = p.states.bits, p.word // p.states.bits
    tree = optimised(rule, t)
    lane = F.col("lane")

    def cell(dx: int, dy: int) -> Column:
        words, lanes = divmod(dx, k)
        word = F.col(_col(words, dy, 0))
        if lanes:
            word = F.when(lane + lanes >= k, F.col(_col(words + 1, dy, 0))).otherwise(word)
        moved = F.call_function("shiftrightunsigned", word, (F.pmod(lane + dx, F.lit(k)) * bits).cast("int"))
        return p.states.to_ordinal(moved.bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")).alias(columns.name(dx, dy))

    frame = exchanged(p, tree).select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("lane"))
    frame = frame.select("y", "wx", "lane", (F.col("wx") * k + lane).alias("x"), *[cell(dx, dy) for dx, dy in sorted(R.offsets(tree))])
    new = p.states.to_index(columns.to_column(tree, t)).cast("long")
    frame = frame.select("y", "wx", F.call_function("shiftleft", new, (lane * bits).cast("int")).alias("_v"))
    words = frame.groupBy("y", "wx").agg(F.bit_or("_v").alias("w"))
    return Packed(words, p.kind, p.width, p.height, p.states, p.word)


def step(p: Packed, rule: R.Node, t: int) -> Packed:
    """One generation of a packed grid."""
    if p.kind == "bit_array":
        return _array_step(p, rule, t)
    tree = optimised(rule, t)
    c = (TiledPlanes if p.kind == "tiled" else ColumnPlanes)(exchanged(p, tree), p, t)
    c.read(tree)
    value, _ = c.lanes(tree)
    words = c.frame.select(*_keys(p), *[x.alias(n) for n, x in zip(p.planes, value.resized(p.states.bits).planes)])
    return Packed(words, p.kind, p.width, p.height, p.states, p.word)


def run_packed(p: Packed, rule: R.Node, steps: int, first: int = 0) -> Packed:
    """``steps`` generations of a packed grid, packed."""
    for k in range(steps):
        p = step(p, rule, first + k)
        if (k + 1) % CUT_EVERY == 0 and k + 1 < steps:
            p = Packed(cut(p.words), p.kind, p.width, p.height, p.states, p.word)
    return p


def run(grid: Grid, rule: R.Node, steps: int, first: int = 0, word: int = 32, kind: str = "bit_planes") -> Grid:
    """``steps`` generations; the grid must divide into words of the layout, and for planes the rule must give states only."""
    return run_packed(PACK[kind](grid, word), rule, steps, first).unpacked()
