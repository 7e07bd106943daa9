from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gridloom.automata import AUTOMATA
from gridloom.functions.bitslice import Lanes, pattern
from gridloom.operators.grid import Grid, States, from_values
from gridloom.operators.layouts import to_bit_array, to_bit_planes, to_tiled_planes

THREE = States((0, 1, 2), ("dead", "alive", "dying"))
MAKERS = {"bit_array": to_bit_array, "bit_planes": to_bit_planes, "tiled": to_tiled_planes}


def rows_of(grid: Grid):
    cells = {(x, y): s for x, y, s in grid.cells.collect()}
    return [[cells[x, y] for x in range(grid.width)] for y in range(grid.height)]


def test_states():
    assert (THREE.bits, States((0,)).bits, States.integers(5).bits, len(States.integers(5).ordinals)) == (2, 1, 5, 32)
    fire = AUTOMATA["forest-fire"].states
    assert [fire.index(o) for o in range(4)] == [0, 1, 3, 2] and [fire.ordinal(i) for i in range(4)] == [0, 1, 3, 2]
    with pytest.raises(KeyError):
        THREE.index(99)
    with pytest.raises(IndexError):
        THREE.ordinal(99)
    assert fire.glyph(3) == "@" and fire.glyph(7) == "7"


@pytest.mark.parametrize("kind", MAKERS)
@pytest.mark.parametrize("word", [8, 32, 64])
def test_round_trips(spark, kind, word):
    rng = random.Random(42)
    values = [[rng.randrange(3) for _ in range(64)] for _ in range(16)]
    packed = MAKERS[kind](from_values(spark, values, THREE), word)
    assert rows_of(packed.unpacked()) == values
    assert packed.get_cell(33, 9).first()[2] == values[9][33]
    x, y = packed.physical_size
    assert packed.words.count() == x * y and packed.logical_size == (64, 16)


def test_sizes_that_do_not_divide(spark):
    grid = from_values(spark, [[0] * 12] * 4, THREE)
    for make, word in ((to_bit_array, 32), (to_bit_planes, 32), (to_tiled_planes, 32)):
        with pytest.raises(ValueError):
            make(grid, word)
    with pytest.raises(ValueError):
        to_bit_planes(grid, 12)


def test_memory_of_packed_cells(spark):
    none = spark.range(0).selectExpr("int(id) x", "int(id) y", "int(id) s")
    packed = to_bit_array(Grid(none, 1024, 10, THREE), 32)
    assert packed.bytes == 2560


def test_unknown_states_stop_the_job(spark):
    with pytest.raises(Exception, match="unknown state 7"):
        to_bit_planes(from_values(spark, [[7] * 8], THREE), 8).words.collect()


def test_grid_operations(spark):
    grid = from_values(spark, [[1, 0, 1], [0, 1, 1]])
    assert rows_of(grid.with_margins(1, 2))[2] == [0, 1, 0, 1, 0] and grid.with_margins(1, 2).logical_size == (5, 6)
    assert rows_of(grid.with_margins(2, 1).without_margins(2, 1)) == rows_of(grid)
    assert grid.checksum().first()[0] == "1-0-1-0-0-1-1-0-0-0-0-0-0-0-0-0"
    assert grid.checked() is grid and grid.get_cell(2, 1).first()[2] == 1
    for x, y in ((3, 0), (0, 2), (-1, 0)):
        with pytest.raises(IndexError):
            grid.get_cell(x, y)
    for bad in (grid.cells.limit(5), grid.cells.union(grid.cells.limit(1)), grid.cells.select((F.col("x") + 1).alias("x"), "y", "s")):
        with pytest.raises(ValueError):
            grid.with_cells(bad).checked()
    with pytest.raises(ValueError):
        Grid(grid.cells, 0, 1)
    with pytest.raises(ValueError):
        from_values(spark, [[1], [1, 0]])
    assert grid.rendered() == "101\n011"
    assert from_values(spark, [[0] * 9] * 9).rendered().splitlines()[8:] == ["", "00000000 0"]


@pytest.fixture(scope="module")
def lanes(spark):
    """Evaluates lanes of 8-bit words: numbers a and b in, a function's lanes out."""

    def planes(values, bits):
        return [sum((v >> i & 1) << k for k, v in enumerate(values)) for i in range(bits)]

    def run(a, b, make, bits_a=3, bits_b=3):
        row = spark.createDataFrame([tuple(planes(a, bits_a) + planes(b, bits_b))], ", ".join([f"a{i} long" for i in range(bits_a)] + [f"b{i} long" for i in range(bits_b)]))
        out = make(Lanes(tuple(F.col(f"a{i}") for i in range(bits_a)), 8), Lanes(tuple(F.col(f"b{i}") for i in range(bits_b)), 8))
        got = row.select(*[p.alias(f"p{i}") for i, p in enumerate(out.planes)]).first()
        return [sum((got[i] >> k & 1) << i for i in range(len(got))) for k in range(len(a))]

    return run


def test_known_sums(lanes):
    a, b = [1, 2, 3, 4], [2, 3, 1, 5]
    assert lanes(a, b, lambda p, q: p.plus(q)) == [3, 5, 4, 1]
    assert lanes(a, b, lambda p, q: p.ored(q)) == [3, 3, 3, 5]
    assert lanes(a, b, lambda p, q: p.xored(q)) == [3, 1, 2, 1]
    assert lanes(a, b, lambda p, q: p.anded(q)) == [0, 2, 1, 4]
    assert lanes([1, 2, 3], [3, 5, 6], lambda p, q: p.plus(q), 2, 3) == [4, 7, 1]
    assert lanes([1, 2, 3], [3, 5, 6], lambda p, q: p.ored(q), 2, 3) == [3, 7, 7]
    eight = [0, 1, 2, 3, 0, 1, 2, 3]
    assert lanes(eight, eight, lambda p, q: p.shifted_right(1))[:3] == [1, 2, 3]
    assert lanes(eight, eight, lambda p, q: p.shifted_left(1))[:3] == [0, 0, 1]


def test_random_lanes(lanes):
    rng = random.Random(42)
    for _ in range(6):
        a, b = ([rng.randrange(8) for _ in range(8)] for _ in "ab")
        pairs = list(zip(a, b))
        assert lanes(a, b, lambda p, q: Lanes.of_mask(p.equals(q), 8)) == [int(x == y) for x, y in pairs]
        assert lanes(a, b, lambda p, q: Lanes.of_mask(p.greater(q), 8)) == [int(x > y) for x, y in pairs]
        assert lanes(a, b, lambda p, q: Lanes.of_mask(p.less(q), 8)) == [int(x < y) for x, y in pairs]
        assert lanes(a, b, lambda p, q: Lanes.of_mask(p.differs(q), 8)) == [int(x != y) for x, y in pairs]
        assert lanes(a, b, lambda p, q: p.inverted()) == [7 - x for x in a]
        assert lanes(a, b, lambda p, q: p.widened_plus(q)) == [x + y for x, y in pairs]
        assert lanes(a, b, lambda p, q: p.swapped_pairs()) == [a[i ^ 1] for i in range(8)]


def test_lane_constants(lanes, spark):
    for v, bits in ((0, 1), (1, 2), (2, 3), (3, 3), (5, 4)):
        c = Lanes.constant(v, 8)
        assert c.bits == bits and lanes([0] * 8, [0] * 8, lambda p, q, c=c: c) == [v] * 8
    assert pattern(64, 1) == 0x5555555555555555 and pattern(64, 8) == 0x00FF00FF00FF00FF and pattern(32, 8) == 0x00FF00FF
    wide = spark.range(1).select(Lanes.constant(6, 64).set_at(63, 1).get_at(63).alias("a"), Lanes.constant(6, 64).get_at(62).alias("b")).first()
    assert tuple(wide) == (1, 6)
    with pytest.raises(IndexError):
        Lanes.constant(1, 8).get_at(8)
    with pytest.raises(ValueError):
        Lanes.constant(1, 8).modulo(0)
    assert lanes([7, 5, 3, 0, 1, 6, 2, 4], [0] * 8, lambda p, q: p.modulo(3)) == [1, 2, 0, 0, 1, 0, 2, 1]
