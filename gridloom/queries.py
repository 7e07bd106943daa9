"""The engine's registered queries over the driver's tables, each with hand-written DuckDB SQL.

The SQL is written from the automata's definitions and not from the rule trees, so that a rule transcribed wrongly shows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.automata import AUTOMATA
from gridloom.functions import rules as R
from gridloom.functions.bitslice import Lanes
from gridloom.functions.rules import HERE, MARGOLUS, MOORE, VON_NEUMANN, Const, Neighbor, Node, Opposite, State, count, when
from gridloom.operators import layouts, results
from gridloom.operators.grid import Grid, States, from_values
from gridloom.operators.neighbors import evaluated, gather
from gridloom.plans.rewrite import optimised
from gridloom.plans.run import STRATEGIES, run
from gridloom.sources.seeded import two_states
from gridloom.sources.shapes import circle, rectangle, segment, shapes_grid
from gridloom.sources.tables import rasterised

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
X = Y = 64


def _grid(spark: SparkSession, sf_dir: str, states: States, x: int = X, y: int = Y, table: str = "lineitem", keys: tuple[str, str] = ("l_orderkey", "l_partkey")) -> Grid:
    return rasterised(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*keys), keys[0], keys[1], x, y, states)


def _grid_sql(k: int, x: int = X, y: int = Y, table: str = "lineitem", keys: tuple[str, str] = ("l_orderkey", "l_partkey")) -> str:
    return f"""SELECT CAST(i % {x} AS INT) AS x, CAST(i // {x} AS INT) AS y, CAST(coalesce(n, 0) % {k} AS INT) AS s
      FROM range({x * y}) AS r(i) LEFT JOIN (SELECT {keys[0]} % {x} AS kx, {keys[1]} % {y} AS ky, count(*) AS n FROM {table} GROUP BY 1, 2) ON i % {x} = kx AND i // {x} = ky"""


_AROUND = {"nw": (-1, -1), "n": (0, -1), "ne": (1, -1), "w": (-1, 0), "c": (0, 0), "e": (1, 0), "sw": (-1, 1), "z": (0, 1), "se": (1, 1)}
_OFFS = ", ".join(f"({dx}, {dy})" for dx, dy in _AROUND.values())


def _m(v: object) -> str:
    return "(" + " + ".join(f"({n} = {v})::INT" for n in _AROUND if n != "c") + ")"


def _v(v: object) -> str:
    return "(" + " + ".join(f"({n} = {v})::INT" for n in ("n", "z", "w", "e")) + ")"


#: The Margolus block: across in x, across in y, and opposite.
_BX = "(CASE WHEN (x + t) % 2 = 0 THEN e ELSE w END)"
_BY = "(CASE WHEN (y + t) % 2 = 0 THEN z ELSE n END)"
_BO = "(CASE WHEN (x + t) % 2 = 0 THEN CASE WHEN (y + t) % 2 = 0 THEN se ELSE ne END ELSE CASE WHEN (y + t) % 2 = 0 THEN sw ELSE nw END END)"


def _b(v: object) -> str:
    return f"((c = {v})::INT + ({_BX} = {v})::INT + ({_BY} = {v})::INT + ({_BO} = {v})::INT)"


def _around_sql(source: str, t: str = "t", where: str = "") -> str:
    """(t, x, y, nw .. se) from (t, x, y, s)."""
    picks = ", ".join(f"max(CASE WHEN dx = {dx} AND dy = {dy} THEN s END) AS {n}" for n, (dx, dy) in _AROUND.items())
    return f"SELECT {t} AS t, CAST((x - dx + {{X}}) % {{X}} AS INT) AS x, CAST((y - dy + {{Y}}) % {{Y}} AS INT) AS y, {picks} FROM {source}, (VALUES {_OFFS}) AS o(dx, dy) {where} GROUP BY ALL"


def _sized(sql: str, x: int = X, y: int = Y) -> str:
    return sql.replace("{X}", str(x)).replace("{Y}", str(y))


def _run_sql(rule: str, k: int, steps: int, x: int = X, y: int = Y, **of: object) -> str:
    step = _around_sql("r", where=f"WHERE t < {steps}")
    return _sized(
        f"""WITH RECURSIVE g AS ({_grid_sql(k, x, y, **of)}),
        r AS (SELECT 0 AS t, x, y, s FROM g UNION ALL SELECT t + 1, x, y, CAST({rule} AS INT) FROM ({step}))
        SELECT x, y, s FROM r WHERE t = {steps}""",
        x,
        y,
    )


#: Next state from c, its neighbours and t; the automata's definitions.
_RULES = {
    "game-of-life": (2, f"CASE WHEN {_m(1)} = 3 OR (c = 1 AND {_m(1)} = 2) THEN 1 ELSE 0 END"),
    "maze": (2, f"CASE WHEN {_m(1)} = 3 OR (c = 1 AND {_m(1)} < 6) THEN 1 ELSE 0 END"),
    "brian": (3, f"CASE WHEN c = 0 AND {_m(2)} = 2 THEN 2 WHEN c = 2 THEN 1 ELSE 0 END"),
    "forest-fire": (4, f"CASE c WHEN 3 THEN 2 WHEN 2 THEN CASE WHEN {_v(3)} > 0 THEN 2 ELSE 0 END WHEN 1 THEN CASE WHEN {_v(3)} > 0 THEN 3 ELSE 1 END ELSE 0 END"),
    "wire": (4, f"CASE c WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN CASE WHEN {_m(1)} IN (1, 2) THEN 1 ELSE 3 END ELSE 0 END"),
    "excitable": (8, f"CASE WHEN c = 0 THEN CASE WHEN {_m(1)} > 0 THEN 1 ELSE 0 END ELSE (c + 1) % 8 END"),
    "cyclic": (32, f"CASE WHEN {_m('(c + 1) % 32')} > 0 THEN (c + 1) % 32 ELSE c END"),
    "fluid": (
        16,
        "(CASE WHEN (n & 1) > 0 AND (z & 2) > 0 AND ((w & 4) | (e & 8)) = 0 THEN 12 ELSE (n & 1) | (z & 2) END) | (CASE WHEN (w & 4) > 0 AND (e & 8) > 0 AND ((n & 1) | (z & 2)) = 0 THEN 3 ELSE (w & 4) | (e & 8) END)",
    ),
    "critters": (2, f"CASE WHEN {_b(1)} = 3 THEN 1 - {_BO} WHEN {_b(1)} = 2 THEN c ELSE 1 - c END"),
    "traffic": (
        3,
        "CASE WHEN t % 2 = 0 THEN CASE c WHEN 1 THEN CASE WHEN e = 0 THEN 0 ELSE 1 END WHEN 0 THEN CASE WHEN w = 1 THEN 1 ELSE 0 END ELSE 2 END "
        "ELSE CASE c WHEN 2 THEN CASE WHEN z = 0 THEN 0 ELSE 2 END WHEN 0 THEN CASE WHEN n = 2 THEN 2 ELSE 0 END ELSE 1 END END",
    ),
}


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _automaton(name: str, steps: int, strategy: str, x: int = X, y: int = Y) -> Query:
    a = AUTOMATA[name]
    return lambda spark, sf: run(_grid(spark, sf, a.states, x, y), a.rule, steps, strategy).cells


for _name, (_k, _rule) in _RULES.items():
    _short = "ca_" + _name.replace("-", "_")
    _add(f"{_short}_t1", _automaton(_name, 1, "cells"), _run_sql(_rule, _k, 1))
    _add(f"{_short}_t8", _automaton(_name, 8, "auto"), _run_sql(_rule, _k, 8))
    _add(f"{_short}_cells_t3", _automaton(_name, 3, "cells"), _run_sql(_rule, _k, 3))
    _add(f"{_short}_planes_t2", _automaton(_name, 2, "planes"), _run_sql(_rule, _k, 2))
    _add(f"{_short}_tiled_t2", _automaton(_name, 2, "tiled"), _run_sql(_rule, _k, 2))
    _add(f"{_short}_blocked_t2", _automaton(_name, 2, "blocked"), _run_sql(_rule, _k, 2))
    _add(f"{_short}_tiled_t8", _automaton(_name, 8, "tiles"), _run_sql(_rule, _k, 8))
    # 60 columns divide into words of any number of cells that 32 bits hold of 1 to 5 bits each but 32 and 16
    _wide = 64 if AUTOMATA[_name].states.bits in (1, 2, 4) else 60
    _add(f"{_short}_bit_array_t2", _automaton(_name, 2, "bit_array", _wide), _run_sql(_rule, _k, 2, _wide))

# -- other grids: odd sizes, other tables

_add("ca_critters_odd_t6", lambda s, d: run(_grid(s, d, AUTOMATA["critters"].states, 37, 29), AUTOMATA["critters"].rule, 6, "strips", block=16, temporal_steps=3).cells, _run_sql(_RULES["critters"][1], 2, 6, 37, 29))
_add(
    "ca_gol_orders_t4",
    lambda s, d: run(_grid(s, d, AUTOMATA["game-of-life"].states, 96, 48, "orders", ("o_orderkey", "o_custkey")), AUTOMATA["game-of-life"].rule, 4).cells,
    _run_sql(_RULES["game-of-life"][1], 2, 4, 96, 48, table="orders", keys=("o_orderkey", "o_custkey")),
)
_add("ca_gol_tiny_t5", lambda s, d: run(_grid(s, d, AUTOMATA["game-of-life"].states, 2, 1), AUTOMATA["game-of-life"].rule, 5, "cells").cells, _run_sql(_RULES["game-of-life"][1], 2, 5, 2, 1))
_add("ca_gol_strips_t64_512", lambda s, d: run(_grid(s, d, AUTOMATA["game-of-life"].states, 512, 512), AUTOMATA["game-of-life"].rule, 64, "strips").cells, _run_sql(_RULES["game-of-life"][1], 2, 64, 512, 512))


# -- rules that read far

#: Offsets of cells that are summed, by how far they lie, and the strategies that are run for each.
_FAR = {
    2: (((2, 0), (0, -2), (-1, 2)), ("bit_array", "planes", "strips", "tiles")),
    5: (((5, -3), (-5, 5), (0, 4)), ("cells", "tiled", "blocked", "strips")),
}


def _far_sql(offsets: tuple[tuple[int, int], ...]) -> str:
    joins = " ".join(f"JOIN g g{i} ON g{i}.x = (g.x + {dx + X}) % {X} AND g{i}.y = (g.y + {dy + Y}) % {Y}" for i, (dx, dy) in enumerate(offsets))
    return f"WITH g AS ({_grid_sql(4)}) SELECT g.x, g.y, CAST((g.s + {' + '.join(f'g{i}.s' for i in range(len(offsets)))}) % 4 AS INT) AS s FROM g {joins}"


def _far(offsets: tuple[tuple[int, int], ...], strategy: str) -> Query:
    rule = sum((Neighbor(dx, dy) for dx, dy in offsets), HERE) % 4
    return lambda s, d: run(_grid(s, d, States((0, 1, 2, 3))), rule, 1, strategy).cells


for _reach, (_offsets, _strategies) in _FAR.items():
    for _s in _strategies:
        _add(f"far_{_reach}_{_s}", _far(_offsets, _s), _far_sql(_offsets))

# Remainders by twelve of sums, by long division on planes.
_add("planes_modulo_12", lambda s, d: run(_grid(s, d, States(tuple(range(12)))), (HERE + Neighbor(1, 0) + 5) % 12, 1, "planes").cells, f"WITH g AS ({_grid_sql(12)}) SELECT g.x, g.y, CAST((g.s + e.s + 5) % 12 AS INT) AS s FROM g JOIN g e ON e.x = (g.x + 1) % {X} AND e.y = g.y")

# -- one query for each operator of the rule language, on a grid of eight states


def _op(name: str, rule: Node, sql: str, t: int = 0, k: int = 8) -> None:
    _add(name, lambda s, d: evaluated(_grid(s, d, States.integers((k - 1).bit_length()) if k & (k - 1) == 0 else States(tuple(range(k)))), optimised(rule, t), t, "value"), _sized(f"WITH g AS ({_grid_sql(k)}) SELECT x, y, CAST({sql} AS INT) AS value FROM ({_around_sql('g', str(t))})"))


def _flag(rule: Node) -> Node:
    return when(rule).then(1).otherwise(0)


_EAST, _SOUTH = Neighbor(1, 0), Neighbor(0, 1)
_op("op_constant", HERE + Const(5), "c + 5")
_op("op_state_constant", when(HERE == State(3)).then(State(7)).otherwise(State(1)), "CASE WHEN c = 3 THEN 7 ELSE 1 END")
_op("op_current_state", HERE, "c")
_op("op_equals", _flag(HERE == _EAST), "(c = e)::INT")
_op("op_not_equals", _flag(HERE != _EAST), "(c <> e)::INT")
_op("op_gt", _flag(HERE > _EAST), "(c > e)::INT")
_op("op_lt", _flag(HERE < _EAST), "(c < e)::INT")
_op("op_and", _flag((HERE > 2) & (_EAST < 5)), "(c > 2 AND e < 5)::INT")
_op("op_or", _flag((HERE > 5) | (_EAST < 2)), "(c > 5 OR e < 2)::INT")
_op("op_not", _flag(~(HERE > _EAST)), "(NOT c > e)::INT")
_op("op_plus", HERE + _EAST, "c + e")
_op("op_modulo", (HERE + _SOUTH) % 5, "(c + z) % 5")
_op("op_bit_and", HERE.bit_and(_EAST), "c & e")
_op("op_bit_or", HERE.bit_or(_EAST), "c | e")
_op("op_bit_and_booleans", _flag((HERE > 2).bit_and(_EAST > 2)), "(c > 2 AND e > 2)::INT")
_op("op_has_bit", _flag(HERE.has_bit(1)), "((c >> 1) & 1)")
_op("op_if", when(HERE > 3).then(HERE).otherwise(_EAST), "CASE WHEN c > 3 THEN c ELSE e END")
_op("op_if_chain", when(HERE == 0).then(5).when(HERE == 1).then(4).when(HERE < 4).then(_EAST).otherwise(_SOUTH), "CASE WHEN c = 0 THEN 5 WHEN c = 1 THEN 4 WHEN c < 4 THEN e ELSE z END")
_op("op_alternate_even", R.Alternate((HERE + 1, _EAST)), "c + 1", 4)
_op("op_alternate_odd", R.Alternate((HERE + 1, _EAST)), "e", 5)
_op("count_moore", count(State(1), MOORE), _m(1))
_op("count_moore_expression", count((HERE + 1) % 8, MOORE), _m("(c + 1) % 8"))
_op("count_von_neumann", count(State(1), VON_NEUMANN), _v(1))
_op("count_von_neumann_expression", count(HERE, VON_NEUMANN), _v("c"))
_op("count_margolus_even", count(State(1), MARGOLUS), _b(1), 0)
_op("count_margolus_odd", count(State(1), MARGOLUS), _b(1), 1)
_op("margolus_180_even", Opposite(), _BO, 0)
_op("margolus_180_odd", Opposite(), _BO, 1)
_op("exists_moore", _flag(count(State(5), MOORE) > 0), f"({_m(5)} > 0)::INT")


def _shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gather(_grid(spark, sf_dir, States.integers(3)), [(-1, 0), (2, 1), (0, -3)])
    return rows.select("x", "y", F.col("n_m1_0").alias("west"), F.col("n_2_1").alias("far"), F.col("n_0_m3").alias("north3"))


_add(
    "neighbor_shift",
    _shift,
    f"""WITH g AS ({_grid_sql(8)}) SELECT g.x, g.y, a.s AS west, b.s AS far, c.s AS north3 FROM g
    JOIN g a ON a.x = (g.x + 63) % 64 AND a.y = g.y JOIN g b ON b.x = (g.x + 2) % 64 AND b.y = (g.y + 1) % 64 JOIN g c ON c.x = g.x AND c.y = (g.y + 61) % 64""",
)
_op("neighbor_at_moore", sum((Neighbor(dx, dy) for dx, dy in R.OFFSETS[MOORE]), Const(0)), "nw + n + ne + w + e + sw + z + se")

# -- whole grids and layouts


def _layout(make: Callable[..., layouts.Packed], word: int = 32) -> Query:
    return lambda s, d: make(_grid(s, d, States.integers(3)), word).words


def _around_trip(make: Callable[..., layouts.Packed], word: int = 32) -> Query:
    return lambda s, d: make(_grid(s, d, AUTOMATA["forest-fire"].states), word).unpacked().cells


def _signed64(e: str) -> str:
    """A HUGEINT sum of 64 bits as a signed BIGINT."""
    return f"CAST(CASE WHEN {e} >= 9223372036854775808 THEN {e} - 18446744073709551616 ELSE {e} END AS BIGINT)"


_ONE = "(1::HUGEINT << {}::INT)"
_plane = lambda i, lane, wide=False: (lambda e: _signed64(e) if wide else f"CAST({e} AS BIGINT)")(f"sum(((s >> {i}) & 1)::HUGEINT * CAST(pow(2::DOUBLE, {lane}) AS HUGEINT))")
_add("pack_bit_array", lambda s, d: layouts.to_bit_array(_grid(s, d, States((0, 1, 2, 3)), 64, 64), 32).words, f"WITH g AS ({_grid_sql(4)}) SELECT y, CAST(x // 16 AS INT) AS wx, CAST(sum(s * CAST(pow(4::DOUBLE, x % 16) AS BIGINT)) AS BIGINT) AS w FROM g GROUP BY ALL")
_add("pack_bit_planes", _layout(layouts.to_bit_planes), f"WITH g AS ({_grid_sql(8)}) SELECT y, CAST(x // 32 AS INT) AS wx, {', '.join(f'{_plane(i, "(x % 32)")} AS p{i}' for i in range(3))} FROM g GROUP BY ALL")
_add("pack_bit_planes_64", _layout(layouts.to_bit_planes, 64), f"WITH g AS ({_grid_sql(8)}) SELECT y, CAST(x // 64 AS INT) AS wx, {', '.join(f'{_plane(i, "(x % 64)", True)} AS p{i}' for i in range(3))} FROM g GROUP BY ALL")
_add("pack_tiled", _layout(layouts.to_tiled_planes), f"WITH g AS ({_grid_sql(8)}) SELECT CAST(y // 4 AS INT) AS ty, CAST(x // 8 AS INT) AS tx, {', '.join(f'{_plane(i, "(x % 8 + (y % 4) * 8)")} AS p{i}' for i in range(3))} FROM g GROUP BY ALL")
for _n, _make in (("bit_array", layouts.to_bit_array), ("bit_planes", layouts.to_bit_planes), ("tiled", layouts.to_tiled_planes)):
    for _w in (32, 64):
        _add(f"roundtrip_{_n}_{_w}", _around_trip(_make, _w), _grid_sql(4))
_add("margins_add", lambda s, d: _grid(s, d, States.integers(3)).with_margins(3, 2).cells, f"WITH g AS ({_grid_sql(8)}) SELECT CAST(i % 70 AS INT) AS x, CAST(i // 70 AS INT) AS y, coalesce(s, 0) AS s FROM range({70 * 68}) r(i) LEFT JOIN g ON g.x = i % 70 - 3 AND g.y = i // 70 - 2")
_add("margins_remove", lambda s, d: _grid(s, d, States.integers(3)).without_margins(3, 2).cells, f"WITH g AS ({_grid_sql(8)}) SELECT CAST(x - 3 AS INT) AS x, CAST(y - 2 AS INT) AS y, s FROM g WHERE x BETWEEN 3 AND 60 AND y BETWEEN 2 AND 61")
_add("get_cell", lambda s, d: _grid(s, d, States.integers(3)).get_cell(17, 42), f"SELECT * FROM ({_grid_sql(8)}) WHERE x = 17 AND y = 42")
_add("get_cell_packed", lambda s, d: layouts.to_tiled_planes(_grid(s, d, States.integers(3)), 32).get_cell(17, 42), f"SELECT * FROM ({_grid_sql(8)}) WHERE x = 17 AND y = 42")
_add("tile_sums", lambda s, d: _grid(s, d, States.integers(3), 37, 29).tile_sums(), f"WITH g AS ({_grid_sql(8, 37, 29)}) SELECT CAST((y // 8) * 4 + x // 10 AS INT) AS tile, CAST(sum(s) AS BIGINT) AS sum FROM g GROUP BY 1")
_add(
    "checksum_4x4",
    lambda s, d: _grid(s, d, States.integers(3)).checksum(),
    f"WITH g AS ({_grid_sql(8)}), t AS (SELECT (y // 16) * 4 + x // 16 AS tile, sum(s) AS n FROM g GROUP BY 1) SELECT string_agg(CAST(n AS VARCHAR), '-' ORDER BY tile) AS checksum FROM t",
)
_add("state_histogram", lambda s, d: _grid(s, d, States.integers(3)).histogram(), f"SELECT s, count(*) AS cells FROM ({_grid_sql(8)}) GROUP BY s")
_add("source_rasterised", lambda s, d: _grid(s, d, States.integers(3)).cells, _grid_sql(8))


def _thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states that initial thresholds give to numbers made of each event's value."""
    from gridloom.sources.seeded import thresholds

    r = F.pmod(F.col("event_id") * 7919, F.lit(1000)) / 1000
    chain = None
    for state, limit in thresholds(AUTOMATA["excitable"].start):
        chain = F.when(r <= limit, state) if chain is None else chain.when(r <= limit, state)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", chain.otherwise(0).alias("state"))


def _threshold_sql() -> str:
    from itertools import accumulate

    limits = list(accumulate(p for _, p in AUTOMATA["excitable"].start))
    cases = " ".join(f"WHEN r <= CAST({v!r} AS DOUBLE) THEN {i}" for i, v in enumerate(limits))
    return f"SELECT event_id, CAST(CASE {cases} ELSE 0 END AS INT) AS state FROM (SELECT event_id, CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000 AS r FROM events)"


_add("init_thresholds", _thresholds, _threshold_sql())

# -- bit-sliced algebra: two grids in planes, an operation, and the lanes back as cells


def _lanes(make: Callable[[Lanes, Lanes], Lanes], bits: int = 3, word: int = 32) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = layouts.to_bit_planes(_grid(spark, sf_dir, States.integers(3)), word)
        b = layouts.to_bit_planes(_grid(spark, sf_dir, States.integers(3), keys=("l_suppkey", "l_orderkey")), word)
        rows = a.words.join(b.words.select("y", "wx", *[F.col(f"p{i}").alias(f"q{i}") for i in range(3)]), ["y", "wx"])
        left, right = (Lanes(tuple(F.col(f"{p}{i}") for i in range(3)), word) for p in "pq")
        out = make(left, right).resized(bits)
        words = rows.select("y", "wx", *[c.alias(f"p{i}") for i, c in enumerate(out.planes)])
        return layouts.Packed(words, "bit_planes", X, Y, States.integers(bits), word).unpacked().cells

    return query


def _lanes_sql(e: str) -> str:
    return f"WITH a AS ({_grid_sql(8)}), b AS ({_grid_sql(8, keys=('l_suppkey', 'l_orderkey'))}), ab AS (SELECT x, y, a.s AS p, b.s AS q FROM a JOIN b USING (x, y)) SELECT x, y, CAST({e} AS INT) AS s FROM ab"


def _moved_sql(to: str) -> str:
    """Lane values after a move within words of 32: ``to`` is the lane that lane l comes from."""
    return f"WITH a AS ({_grid_sql(8)}), m AS (SELECT x, y, x // 32 AS wx, {to} AS f FROM (SELECT *, x % 32 AS l FROM a)) SELECT m.x, m.y, CAST(coalesce(a.s, 0) AS INT) AS s FROM m LEFT JOIN a ON a.y = m.y AND f BETWEEN 0 AND 31 AND a.x = m.wx * 32 + f"


_mask = Lanes.of_mask
for _n, _f, _e, _bits in (
    ("vint_add", lambda a, b: a.plus(b), "(p + q) % 8", 3),
    ("vint_add_wide", lambda a, b: a.widened_plus(b), "p + q", 4),
    ("vint_or", lambda a, b: a.ored(b), "p | q", 3),
    ("vint_xor", lambda a, b: a.xored(b), "xor(p, q)", 3),
    ("vint_and", lambda a, b: a.anded(b), "p & q", 3),
    ("vint_and_const", lambda a, b: a.anded_constant(5), "p & 5", 3),
    ("vint_or_const", lambda a, b: a.ored_constant(5), "p | 5", 3),
    ("vint_xor_const", lambda a, b: a.xored_constant(5), "xor(p, 5)", 3),
    ("vint_not", lambda a, b: a.inverted(), "7 - p", 3),
    ("vint_mask", lambda a, b: a.masked(b.plane(0)), "CASE WHEN q % 2 = 1 THEN p ELSE 0 END", 3),
    ("vint_mask_const", lambda a, b: a.masked_constant(0xF0F0F0F5), "CASE WHEN (4042322165 >> (x % 32)) & 1 = 1 THEN p ELSE 0 END", 3),
    ("vint_resize", lambda a, b: a.resized(2), "p % 4", 2),
    ("vint_modulo", lambda a, b: a.modulo(4), "p % 4", 2),
    ("vint_modulo_3", lambda a, b: a.modulo(3), "p % 3", 2),
    ("vint_modulo_5", lambda a, b: a.modulo(5), "p % 5", 3),
    ("vint_eq", lambda a, b: _mask(a.equals(b)), "(p = q)::INT", 1),
    ("vint_ne", lambda a, b: _mask(a.differs(b)), "(p <> q)::INT", 1),
    ("vint_eq_const", lambda a, b: _mask(a.equals_constant(6)), "(p = 6)::INT", 1),
    ("vint_gt", lambda a, b: _mask(a.greater(b)), "(p > q)::INT", 1),
    ("vint_lt", lambda a, b: _mask(a.less(b)), "(p < q)::INT", 1),
    ("vint_get_bit", lambda a, b: _mask(a.plane(1)), "(p >> 1) & 1", 1),
    ("vint_from_constant", lambda a, b: Lanes.constant(5, 32).anded(a), "p & 5", 4),
    ("vint_choose", lambda a, b: a.chosen(b.plane(2), b), "CASE WHEN q >= 4 THEN p ELSE q END", 3),
    ("vint_set_at", lambda a, b: a.set_at(31, 6), "CASE WHEN x % 32 = 31 THEN 6 ELSE p END", 3),
):
    _add(_n, _lanes(_f, _bits), _lanes_sql(_e))
for _n, _f, _e in (
    ("vint_shift_right", lambda a, b: a.shifted_right(3), "l + 3"),
    ("vint_shift_left", lambda a, b: a.shifted_left(3), "l - 3"),
    ("vint_swap_pairs", lambda a, b: a.swapped_pairs(), "CASE WHEN l % 2 = 0 THEN l + 1 ELSE l - 1 END"),
    ("vint_swap_rows8", lambda a, b: a.swapped_rows_of_8(), "CASE WHEN l // 8 % 2 = 0 THEN l + 8 ELSE l - 8 END"),
):
    _add(_n, _lanes(_f), _moved_sql(_e))


def _get_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = layouts.to_bit_planes(_grid(spark, sf_dir, States.integers(3)), 64)
    return p.words.select("y", "wx", Lanes((F.col("p0"), F.col("p1"), F.col("p2")), 64).get_at(63).cast("int").alias("value"))


_add("vint_get_at", _get_at, f"SELECT y, 0 AS wx, s AS value FROM ({_grid_sql(8)}) WHERE x = 63")

# -- analytics over a results table that is made from orders

_NAMES = list(AUTOMATA)
_IMPL = list(results.IMPLEMENTATIONS.values())


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A results row for each order."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    impl, size = F.pmod(F.col("o_custkey"), F.lit(13)), F.pmod(F.floor(F.col("o_orderkey") / 10), F.lit(4))
    field = lambda k, empty: pick([i.get(k, empty) for i in _IMPL] + [empty], impl)
    off = F.pmod(F.col("o_orderkey"), F.lit(17))
    rows = o.select(
        F.col("o_orderkey").alias("run"),
        pick(_NAMES, F.pmod(F.col("o_orderkey") + F.col("o_custkey"), F.lit(10))).alias("automaton"),
        *[field(k, "").alias(k) for k in ("traverser", "evaluator", "layout", "reference_impl")],
        field("word_size", 0).cast("int").alias("word_size"),
        (pick(results.EDGES, size) - off).cast("int").alias("x_size"),
        F.when(off == 16, F.lit(5000)).otherwise(pick(results.EDGES, size)).cast("int").alias("y_size"),
        pick(results.STEPS, size).cast("int").alias("steps"),
        pick((*results.TEMPORAL_STEPS, 99), F.pmod(F.col("o_orderkey"), F.lit(18))).cast("int").alias("temporal_steps"),
        (F.col("o_totalprice") / 1000 + 1).alias("average_time_ms"),
    )
    return rows


def _case(values: list[object] | tuple[object, ...], i: str) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + f"][CAST({i} AS INT) + 1]"


_FIELDS = ", ".join(f"{_case([i.get(k, '') for i in _IMPL] + [''], 'o_custkey % 13')} AS {k}" for k in ("traverser", "evaluator", "layout", "reference_impl"))
_RESULTS_SQL = f"""res AS (SELECT o_orderkey AS run, {_case(_NAMES, "(o_orderkey + o_custkey) % 10")} AS automaton, {_FIELDS},
  CAST({_case([i.get("word_size", 0) for i in _IMPL] + [0], "o_custkey % 13")} AS INT) AS word_size,
  CAST({_case(results.EDGES, "(o_orderkey // 10) % 4")} - o_orderkey % 17 AS INT) AS x_size,
  CAST(CASE WHEN o_orderkey % 17 = 16 THEN 5000 ELSE {_case(results.EDGES, "(o_orderkey // 10) % 4")} END AS INT) AS y_size,
  CAST({_case(results.STEPS, "(o_orderkey // 10) % 4")} AS INT) AS steps,
  CAST({_case((*results.TEMPORAL_STEPS, 99), "o_orderkey % 18")} AS INT) AS temporal_steps,
  o_totalprice / 1000 + 1 AS average_time_ms FROM orders)"""
_BUCKET_SQL = "CASE " + " ".join(f"WHEN abs(CAST(x_size AS BIGINT) * y_size - {e * e}) <= 0.1 * {e * e} THEN CAST({e * e} AS BIGINT)" for e in results.EDGES) + " END"
_IMPL_SQL = "CASE " + " ".join("WHEN " + " AND ".join(f"{k} = {v!r}" for k, v in f.items()) + f" THEN '{n}'" for n, f in results.IMPLEMENTATIONS.items()) + " END"
_PREP_SQL = f"""WITH {_RESULTS_SQL}, prep AS (SELECT * FROM (SELECT *, {_BUCKET_SQL} AS bucket, {_IMPL_SQL} AS impl,
  average_time_ms / (CAST(steps AS BIGINT) * x_size * y_size) * 1e9 AS ps FROM res) WHERE bucket IS NOT NULL AND impl IS NOT NULL),
  tops AS (SELECT * FROM prep QUALIFY row_number() OVER (PARTITION BY bucket, automaton, impl ORDER BY ps, run) = 1),
  sp AS (SELECT tops.bucket, tops.automaton, tops.impl, tops.ps, b.ps / tops.ps AS speedup FROM tops JOIN tops b ON b.bucket = tops.bucket AND b.automaton = tops.automaton AND b.impl = 'Baseline')"""
_LISTED_SQL = f"list_position({list(results.IMPLEMENTATIONS)}, impl)"
_FAMILY_SQL = "CASE " + " ".join(f"WHEN impl IN ({', '.join(repr(n) for n in names)}) THEN '{f}'" for f, names in results.FAMILIES.items()) + " END"


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


def _prep(s: SparkSession, d: str) -> DataFrame:
    return results.prepared(_results(s, d))


_KEYS = ["bucket", "automaton", "impl"]
_add("res_size_bucket", lambda s, d: _results(s, d).select("run", results.size_bucket(tuple(e * e for e in results.EDGES)).alias("bucket")), f"WITH {_RESULTS_SQL} SELECT run, {_BUCKET_SQL} AS bucket FROM res")
_add("res_classify", lambda s, d: _results(s, d).select("run", results.implementation().alias("impl")), f"WITH {_RESULTS_SQL} SELECT run, {_IMPL_SQL} AS impl FROM res")
_add("res_group", lambda s, d: _prep(s, d).groupBy("automaton").agg(F.count(F.lit(1)).alias("runs")), f"{_PREP_SQL} SELECT automaton, count(*) AS runs FROM prep GROUP BY 1")
_add("res_normalised", lambda s, d: _round(_prep(s, d).select("run", "ps"), "ps"), f"{_PREP_SQL} SELECT run, round(ps, 9) AS ps FROM prep")
_add("res_throughput", lambda s, d: _round(_prep(s, d).select("run", results.throughput(F.col("ps")).alias("updates")), "updates"), f"{_PREP_SQL} SELECT run, round(1 / ps, 9) AS updates FROM prep")
_add("res_best", lambda s, d: _round(results.best(_prep(s, d).select(*_KEYS, "ps", "run"), _KEYS, ["run"]), "ps"), f"{_PREP_SQL} SELECT bucket, automaton, impl, round(ps, 9) AS ps, run FROM tops")
_add(
    "res_sorted_runs",
    lambda s, d: _round(results.sorted_runs(_prep(s, d), _KEYS, ["run"]).select(*_KEYS, "run", "rank", "ratio"), "ratio"),
    f"{_PREP_SQL} SELECT bucket, automaton, impl, run, CAST(row_number() OVER (PARTITION BY bucket, automaton, impl ORDER BY ps, run) AS INT) AS rank, round(ps / min(ps) OVER (PARTITION BY bucket, automaton, impl), 9) AS ratio FROM prep",
)
_add("res_speedup", lambda s, d: _round(results.speedups(_prep(s, d), ["run"]), "ps", "speedup"), f"{_PREP_SQL} SELECT bucket, automaton, impl, round(ps, 9) AS ps, round(speedup, 9) AS speedup FROM sp")
_add(
    "res_speedup_table",
    lambda s, d: _round(results.speedup_table(_prep(s, d), ["run"]), *results.IMPLEMENTATIONS),
    f"{_PREP_SQL} SELECT bucket, automaton, " + ", ".join(f"round(max(speedup) FILTER (impl = '{n}'), 9) AS \"{n}\"" for n in results.IMPLEMENTATIONS) + " FROM sp GROUP BY 1, 2",
)
_add(
    "res_top3",
    lambda s, d: results.ranked(_prep(s, d), ["run"]).select("bucket", "automaton", "impl", "place"),
    f"{_PREP_SQL} SELECT bucket, automaton, impl, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY bucket, automaton ORDER BY speedup DESC, {_LISTED_SQL}) AS place FROM sp) WHERE place <= 3",
)
_add("res_family_best", lambda s, d: _round(results.family_best(_prep(s, d)), "ps"), f"{_PREP_SQL} SELECT bucket, automaton, family, round(min(ps), 9) AS ps FROM (SELECT *, {_FAMILY_SQL} AS family FROM prep) WHERE family IS NOT NULL GROUP BY 1, 2, 3")
_SERIES_SQL = f"""{_PREP_SQL}, lay AS (SELECT bucket, automaton, layout, CASE WHEN traverser = 'simple' THEN 1 ELSE temporal_steps END AS temporal_steps, min(ps) AS ps
  FROM prep WHERE layout IN ('bit_planes', 'tiled_bit_planes') AND impl <> 'Baseline' GROUP BY ALL),
  base AS (SELECT bucket, automaton, layout, ps AS base FROM lay WHERE temporal_steps = 1),
  series AS (SELECT w.bucket, w.automaton, w.layout, CAST(w.ts AS INT) AS temporal_steps, lay.ps, base / lay.ps AS speedup
    FROM (SELECT *, unnest([1, {", ".join(map(str, results.TEMPORAL_STEPS))}]) AS ts FROM base) w
    LEFT JOIN lay ON lay.bucket = w.bucket AND lay.automaton = w.automaton AND lay.layout = w.layout AND lay.temporal_steps = w.ts)"""
_add("res_timesteps", lambda s, d: _round(results.time_steps(_prep(s, d)), "ps", "speedup"), f"{_SERIES_SQL} SELECT bucket, automaton, layout, temporal_steps, round(ps, 9) AS ps, round(speedup, 9) AS speedup FROM series")
_LAYOUT_KEYS = ["bucket", "automaton", "layout"]
_add(
    "res_gaps",
    lambda s, d: results.gap_segments(results.time_steps(_prep(s, d)), _LAYOUT_KEYS, "temporal_steps", "ps"),
    f"""{_SERIES_SQL}, cut AS (SELECT *, sum((ps IS NULL)::INT) OVER (PARTITION BY bucket, automaton, layout ORDER BY temporal_steps) AS k FROM series),
    seg AS (SELECT bucket, automaton, layout, k, min(temporal_steps) AS first, max(temporal_steps) AS last, count(*) AS points FROM cut WHERE ps IS NOT NULL GROUP BY 1, 2, 3, 4)
    SELECT bucket, automaton, layout, first, last, points, CAST(row_number() OVER (PARTITION BY bucket, automaton, layout ORDER BY k) AS INT) AS segment FROM seg""",
)


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as rounds of a run."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rounds = o.select("o_custkey", F.lit(64).alias("x_size"), F.lit(32).alias("y_size"), F.lit(8).alias("steps"), F.floor("o_totalprice").cast("double").alias("time_ms"), F.col("o_orderstatus").alias("checksum"))
    return results.report(rounds, ["o_custkey"]).withColumn("std_time_ms", F.round("std_time_ms", 3))


_add(
    "res_report",
    _report,
    """SELECT o_custkey, avg(t) AS average_time_ms, round(stddev_pop(t), 3) AS std_time_ms,
    avg(t) * CAST(1e9 AS DOUBLE) / CAST(2048 AS DOUBLE) / 8 AS average_time_per_cell_ps, count(DISTINCT o_orderstatus) = 1 AS rounds_had_same_checksums
    FROM (SELECT *, floor(o_totalprice) AS t FROM orders) GROUP BY 1""",
)


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.sweep(spark, {n: a.states.bits for n, a in AUTOMATA.items()}).groupBy("automaton", "impl").agg(F.count(F.lit(1)).alias("runs"))


def _sweep_sql() -> str:
    bits = ", ".join(f"('{n}', {a.states.bits})" for n, a in AUTOMATA.items())
    listed = lambda v: ", ".join(map(str, v))
    return f"""WITH a(automaton, bits) AS (VALUES {bits}), tiles AS (SELECT word, bits, CAST(2 ** floor(log2(49152 / (2 * bits * word / 8 * 32))) AS INT) AS tile FROM (SELECT unnest([{listed(results.WORDS)}]) AS word), (SELECT unnest(range(1, 6)) AS bits)),
    y AS (SELECT unnest([{listed(results.Y_BLOCKS)}]) AS yb), w AS (SELECT unnest([{listed(results.WORDS)}]) AS word), s AS (SELECT unnest([{listed(results.TEMPORAL_STEPS)}]) AS ts),
    timed AS (SELECT automaton, word, yb, ts, tile, CAST(ceil(ts * 0.999) AS INT) AS halo FROM (SELECT * FROM a, y, w, s) JOIN tiles USING (word, bits) WHERE tile >= yb AND tile % yb = 0),
    r AS (SELECT automaton, unnest(['Baseline', 'Standard']) AS impl FROM a, y
      UNION ALL SELECT automaton, unnest(['Bit Array', 'Bit Planes', 'Tiled BP']) || ' (' || word || '-bit)' FROM a, y, w
      UNION ALL SELECT automaton, 'Temporal Linear (' || word || '-bit)' FROM timed WHERE tile - 2 * halo > 0
      UNION ALL SELECT automaton, 'Temporal Tiled (' || word || '-bit)' FROM timed WHERE tile - 2 * ((halo + word // 8 - 1) // (word // 8)) > 0)
    SELECT automaton, impl, count(*) AS runs FROM r GROUP BY 1, 2"""


_add("res_sweep", _sweep, _sweep_sql())


def _verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checksum of the same run by each strategy."""
    a = AUTOMATA["wire"]
    grid, out = _grid(spark, sf_dir, a.states), None
    for strategy in STRATEGIES:
        one = run(grid, a.rule, 4, strategy).checksum().select(F.lit(strategy).alias("strategy"), "checksum")
        out = one if out is None else out.unionByName(one)
    return out


def _checksum_sql(cells: str, x: int = X, y: int = Y) -> str:
    return f"""SELECT string_agg(CAST(total AS VARCHAR), '-' ORDER BY tile) AS checksum FROM (
      SELECT tile, coalesce(sum(s), 0) AS total FROM range(16) AS k(tile) LEFT JOIN ({cells}) ON tile = y // {-(-y // 4)} * 4 + x // {-(-x // 4)} GROUP BY tile)"""


_add("verify_strategies", _verify, f"SELECT strategy, checksum FROM (SELECT unnest({list(STRATEGIES)}) AS strategy), ({_checksum_sql(_run_sql(_RULES['wire'][1], 4, 4))})")

# -- grids of words from end to end


def _words(name: str, steps: int, x: int = 192, y: int = 70) -> Query:
    from gridloom.plans import words

    a = AUTOMATA[name]
    return lambda s, d: run(words.from_grid(_grid(s, d, a.states, x, y), 64), a.rule, steps).checksum()


for _name in ("game-of-life", "forest-fire", "critters", "traffic"):
    _k, _rule = _RULES[_name]
    _add(f"words_{_name.replace('-', '_')}_t9", _words(_name, 9), _checksum_sql(_run_sql(_rule, _k, 9, 192, 70), 192, 70))


def _words_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.plans import words

    return words.from_grid(_grid(spark, sf_dir, States.integers(3), 192, 70), 64).histogram()


_add("words_histogram", _words_histogram, f"SELECT s, count(*) AS cells FROM ({_grid_sql(8, 192, 70)}) GROUP BY s")

# -- stored grids


def _stored(spark: SparkSession, sf_dir: str, *steps: int) -> list[str]:
    """New folders with the game of life after each number of steps."""
    from uuid import uuid4

    from gridloom.plans import words
    from gridloom.plans.lineage import shared_dir
    from gridloom.sources import stored

    a, paths = AUTOMATA["game-of-life"], []
    for k in steps:
        paths.append(f"{shared_dir(spark)}/grids-{uuid4().hex}")
        stored.write(run(words.from_grid(_grid(spark, sf_dir, a.states, 192, 70), 64), a.rule, k), paths[-1])
    return paths


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.sources import stored

    return stored.changed_cells(spark, *_stored(spark, sf_dir, 3, 5))


def _window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.sources import stored

    return stored.window(spark, *_stored(spark, sf_dir, 3), 60, 10, 140, 66)


_LIFE3, _LIFE5 = (_run_sql(_RULES["game-of-life"][1], 2, k, 192, 70) for k in (3, 5))
_add("stored_changed_cells", _changed, f'SELECT a.x, a.y, a.s AS "left", b.s AS "right" FROM ({_LIFE3}) AS a JOIN ({_LIFE5}) AS b ON a.x = b.x AND a.y = b.y AND a.s <> b.s')
_add("stored_window", _window, f"SELECT x, y, s FROM ({_LIFE3}) WHERE x >= 60 AND x < 140 AND y >= 10 AND y < 66")

# -- what is left of the engine that SQL can say: rendering, sizes, explicit cells, sweeps' arithmetic, files

_add(
    "grid_lines",
    lambda s, d: _grid(s, d, AUTOMATA["game-of-life"].states).lines(),
    f"SELECT y, string_agg(line, ' ' ORDER BY k) AS line FROM (SELECT y, x // 8 AS k, string_agg(CASE s WHEN 1 THEN '#' ELSE '.' END, '' ORDER BY x) AS line FROM ({_grid_sql(2)}) GROUP BY 1, 2) GROUP BY y",
)


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _grid(spark, sf_dir, States.integers(3), 96, 64)
    packed = [layouts.to_bit_planes(grid, 32), layouts.to_tiled_planes(grid, 32), layouts.to_tiled_planes(grid, 64)]
    rows = [(p.kind, p.word, *p.logical_size, *p.physical_size, p.bytes) for p in packed]
    return spark.createDataFrame(rows, "kind string, word int, width int, height int, words_x int, words_y int, bytes long")


_add(
    "layout_sizes",
    _sizes,
    """SELECT kind, CAST(word AS INT) AS word, CAST(96 AS INT) AS width, CAST(64 AS INT) AS height, CAST(96 // tx AS INT) AS words_x, CAST(64 // ty AS INT) AS words_y, CAST((96 // tx) * (64 // ty) * word // 8 * 3 AS BIGINT) AS bytes
    FROM (VALUES ('bit_planes', 32, 32, 1), ('tiled', 32, 8, 4), ('tiled', 64, 8, 8)) AS v(kind, word, tx, ty)""",
)


def _explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations' regions as literal rows of a grid."""
    held = sorted((r.n_nationkey, r.n_regionkey) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey").collect())
    return from_values(spark, [[r for _, r in held[i : i + 5]] for i in range(0, len(held), 5)], States.integers(3)).checked().cells


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a segment, a rectangle or a circle on a wire grid."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    key, cust = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
    x, y, w, h = key % 256, cust % 256, cust % 41 - 20, key % 23 - 11
    state, layer = (cust % 3 + 1).cast("int"), key % 101
    made = F.when(key % 3 == 0, segment(x, y, x + w, y + h, state, layer)).when(key % 3 == 1, rectangle(x, y, x + w, y + h, state, layer))
    made = made.otherwise(circle(x, y, cust % 12, state, layer))
    return shapes_grid(o.select(made.alias("shape")).select("shape.*"), 256, 256, AUTOMATA["wire"].states).cells


_SHAPES_SQL = """
WITH o AS (SELECT o_orderkey % 256 AS x, o_custkey % 256 AS y, o_custkey % 41 - 20 AS w, o_orderkey % 23 - 11 AS h, o_custkey % 12 AS r,
           o_custkey % 3 + 1 AS state, o_orderkey % 101 AS layer, o_orderkey % 3 AS kind FROM orders),
sides AS (SELECT x, y, w AS dx, h AS dy, state, layer FROM o WHERE kind = 0
          UNION ALL SELECT x, y, w, 0, state, layer FROM o WHERE kind = 1
          UNION ALL SELECT x + w, y, 0, h, state, layer FROM o WHERE kind = 1
          UNION ALL SELECT x + w, y + h, -w, 0, state, layer FROM o WHERE kind = 1
          UNION ALL SELECT x, y + h, 0, -h, state, layer FROM o WHERE kind = 1),
steps AS (SELECT *, greatest(abs(dx), abs(dy)) AS n FROM sides),
cells AS (SELECT x + CAST(floor(dx * i / greatest(n, 1)::DOUBLE + 0.5) AS BIGINT) AS x, y + CAST(floor(dy * i / greatest(n, 1)::DOUBLE + 0.5) AS BIGINT) AS y, state, layer
          FROM steps JOIN range(21) AS t(i) ON i <= n
          UNION ALL
          SELECT x + a, y + b, state, layer FROM o, range(-11, 12) AS p(a), range(-11, 12) AS q(b)
          WHERE kind = 2 AND floor(sqrt(a * a + b * b) + 0.5) = r),
seen AS (SELECT (x % 256 + 256) % 256 AS x, (y % 256 + 256) % 256 AS y, max(layer * 4 + state) % 4 AS s FROM cells GROUP BY 1, 2)
SELECT CAST(i % 256 AS INT) AS x, CAST(i // 256 AS INT) AS y, CAST(coalesce(s, 0) AS INT) AS s FROM range(65536) AS g(i) LEFT JOIN seen ON i % 256 = x AND i // 256 = y"""
_add("source_shapes", _shapes, _SHAPES_SQL)
_add("source_explicit", _explicit, "SELECT CAST(i % 5 AS INT) AS x, CAST(i // 5 AS INT) AS y, CAST(n_regionkey AS INT) AS s FROM (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i, n_regionkey FROM nation)")


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(t, s, c, results.effective_tile(t, s, c)) for t in (8, 16, 32, 64, 128) for s in results.TEMPORAL_STEPS for c in (1, 4, 8)]
    return spark.createDataFrame(rows, "tile int, steps int, cells int, rest int")


_add(
    "res_effective_tile",
    _tiles,
    f"SELECT CAST(t AS INT) AS tile, CAST(s AS INT) AS steps, CAST(c AS INT) AS cells, CAST(t - 2 * ((CAST(ceil(s * 0.999) AS INT) + c - 1) // c) AS INT) AS rest FROM (SELECT unnest([8, 16, 32, 64, 128]) AS t), (SELECT unnest({list(results.TEMPORAL_STEPS)}) AS s), (SELECT unnest([1, 4, 8]) AS c)",
)


def _fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [r[0] for r in spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey").collect()]
    return spark.createDataFrame([(k, *results.fitted_size(10_000 + 977 * k, 32, 8)) for k in keys], "s_suppkey long, x int, y int")


_add(
    "res_fitted_size",
    _fitted,
    "SELECT s_suppkey, CAST(x AS INT) AS x, CAST(n // x - (n // x) % 8 AS INT) AS y FROM (SELECT *, CAST(floor(sqrt(n)) AS BIGINT) // 32 * 32 AS x FROM (SELECT s_suppkey, 10000 + 977 * s_suppkey AS n FROM supplier))",
)
_add("source_two_states", lambda s, d: s.createDataFrame([(i, float(p)) for i, p in two_states(1, 0.25, 0)], "state int, probability double"), "SELECT CAST(i AS INT) AS state, CAST(p AS DOUBLE) AS probability FROM (VALUES (1, 0.25), (0, 0.75)) AS v(i, p)")


def _checked_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as results whose checksum is the ship priority's and status' text; every third is a baseline."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = o.select(
        F.col("o_orderkey").alias("run"), F.lit("maze").alias("automaton"), F.pmod("o_custkey", F.lit(7)).cast("int").alias("x_size"), F.lit(8).alias("y_size"), F.lit(4).alias("steps"), F.lit(1).alias("seed"),
        F.when(F.pmod("o_orderkey", F.lit(3)) == 0, "baseline").otherwise("").alias("reference_impl"), F.pmod(F.floor(F.col("o_custkey") / 7), F.lit(2)).cast("string").alias("checksum"),
    )
    return results.checksums_differ(rows).select("run", "x_size", "checksum")


_add(
    "res_checksums_differ",
    _checked_sums,
    """WITH r AS (SELECT o_orderkey AS run, CAST(o_custkey % 7 AS INT) AS x_size, o_orderkey % 3 = 0 AS base, CAST(o_custkey // 7 % 2 AS VARCHAR) AS checksum FROM orders)
    SELECT run, r.x_size, checksum FROM r JOIN (SELECT x_size, min(checksum) AS a, max(checksum) AS b FROM r WHERE base GROUP BY 1) m ON r.x_size = m.x_size WHERE checksum <> a OR a <> b""",
)
