"""Neighbour exchange: every cell gets the states around it in one shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import rules as R
from gridloom.functions.columns import name, to_column
from gridloom.operators.grid import Grid


def offsets_of(rule: R.Node) -> set[tuple[int, int]]:
    """The offsets that a rule reads through nodes other than counts of constants."""
    out: set[tuple[int, int]] = set()
    for n in rule.walk():
        match n:
            case R.Neighbor(dx, dy):
                out.add((dx, dy))
            case R.Opposite() | R.Count(hood=R.MARGOLUS) | R.Exists(hood=R.MARGOLUS):
                out |= {(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)}
            case R.Count(value, hood) | R.Exists(value, hood) if not _constant(value):
                out |= set(R.OFFSETS[hood])
    return out | {(0, 0)}


def _constant(node: R.Node) -> bool:
    return isinstance(node, (R.Const, R.State))


def counted(rule: R.Node) -> dict[object, R.Node]:
    """The counts that one aggregation gives without a column for each neighbour."""
    return {R.key(n): n for n in rule.walk() if isinstance(n, (R.Count, R.Exists)) and n.hood != R.MARGOLUS and _constant(n.value)}


def _spread(grid: Grid, offsets: set[tuple[int, int]]) -> DataFrame:
    """A row for each cell and offset, at the cell that sees it there; offsets that meet on a small torus stay separate rows."""
    at = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in sorted(offsets)])
    rows = grid.cells.select(F.col("x").alias("_x"), F.col("y").alias("_y"), "s", F.inline(at))
    return rows.select(F.pmod(F.col("_x") - F.col("dx"), F.lit(grid.width)).alias("x"), F.pmod(F.col("_y") - F.col("dy"), F.lit(grid.height)).alias("y"), "dx", "dy", "s")


def _here(offsets: list[tuple[int, int]] | tuple[tuple[int, int], ...]) -> Column:
    return reduce(lambda a, b: a | b, [(F.col("dx") == dx) & (F.col("dy") == dy) for dx, dy in offsets])


def scatter(grid: Grid, rule: R.Node) -> tuple[DataFrame, dict[object, str]]:
    """(x, y, n_.. for each offset read, c.. for each count) and the columns of the counts.

    Counts of constants are sums, which the map side of the shuffle makes smaller; only states read as such become columns.
    """
    counts = counted(rule)
    single = offsets_of(rule)
    every = single | {o for n in counts.values() for o in R.OFFSETS[n.hood]}
    names = {k: f"c{i}" for i, k in enumerate(counts)}
    aggs = [F.max(F.when(_here([o]), F.col("s"))).alias(name(*o)) for o in sorted(single)]
    for k, n in counts.items():
        hit = _here(R.OFFSETS[n.hood]) & (F.col("s") == (n.value.ordinal if isinstance(n.value, R.State) else n.value.value))
        aggs.append((F.max(hit) if isinstance(n, R.Exists) else F.sum(F.when(hit, 1).otherwise(0)).cast("int")).alias(names[k]))
    return _spread(grid, every).groupBy("x", "y").agg(*aggs), names


def gather(grid: Grid, offsets: list[tuple[int, int]]) -> DataFrame:
    """(x, y, n_.. for each offset) by one equi-join for each; for few offsets or a single step, as plans grow with every join."""
    out = grid.cells.select("x", "y", F.col("s").alias(name(0, 0)))
    for dx, dy in offsets:
        if (dx, dy) == (0, 0):
            continue
        seen = grid.cells.select(F.pmod(F.col("x") - dx, F.lit(grid.width)).alias("x"), F.pmod(F.col("y") - dy, F.lit(grid.height)).alias("y"), F.col("s").alias(name(dx, dy)))
        out = out.join(seen, ["x", "y"])
    return out


def evaluated(grid: Grid, rule: R.Node, t: int = 0, alias: str = "s") -> DataFrame:
    """(x, y, the rule's value) of every cell, for a rule without alternatives."""
    rows, counts = scatter(grid, rule)
    return rows.select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), to_column(rule, t, counts).alias(alias))
