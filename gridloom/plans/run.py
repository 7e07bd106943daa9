"""Running an automaton for some generations by one of several strategies, all with the same results.

* ``cells``: one neighbour exchange a generation, all of it in Catalyst;
* ``bit_array``: the same on words that hold several cells, each cell by itself;
* ``planes``: the same on bit planes, 32 or 64 cells a word, in bitwise column expressions;
* ``tiled``: the same on planes of 8-wide tiles;
* ``blocked``: planes in bands of rows, of which only edge rows are exchanged (spatial blocking), in column expressions;
* ``tiles``: blocks of tiles with halos of tiles that advance several generations between shuffles, in NumPy;
* ``strips``: blocks of cells with halos that advance several generations between shuffles (temporal blocking), in NumPy. On a ``WordGrid``, and
  where a grid's width and the rule allow it, blocks are bit planes from beginning to end;
* ``auto``: strips where the rule allows it, else cells.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from gridloom.functions import rules as R
from gridloom.functions.planes import compiles
from gridloom.operators.grid import Grid
from gridloom.operators.neighbors import evaluated
from gridloom.plans import bands, blocks, planes, tiles, words
from gridloom.plans.lineage import cut
from gridloom.plans.rewrite import optimised

#: Generations between lineage cuts of plans that shuffle once a generation.
CUT_EVERY = 4
STRATEGIES = ("cells", "bit_array", "planes", "tiled", "blocked", "tiles", "strips")


@dataclass(frozen=True)
class Automaton:
    """A rule with its states; ``radius`` is how far it reads."""

    name: str
    rule: R.Node
    states: object
    radius: int = 1


def step(grid: Grid, rule: R.Node, t: int = 0) -> Grid:
    """One generation in Catalyst."""
    return grid.with_cells(evaluated(grid, optimised(rule, t), t))


def run(
    grid: Grid | words.WordGrid, rule: R.Node, steps: int, strategy: str = "auto", first: int = 0, block: int = 0, temporal_steps: int = 0, word: int = 32,
    on_step: Callable[[int, DataFrame], None] | None = None,
) -> Grid | words.WordGrid:
    """The grid after ``steps`` generations, the first being step ``first``.

    ``on_step`` is called once with each generation's cells and makes every strategy stop at each of them. ``block`` is the edge of
    a block and ``temporal_steps`` the generations between exchanges, 0 to choose them by the grid's size; ``word`` is the width of plane words.
    """
    if steps < 0:
        raise ValueError("the number of steps is negative")
    reach = R.reach(rule)
    if strategy == "auto":
        strategy = "cells" if reach > min(grid.width, grid.height) else "strips"
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    if isinstance(grid, words.WordGrid):
        if strategy != "strips" or on_step or not compiles(rule, grid.states):
            raise ValueError("grids of words run as strips, by rules that planes can hold, without a callback")
        return words.run(grid, rule, steps, first, temporal_steps)
    if on_step:
        for t in range(first, first + steps):
            grid = run(grid, rule, 1, strategy, t, block, temporal_steps, word)
            grid = grid.with_cells(cut(grid.cells))
            on_step(t, grid.cells)
        return grid
    if strategy == "strips":
        fits = grid.width % words.LANES == 0 and block % words.LANES == 0 and max(temporal_steps, 1) * reach <= min(words.DEPTH, grid.height, block or words.DEPTH)
        if steps and fits and compiles(rule, grid.states):
            return words.run(words.from_grid(grid, block), rule, steps, first, temporal_steps).grid()
        return blocks.run(grid, rule, steps, first, block, temporal_steps)
    if strategy == "blocked":
        return bands.run(grid, rule, steps, first, word, block)
    if strategy == "tiles":
        return tiles.run(tiles.from_grid(grid, word, block), rule, steps, first, temporal_steps).grid()
    if strategy in ("bit_array", "planes", "tiled"):
        return planes.run(grid, rule, steps, first, word, "bit_planes" if strategy == "planes" else strategy)
    for k in range(steps):
        grid = step(grid, rule, first + k)
        if (k + 1) % CUT_EVERY == 0 and k + 1 < steps:
            grid = grid.with_cells(cut(grid.cells))
    return grid
