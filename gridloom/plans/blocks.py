"""Temporal blocking: blocks of cells with halos that advance several generations between shuffles.

A grid becomes rows (by, bx, cells) of one binary block each. In a round every block sends its edges, T cells deep, to the blocks
around it; a block with its halo advances T generations by itself, on bit planes where the rule allows it, its halo shrinking by one ring each, and sends its new edges in the same
task. So a round of T generations is one shuffle of whole blocks, where one of cells would be nine rows a cell a generation.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.functions import rules as R
from gridloom.functions.arrays import advance
from gridloom.functions.planes import advance_planes, compiles
from gridloom.operators.grid import Grid
from gridloom.plans.lineage import cut

#: Edge of a block at most: 1 MB of one-byte states.
EDGE = 1024
#: Generations between exchanges at most, and at most this share of a block's edge unless told otherwise.
DEPTH, SHARE = 32, 8
#: Rounds between lineage cuts.
CUT_EVERY = 8
PIECE = "by int, bx int, dy int, dx int, rows int, cells binary"


def _dtype(states: tuple[int, ...]) -> str:
    """Sums and remainders of two states, and counts, fit."""
    top = max(*states, 16)
    return "i1" if top < 63 else "i2" if top < 16_000 else "i4"


def edges(size: int, block: int) -> list[int]:
    """Where blocks begin, and the size: blocks of nearly equal length, of at most ``block``."""
    n = -(-size // block)
    return [size * i // n for i in range(n + 1)]


def plan(grid: Grid, block: int, depth: int, steps: int, reach: int = 1) -> tuple[list[int], list[int], int]:
    """Edges of the blocks in y and x, and the generations between exchanges, whose halo no block may be shorter than."""
    if block <= 0:
        # Enough blocks to keep a cluster's cores busy while they are large against their halos.
        block = EDGE
        cores = grid.cells.sparkSession.sparkContext.defaultParallelism
        while block > 128 and -(-grid.width // block) * -(-grid.height // block) < 2 * cores:
            block //= 2
        block = max(block, 2 * reach)
    ys, xs = edges(grid.height, block), edges(grid.width, block)
    least = min(b - a for e in (ys, xs) for a, b in zip(e, e[1:]))
    depth = min(depth or min(DEPTH, max(1, least // SHARE // reach)), max(1, steps), least // reach)
    if not depth:
        raise ValueError(f"the rule reads {reach} cells far, further than a block of {least}")
    return ys, xs, depth


#: Cells that a task gathers before it deals them to blocks.
GATHERED = 1 << 20


def to_blocks(grid: Grid, ys: list[int], xs: list[int], dtype: str) -> DataFrame:
    """(by, bx, cells): each block's cells row after row.

    Tasks first pack their own cells by block, so that what is shuffled and sorted is a few binary rows instead of a row a cell.
    """
    nx = len(xs) - 1

    def parts(batches):  # noqa: ANN001, ANN202
        import numpy as np

        low, left = np.array(ys), np.array(xs)

        def dealt(held: list) -> pa.RecordBatch:
            x, y, s = (np.concatenate(c).astype("i8") for c in zip(*held))
            by, bx = np.searchsorted(low, y, "right") - 1, np.searchsorted(left, x, "right") - 1
            place = ((y - low[by]) * (left[bx + 1] - left[bx]) + x - left[bx]).astype("i4")
            block = by * nx + bx
            order = np.argsort(block, kind="stable")
            block, place, s = block[order], place[order], s[order].astype(dtype)
            cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
            each = list(zip(cuts, cuts[1:]))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([int(block[i]) // nx for i, _ in each], pa.int32()),
                    pa.array([int(block[i]) % nx for i, _ in each], pa.int32()),
                    pa.array([place[i:j].tobytes() for i, j in each], pa.binary()),
                    pa.array([s[i:j].tobytes() for i, j in each], pa.binary()),
                ],
                names=["by", "bx", "places", "states"],
            )

        held, n = [], 0
        for batch in batches:
            held.append([np.asarray(batch.column(i)) for i in range(3)])
            n += batch.num_rows
            if n >= GATHERED:
                yield dealt(held)
                held, n = [], 0
        if n:
            yield dealt(held)

    def pack(table: pa.Table) -> pa.Table:
        import numpy as np

        by, bx = table["by"][0].as_py(), table["bx"][0].as_py()
        out = np.zeros((ys[by + 1] - ys[by]) * (xs[bx + 1] - xs[bx]), dtype)
        given = np.zeros(len(out), "i4")
        for places, states in zip(table["places"].to_pylist(), table["states"].to_pylist()):
            at = np.frombuffer(places, "i4")
            out[at] = np.frombuffer(states, dtype)
            np.add.at(given, at, 1)
        if (given != 1).any():
            raise ValueError(f"block ({by}, {bx}) lacks {int((given == 0).sum())} cells, and {int((given > 1).sum())} are given more than once")
        return pa.table({"by": pa.array([by], pa.int32()), "bx": pa.array([bx], pa.int32()), "cells": pa.array([out.tobytes()], pa.binary())})

    rows = grid.cells.select("x", "y", "s").mapInArrow(parts, "by int, bx int, places binary, states binary")
    return rows.groupBy("by", "bx").applyInArrow(pack, "by int, bx int, cells binary")


def from_blocks(blocks: DataFrame, ys: list[int], xs: list[int], dtype: str) -> DataFrame:
    """The cells of blocks."""

    def unpack(batches):  # noqa: ANN001, ANN202
        import numpy as np

        for batch in batches:
            for by, bx, raw in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                h, w = ys[by + 1] - ys[by], xs[bx + 1] - xs[bx]
                for a in range(0, h, 64):
                    part = np.frombuffer(raw, dtype).reshape(h, w)[a : a + 64]
                    n = len(part)
                    x = np.tile(np.arange(xs[bx], xs[bx + 1], dtype="i4"), n)
                    y = np.repeat(np.arange(ys[by] + a, ys[by] + a + n, dtype="i4"), w)
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(part.reshape(-1).astype("i4"))], names=["x", "y", "s"])

    return blocks.select("by", "bx", "cells").mapInArrow(unpack, "x int, y int, s int")


def _split(cells, by: int, bx: int, ny: int, nx: int, depth: int) -> list[tuple]:  # noqa: ANN001
    """The block itself, and the edges that the eight blocks around it need."""
    cut_of = {-1: slice(0, depth), 0: slice(None), 1: slice(-depth, None)}
    out = []
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            part = cells[cut_of[dy], cut_of[dx]]
            # What is on this block's dy side is on the -dy side of the block there.
            out.append(((by + dy) % ny, (bx + dx) % nx, -dy, -dx, part.shape[0], part.tobytes()))
    return out


def _pieces(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32()] * 5 + [pa.binary()]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["by", "bx", "dy", "dx", "rows", "cells"])


def run(grid: Grid, rule: R.Node, steps: int, first: int = 0, block: int = 0, depth: int = 0) -> Grid:
    """``steps`` generations; blocks and depth as given or chosen by the grid's size."""
    if not steps:
        return grid
    reach = R.reach(rule)
    ys, xs, depth = plan(grid, block, depth, steps, reach)
    ny, nx, dtype = len(ys) - 1, len(xs) - 1, _dtype(grid.states.ordinals)
    width, height, states = grid.width, grid.height, grid.states
    planes = compiles(rule, states)
    lengths = [depth] * (steps // depth) + [steps % depth] * bool(steps % depth)

    def begin(batches):  # noqa: ANN001, ANN202
        import numpy as np

        for batch in batches:
            for by, bx, raw in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                cells = np.frombuffer(raw, dtype).reshape(ys[by + 1] - ys[by], -1)
                yield from _pieces(_split(cells, by, bx, ny, nx, lengths[0] * reach)).to_batches()

    def work(t: int, long: int, onward: int):  # noqa: ANN202
        def one(table: pa.Table) -> pa.Table:
            import numpy as np

            by, bx = table["by"][0].as_py(), table["bx"][0].as_py()
            part = {(dy, dx): np.frombuffer(raw, dtype).reshape(n, -1) for dy, dx, n, raw in zip(*[table[c].to_pylist() for c in ("dy", "dx", "rows", "cells")])}
            whole = np.block([[part[dy, dx] for dx in (-1, 0, 1)] for dy in (-1, 0, 1)])
            at = (t, long, xs[bx], ys[by], width, height)
            cells = advance_planes(rule, states, whole, *at) if planes else advance(rule, whole, *at)
            if not onward:
                return pa.table({"by": pa.array([by], pa.int32()), "bx": pa.array([bx], pa.int32()), "cells": pa.array([cells.tobytes()], pa.binary())})
            return _pieces(_split(cells, by, bx, ny, nx, onward * reach))

        return one

    rows = to_blocks(grid, ys, xs, dtype).mapInArrow(begin, PIECE)
    t = first
    for k, long in enumerate(lengths):
        onward = lengths[k + 1] if k + 1 < len(lengths) else 0
        rows = rows.groupBy("by", "bx").applyInArrow(work(t, long, onward), PIECE if onward else "by int, bx int, cells binary")
        t += long
        if onward and (k + 1) % CUT_EVERY == 0:
            rows = cut(rows)
    return grid.with_cells(from_blocks(rows, ys, xs, dtype))
