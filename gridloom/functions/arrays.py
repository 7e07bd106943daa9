"""Rules on NumPy arrays: a padded block of cells in, its interior one step on out."""

from __future__ import annotations

from functools import reduce

import numpy as np

from gridloom.functions import rules as R
from gridloom.functions.evaluate import Target, as_number
from gridloom.plans.rewrite import optimised


class Arrays(Target):
    """Views of a block into which ``reach`` rings of neighbours are built; x and y are the interior cells' coordinates on the whole grid."""

    def __init__(self, block: np.ndarray, t: int, x: np.ndarray, y: np.ndarray, reach: int = 1):
        self.block, self.x, self.y, self.reach = block, (x + t) % 2 == 0, (y + t) % 2 == 0, reach

    def neighbor(self, dx: int, dy: int) -> np.ndarray:
        (h, w), r = self.block.shape, self.reach
        return self.block[r + dy : h - r + dy, r + dx : w - r + dx]

    def const(self, value: int) -> np.ndarray:
        return np.asarray(value, self.block.dtype)

    def compare(self, op: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return {"eq": np.equal, "ne": np.not_equal, "gt": np.greater, "lt": np.less}[op](a, b)

    def logic(self, op: str, args: list[np.ndarray]) -> np.ndarray:
        return ~args[0] if op == "not" else reduce(np.logical_and if op == "and" else np.logical_or, args)

    def arith(self, op: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return {"plus": np.add, "modulo": np.mod, "bit_and": np.bitwise_and, "bit_or": np.bitwise_or}[op](a, b)

    def where(self, cond: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(cond, a, b)

    def number(self, flag: np.ndarray) -> np.ndarray:
        return flag.astype(self.block.dtype)

    def total(self, flags: list[np.ndarray]) -> np.ndarray:
        return reduce(np.add, [f.view("i1") if f.dtype == bool else f for f in flags])

    def toward(self, axis: str) -> np.ndarray:
        return self.x[None, :] if axis == "x" else self.y[:, None]

    def counted(self, node: R.Node) -> None:
        return None


def advance(rule: R.Node, block: np.ndarray, t: int, steps: int, x0: int, y0: int, width: int, height: int) -> np.ndarray:
    """``steps`` generations from step ``t`` of a block with ``steps`` times the rule's reach of rings around it; (x0, y0) is its first interior cell.

    Coordinates wrap on the whole grid, so parities are right in every block and on grids of odd size.
    """
    r = R.reach(rule)
    ring = steps * r
    for k in range(steps):
        h, w = block.shape[0] - 2 * r, block.shape[1] - 2 * r
        ring -= r
        x = (x0 - ring + np.arange(w)) % width
        y = (y0 - ring + np.arange(h)) % height
        new = as_number(optimised(rule, t + k), Arrays(block, t + k, x, y, r))
        block = np.ascontiguousarray(np.broadcast_to(new, (h, w)).astype(block.dtype))
    return block
