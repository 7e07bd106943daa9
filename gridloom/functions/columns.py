"""Rules as Spark columns over a row of x, y and neighbour states."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions import rules as R
from gridloom.functions.evaluate import Target, as_number

_COMPARE = {"eq": operator.eq, "ne": operator.ne, "gt": operator.gt, "lt": operator.lt}


def name(dx: int, dy: int) -> str:
    """Column of the neighbour at an offset."""
    return "n_" + "_".join(str(d).replace("-", "m") for d in (dx, dy))


class Columns(Target):
    """``t`` is a number when the plan is made, so parities fold away; ``counts`` maps keys of counted nodes to columns that hold them."""

    def __init__(self, t: int, counts: dict[object, str] | None = None):
        self.t, self.counts = t, counts or {}

    def neighbor(self, dx: int, dy: int) -> Column:
        return F.col(name(dx, dy))

    def const(self, value: int) -> Column:
        return F.lit(value)

    def compare(self, op: str, a: Column, b: Column) -> Column:
        return _COMPARE[op](a, b)

    def logic(self, op: str, args: list[Column]) -> Column:
        return ~args[0] if op == "not" else reduce(operator.and_ if op == "and" else operator.or_, args)

    def arith(self, op: str, a: Column, b: Column) -> Column:
        return {"plus": lambda: a + b, "modulo": lambda: a % b, "bit_and": lambda: a.bitwiseAND(b), "bit_or": lambda: a.bitwiseOR(b)}[op]()

    def where(self, cond: Column, a: Column, b: Column) -> Column:
        return F.when(cond, a).otherwise(b)

    def number(self, flag: Column) -> Column:
        return flag.cast("int")

    def total(self, flags: list[Column]) -> Column:
        return reduce(operator.add, [f.cast("int") for f in flags])

    def toward(self, axis: str) -> Column:
        return (F.col(axis) + self.t) % 2 == 0

    def counted(self, node: R.Node) -> Column | None:
        held = self.counts.get(R.key(node)) if self.counts and isinstance(node, (R.Count, R.Exists)) else None
        return F.col(held) if held else None


def to_column(rule: R.Node, t: int = 0, counts: dict[object, str] | None = None) -> Column:
    """The rule's integer value for step ``t``; alternatives must be resolved already."""
    return as_number(rule, Columns(t, counts)).cast("int")
