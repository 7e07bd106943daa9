"""One evaluator of rules for two targets: Spark columns and NumPy arrays.

A target says how to read a neighbour, how to compare and combine values, and which way the Margolus block lies; the
meaning of every node is written once, here. Values are pairs of the target's value and whether it is boolean, because the rule
language lets bitwise operators take booleans and conditions take integers.
"""

from __future__ import annotations

from gridloom.functions import rules as R

Value = tuple[object, bool]


class Target:
    """What a compiler has to provide."""

    def neighbor(self, dx: int, dy: int): ...  # noqa: ANN201
    def const(self, value: int): ...  # noqa: ANN201
    def compare(self, op: str, a, b): ...  # noqa: ANN001, ANN201
    def logic(self, op: str, args: list): ...  # noqa: ANN201
    def arith(self, op: str, a, b): ...  # noqa: ANN001, ANN201
    def where(self, cond, a, b): ...  # noqa: ANN001, ANN201
    def number(self, flag): ...  # noqa: ANN001, ANN201
    def total(self, flags: list): ...  # noqa: ANN201
    def toward(self, axis: str): ...  # noqa: ANN201
    def counted(self, node: R.Node): ...  # noqa: ANN201


def margolus(target: Target, dx: int, dy: int):  # noqa: ANN201
    """The block's cell on the other side in x (if dx) and y (if dy): the block lies towards +1 where x + t is even, else towards -1."""
    if not dx and not dy:
        return target.neighbor(0, 0)
    if not dy:
        return target.where(target.toward("x"), target.neighbor(1, 0), target.neighbor(-1, 0))
    if not dx:
        return target.where(target.toward("y"), target.neighbor(0, 1), target.neighbor(0, -1))
    right = target.where(target.toward("y"), target.neighbor(1, 1), target.neighbor(1, -1))
    left = target.where(target.toward("y"), target.neighbor(-1, 1), target.neighbor(-1, -1))
    return target.where(target.toward("x"), right, left)


def hood(target: Target, name: str) -> list:
    if name == R.MARGOLUS:
        return [margolus(target, dx, dy) for dx in (0, 1) for dy in (0, 1)]
    return [target.neighbor(dx, dy) for dx, dy in R.OFFSETS[name]]


def evaluate(node: R.Node, target: Target) -> Value:  # noqa: PLR0911
    def number(n: R.Node):  # noqa: ANN202
        v, flag = evaluate(n, target)
        return target.number(v) if flag else v

    def truth(n: R.Node):  # noqa: ANN202
        v, flag = evaluate(n, target)
        return v if flag else target.compare("ne", v, target.const(0))

    if (known := target.counted(node)) is not None:
        return known, isinstance(node, R.Exists)
    match node:
        case R.Const(value) | R.State(value):
            return target.const(value), False
        case R.Neighbor(dx, dy):
            return target.neighbor(dx, dy), False
        case R.Opposite():
            return margolus(target, 1, 1), False
        case R.Count(value, name):
            v = number(value)
            return target.total([target.compare("eq", n, v) for n in hood(target, name)]), False
        case R.Exists(value, name):
            v = number(value)
            return target.logic("or", [target.compare("eq", n, v) for n in hood(target, name)]), True
        case R.HasBit(value, bit):
            return target.compare("ne", target.arith("bit_and", number(value), target.const(1 << bit)), target.const(0)), True
        case R.Compare(op, left, right):
            return target.compare(op, number(left), number(right)), True
        case R.Logic(op, args):
            return target.logic(op, [truth(a) for a in args]), True
        case R.Arith(op, left, right):
            a, b = evaluate(left, target), evaluate(right, target)
            if op in ("bit_and", "bit_or") and a[1] and b[1]:
                return target.logic(op[4:], [a[0], b[0]]), True
            return target.arith(op, number(left), number(right)), False
        case R.If(cond, then, other):
            a, b = evaluate(then, target), evaluate(other, target)
            if a[1] and b[1]:
                return target.where(truth(cond), a[0], b[0]), True
            return target.where(truth(cond), number(then), number(other)), False
    raise TypeError(f"{type(node).__name__} must be resolved before it is evaluated")


def as_number(node: R.Node, target: Target):  # noqa: ANN201
    v, flag = evaluate(node, target)
    return target.number(v) if flag else v
