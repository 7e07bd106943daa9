"""The rule language: immutable expression trees over a cell and its neighbours.

A rule is built from Python operators and the functions below, and is turned into Spark columns, NumPy arrays or bit planes by the
compilers beside this module::

    alive = count(State(1), MOORE)
    life = when(HERE == State(1)).then(when((alive == 2) | (alive == 3)).then(1).otherwise(0)).when(alive == 3).then(1).otherwise(0)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

MOORE, VON_NEUMANN, MARGOLUS = "moore", "von_neumann", "margolus"
#: The offsets (dx, dy) of the two static neighbourhoods; +y is down.
OFFSETS = {
    MOORE: ((-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1)),
    VON_NEUMANN: ((0, 1), (0, -1), (1, 0), (-1, 0)),
}


class Node:
    """Base of all expressions. ``==`` and the other operators build nodes, so nodes are compared with ``same``."""

    __hash__ = object.__hash__

    def __eq__(self, other):  # noqa: ANN001, ANN204
        return Compare("eq", self, lift(other))

    def __ne__(self, other):  # noqa: ANN001, ANN204
        return Compare("ne", self, lift(other))

    def __gt__(self, other):  # noqa: ANN001, ANN204
        return Compare("gt", self, lift(other))

    def __lt__(self, other):  # noqa: ANN001, ANN204
        return Compare("lt", self, lift(other))

    def __and__(self, other):  # noqa: ANN001, ANN204
        return Logic("and", (self, lift(other)))

    def __or__(self, other):  # noqa: ANN001, ANN204
        return Logic("or", (self, lift(other)))

    def __invert__(self):  # noqa: ANN204
        return Logic("not", (self,))

    def __add__(self, other):  # noqa: ANN001, ANN204
        return Arith("plus", self, lift(other))

    def __mod__(self, other):  # noqa: ANN001, ANN204
        return Arith("modulo", self, lift(other))

    def bit_and(self, other):  # noqa: ANN001, ANN201
        return Arith("bit_and", self, lift(other))

    def bit_or(self, other):  # noqa: ANN001, ANN201
        return Arith("bit_or", self, lift(other))

    def has_bit(self, bit: int) -> HasBit:
        return HasBit(self, bit)

    def children(self) -> Iterator[Node]:
        for f in fields(self):  # type: ignore[arg-type]
            v = getattr(self, f.name)
            yield from ((v,) if isinstance(v, Node) else v if isinstance(v, tuple) and v and isinstance(v[0], Node) else ())

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children():
            yield from c.walk()


def same(a: Node, b: Node) -> bool:
    """Whether two trees are equal."""
    return key(a) == key(b)


def key(node: object) -> object:
    """A hashable value that two trees share if and only if they are equal."""
    if isinstance(node, Node):
        return (type(node).__name__, *(key(getattr(node, f.name)) for f in fields(node)))  # type: ignore[arg-type]
    return tuple(map(key, node)) if isinstance(node, tuple) else node


@dataclass(frozen=True, eq=False)
class Const(Node):
    """An integer."""

    value: int


@dataclass(frozen=True, eq=False)
class State(Node):
    """A cell state, by its ordinal; packed layouts hold its dictionary index instead."""

    ordinal: int


@dataclass(frozen=True, eq=False)
class Neighbor(Node):
    """The state of the cell at (x + dx, y + dy) on the torus."""

    dx: int
    dy: int


@dataclass(frozen=True, eq=False)
class Opposite(Node):
    """The cell diagonally across the Margolus block."""


@dataclass(frozen=True, eq=False)
class Count(Node):
    """How many cells of a neighbourhood equal ``value``, which may be an expression of the centre. A Margolus block includes the cell itself."""

    value: Node
    hood: str = MOORE


@dataclass(frozen=True, eq=False)
class Exists(Node):
    """Whether any cell of the neighbourhood equals ``value``: what ``Count(...) > 0`` is rewritten to."""

    value: Node
    hood: str = MOORE


@dataclass(frozen=True, eq=False)
class HasBit(Node):
    value: Node
    bit: int


@dataclass(frozen=True, eq=False)
class Compare(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True, eq=False)
class Logic(Node):
    op: str
    args: tuple[Node, ...]


@dataclass(frozen=True, eq=False)
class Arith(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True, eq=False)
class If(Node):
    cond: Node
    then: Node
    other: Node


@dataclass(frozen=True, eq=False)
class Alternate(Node):
    """Rule number t modulo their number at step t."""

    rules: tuple[Node, ...]


def offsets(node: Node) -> set[tuple[int, int]]:
    """Where the cells lie that a rule reads, its own among them."""
    out = {(0, 0)}
    for n in node.walk():
        if isinstance(n, Neighbor):
            out.add((n.dx, n.dy))
        elif isinstance(n, Opposite) or getattr(n, "hood", "") == MARGOLUS:
            out.update(OFFSETS[MOORE])
        elif hasattr(n, "hood"):
            out.update(OFFSETS[n.hood])
    return out


def reach(node: Node) -> int:
    """How far a rule reads, at least 1."""
    return max(1, *(max(abs(dx), abs(dy)) for dx, dy in offsets(node)))


HERE = Neighbor(0, 0)
UP, DOWN, LEFT, RIGHT = Neighbor(0, -1), Neighbor(0, 1), Neighbor(-1, 0), Neighbor(1, 0)


def lift(value: Node | int) -> Node:
    return value if isinstance(value, Node) else Const(int(value))


def count(value: Node | int, hood: str = MOORE) -> Count:
    return Count(lift(value), hood)


class _Then:
    def __init__(self, chain: list[tuple[Node, Node]], cond: Node):
        self._chain, self._cond = chain, cond

    def then(self, value: Node | int) -> _Else:
        return _Else([*self._chain, (self._cond, lift(value))])


class _Else:
    def __init__(self, chain: list[tuple[Node, Node]]):
        self._chain = chain

    def when(self, cond: Node) -> _Then:
        return _Then(self._chain, cond)

    def otherwise(self, value: Node | int) -> Node:
        out = lift(value)
        for cond, then in reversed(self._chain):
            out = If(cond, then, out)
        return out


def when(cond: Node) -> _Then:
    """Begin a chain: ``when(c).then(a).when(d).then(b).otherwise(e)``."""
    return _Then([], cond)


def map_tree(node: Node, change) -> Node:  # noqa: ANN001
    """The tree with ``change`` applied to every node, children first."""
    values = []
    for f in fields(node):  # type: ignore[arg-type]
        v = getattr(node, f.name)
        if isinstance(v, Node):
            v = map_tree(v, change)
        elif isinstance(v, tuple) and v and isinstance(v[0], Node):
            v = tuple(map_tree(x, change) for x in v)
        values.append(v)
    return change(type(node)(*values))
