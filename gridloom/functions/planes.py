"""Rules on bit planes: bitwise operations that treat all cells of a word at once, for column words and for NumPy words."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

import numpy as np

from gridloom.functions import rules as R
from gridloom.functions.bitslice import Lanes, Word, array_word
from gridloom.plans.rewrite import optimised, period


class Compiler:
    """Compiles a rule in stages; each shared part of it is made once and kept. Where words come from is left to subclasses."""

    def __init__(self, states, t: int, width: int, lit: Callable[[int], Any], keys: dict[int, object] | None = None):  # noqa: ANN001
        self.states, self.t, self.w, self.lit = states, t, width, lit
        self.known: dict[object, tuple[Lanes, bool]] = {}
        self.keys = {} if keys is None else keys

    def neighbor(self, dx: int, dy: int) -> Lanes:
        raise NotImplementedError

    def toward(self, axis: str) -> Any:
        """A mask of the lanes whose Margolus block lies towards +1."""
        raise NotImplementedError

    def keep(self, key: object, value: Lanes, flag: bool) -> tuple[Lanes, bool]:
        self.known[key] = (value, flag)
        return self.known[key]

    def keep_all(self, parts: list[tuple[object, Lanes, bool]]) -> list[Lanes]:
        """As ``keep`` for parts that don't use each other."""
        return [self.keep(*part)[0] for part in parts]

    def key(self, node: R.Node) -> object:
        """Keys are made once as long as the tree lives."""
        if id(node) not in self.keys:
            self.keys[id(node)] = R.key(node)
        return self.keys[id(node)]

    def constant(self, value: int) -> Lanes:
        return Lanes.constant(value, self.w, self.lit)

    def one_bit(self, mask: Any) -> Lanes:
        return Lanes.of_mask(mask, self.w, self.lit)

    def equal(self, a: Lanes, b: R.Node) -> Any:
        """A mask; constants are compared without planes of their own."""
        if isinstance(b, (R.Const, R.State)):
            value = b.value if isinstance(b, R.Const) else self.states.index(b.ordinal)
            return a.equals_constant(value) if value < 1 << a.bits else self.lit(0)
        return a.equals(self.lanes(b)[0])

    def block(self, dx: int, dy: int) -> Lanes:
        """The cell of the Margolus block across in x (if dx) and y (if dy)."""
        if not dx and not dy:
            return self.neighbor(0, 0)
        if ("b", dx, dy) not in self.known:
            n, tx, ty = self.neighbor, self.toward("x"), self.toward("y")
            if not dy:
                out = n(1, 0).chosen(tx, n(-1, 0))
            elif not dx:
                out = n(0, 1).chosen(ty, n(0, -1))
            else:
                out = n(1, 1).chosen(ty, n(1, -1)).chosen(tx, n(-1, 1).chosen(ty, n(-1, -1)))
            self.keep(("b", dx, dy), out, False)
        return self.known["b", dx, dy][0]

    def hood(self, name: str) -> list[Lanes]:
        if name == R.MARGOLUS:
            return [self.block(dx, dy) for dx in (0, 1) for dy in (0, 1)]
        return [self.neighbor(dx, dy) for dx, dy in R.OFFSETS[name]]

    def lanes(self, node: R.Node) -> tuple[Lanes, bool]:
        """Planes of a node, and whether they are a mask."""
        if isinstance(node, R.Const):
            return self.constant(node.value), False
        if isinstance(node, R.State):
            return self.constant(self.states.index(node.ordinal)), False
        if isinstance(node, R.Neighbor):
            return self.neighbor(node.dx, node.dy), False
        key = self.key(node)
        return self.known[key] if key in self.known else self.keep(key, *self._made(node, key))

    def mask(self, node: R.Node) -> Any:
        value, flag = self.lanes(node)
        return value.plane(0) if flag else value.differs(self.constant(0))

    def _counted(self, node: R.Count, key: object) -> Lanes:
        ones = self.keep_all([((key, i), self.one_bit(self.equal(n, node.value)), True) for i, n in enumerate(self.hood(node.hood))])
        while len(ones) > 1:  # in pairs, so that widths grow with the logarithm
            n = len(ones)
            ones = self.keep_all([((key, n, i), ones[i].widened_plus(ones[i + 1]), False) for i in range(0, n - 1, 2)]) + ones[n // 2 * 2 :]
        return ones[0]

    def _remainder(self, value: Lanes, number: int, key: object) -> Lanes:
        """Long division bit by bit, each step kept, as the next one uses it many times."""
        if number <= 0 or number & (number - 1) == 0:
            return value.modulo(number)
        rest = self.constant(0)
        for i in reversed(range(value.bits)):
            rest = self.keep((key, "rest", i), rest.divided_on(value.plane(i), number), False)[0]
        return rest

    def _made(self, node: R.Node, key: object) -> tuple[Lanes, bool]:  # noqa: PLR0911
        match node:
            case R.Opposite():
                return self.block(1, 1), False
            case R.Count():
                return self._counted(node, key), False
            case R.Exists(value, name):
                return self.one_bit(reduce(lambda a, b: a.bitwiseOR(b), [self.equal(n, value) for n in self.hood(name)])), True
            case R.HasBit(value, bit):
                return self.one_bit(self.lanes(value)[0].plane(bit)), True
            case R.Compare("eq", left, right):
                return self.one_bit(self.equal(self.lanes(left)[0], right)), True
            case R.Compare("ne", left, right):
                return self.one_bit(self.equal(self.lanes(left)[0], right)).inverted(), True
            case R.Compare(op, left, right):
                a, b = self.lanes(left)[0], self.lanes(right)[0]
                return self.one_bit(a.greater(b) if op == "gt" else a.less(b)), True
            case R.Logic("not", (arg,)):
                return self.one_bit(self.mask(arg)).inverted(), True
            case R.Logic(op, args):
                return self.one_bit(reduce(lambda a, b: a.bitwiseAND(b) if op == "and" else a.bitwiseOR(b), [self.mask(a) for a in args])), True
            case R.Arith("modulo", left, right):
                if not isinstance(right, R.Const):
                    raise ValueError("planes divide by constants only")
                return self._remainder(self.lanes(left)[0], right.value, key), False
            case R.Arith(op, left, right):
                (a, fa), (b, fb) = self.lanes(left), self.lanes(right)
                # A sum of cells has no fixed width, so planes make room for the carry.
                return {"plus": a.widened_plus, "bit_and": a.anded, "bit_or": a.ored}[op](b), fa and fb and op != "plus"
            case R.If(cond, then, other):
                m, (a, fa), (b, fb) = self.mask(cond), self.lanes(then), self.lanes(other)
                return a.chosen(m, b), fa and fb
        raise TypeError(f"{type(node).__name__} must be resolved before it is compiled")


def across(words: np.ndarray, by: int, axis: int = 1) -> np.ndarray:
    """The words ``by`` places further on along an axis; zeros where there are none."""
    if not by:
        return words
    out, n = np.zeros_like(words), words.shape[axis]
    if abs(by) < n:
        to, of = [slice(None)] * words.ndim, [slice(None)] * words.ndim
        to[axis], of[axis] = (slice(0, n - by), slice(by, n)) if by > 0 else (slice(-by, n), slice(0, n + by))
        out[tuple(to)] = words[tuple(of)]
    return out


class ArrayPlanes(Compiler):
    """Words of a block, rows by words, into which ``reach`` rows are built in y; in x as many of the outermost lanes become meaningless."""

    def __init__(self, planes: list[np.ndarray], states, t: int, even_x: np.ndarray, even_y: np.ndarray, keys: dict[int, object], reach: int = 1):  # noqa: ANN001
        super().__init__(states, t, 64, array_word, keys)
        self.source, self.even, self.reach = planes, {"x": even_x, "y": even_y}, reach
        self.moved: dict[int, list[np.ndarray]] = {0: planes}

    def _moved(self, dx: int) -> list[np.ndarray]:
        if dx not in self.moved:
            words, lanes = divmod(dx, 64)
            out = []
            for p in self.source:
                q = across(p, words)
                if lanes:
                    q = q >> np.uint64(lanes) | across(p, words + 1) << np.uint64(64 - lanes)
                out.append(q)
            self.moved[dx] = out
        return self.moved[dx]

    def neighbor(self, dx: int, dy: int) -> Lanes:
        h, r = len(self.source[0]), self.reach
        return Lanes(tuple(Word(p[r + dy : h - r + dy]) for p in self._moved(dx)), 64, array_word)

    def toward(self, axis: str) -> Word:
        return Word(self.even[axis])


def compiles(rule: R.Node, states) -> bool:  # noqa: ANN001
    """Whether planes can hold all that a rule does in any of its steps."""
    edge = 2 * R.reach(rule) + 1
    try:
        for t in range(period(rule)):
            advance_planes(rule, states, np.full((edge, edge), states.ordinals[0], "i4"), t, 1, 0, 0, 1, 1)
    except (ValueError, KeyError, TypeError):
        return False
    return True


def _packed(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of words, lowest lane first."""
    wide = np.zeros((*flags.shape[:-1], -(-flags.shape[-1] // 64) * 64), bool)
    wide[..., : flags.shape[-1]] = flags
    return np.packbits(wide, axis=-1, bitorder="little").view("<u8")


def advance_words(rule: R.Node, states, planes: list[np.ndarray], t: int, steps: int, lane0: int, lanes: int, y0: int, width: int, height: int) -> list[np.ndarray]:  # noqa: ANN001
    """``steps`` generations from step ``t`` of planes of words, 64 cells each, with ``steps`` times the rule's reach rows of halo above and below, and as many lanes at least on both sides.

    Lane 0 is column ``lane0`` of the whole grid, and ``lanes`` are meaningful; the first row that is no halo is row ``y0``. The rows of the halo go; in x the outermost
    lanes lose their meaning instead. A rule that gives something that is no state is an error.
    """
    wide, r = planes[0].shape[1], R.reach(rule)
    x = (lane0 + np.arange(wide * 64)) % width
    trees: dict[int, tuple[R.Node, dict[int, object]]] = {}
    every = period(rule)
    even_x = {p: _packed(((x + p) % 2 == 0)[None, :]) for p in (0, 1)}
    for k in range(steps):
        rows = len(planes[0]) - 2 * r
        y = (y0 - (steps - 1 - k) * r + np.arange(rows)) % height
        even_y = np.where((y + t + k) % 2 == 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, None]
        step = (t + k) % every
        if step not in trees:
            trees[step] = (optimised(rule, t + k), {})
        tree, keys = trees[step]
        c = ArrayPlanes(planes, states, t + k, even_x[(t + k) % 2], even_y, keys, r)
        value, _ = c.lanes(tree)
        shape = (rows, wide)
        if value.bits > states.bits:
            side = np.zeros(wide * 64, bool)
            side[(k + 1) * r : lanes - (k + 1) * r] = True
            over = reduce(np.bitwise_or, [np.broadcast_to(p.v, shape) for p in value.planes[states.bits :]])
            if (over & _packed(side[None, :])).any():
                raise ValueError("the rule gives numbers that are no states")
        planes = [np.broadcast_to(p.v, shape) for p in value.resized(states.bits).planes]
        planes = [p if p.flags.c_contiguous and p.flags.writeable else np.ascontiguousarray(p).copy() for p in planes]
    return planes


def packed_planes(states, cells: np.ndarray) -> list[np.ndarray]:  # noqa: ANN001
    """Planes of the dictionary indices of an array of ordinals."""
    if states.plain:
        index = cells
    else:
        table = np.zeros(max(states.ordinals) + 1, "u1")
        table[list(states.ordinals)] = np.arange(len(states.ordinals))
        index = table[cells]
    return [_packed((index >> i & 1).astype(bool)) for i in range(states.bits)]


def unpacked_planes(states, planes: list[np.ndarray], left: int, width: int) -> np.ndarray:  # noqa: ANN001
    """The ordinals of ``width`` lanes from lane ``left`` on, as bytes where states allow it; an index of no state is an error."""
    out = np.zeros((len(planes[0]), planes[0].shape[1] * 64), "u1")
    for i, p in enumerate(planes):
        out |= np.unpackbits(np.ascontiguousarray(p).view("u1"), axis=1, bitorder="little") << np.uint8(i)
    out = out[:, left : left + width]
    if len(states.ordinals) < 1 << states.bits and out.size and out.max() >= len(states.ordinals):
        raise ValueError("the rule gives numbers that are no states")
    return out if states.plain else np.array(states.ordinals)[out]


def advance_planes(rule: R.Node, states, block: np.ndarray, t: int, steps: int, x0: int, y0: int, width: int, height: int) -> np.ndarray:  # noqa: ANN001
    """As ``arrays.advance``, 64 cells a word. A rule that gives something that is no state is an error."""
    w, ring = block.shape[1], steps * R.reach(rule)
    planes = advance_words(rule, states, packed_planes(states, block), t, steps, x0 - ring, w, y0, width, height)
    return np.ascontiguousarray(unpacked_planes(states, planes, ring, w - 2 * ring).astype(block.dtype))
