"""Bit-sliced integers: lanes of small unsigned numbers held as one word for each bit.

Words are LONG columns of ``width`` lanes (up to 64; narrower ones are kept zero-extended), masks are such words with one bit a lane. All
operations are bitwise expressions that stay in generated code, so one machine operation works on all lanes of a word.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def full(width: int) -> int:
    """The word whose lanes are all set, as a signed LONG."""
    return -1 if width == 64 else (1 << width) - 1


def _signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 & 1 else word


def pattern(width: int, run: int) -> int:
    """Lanes 0 to run-1 set, the next ``run`` clear, and so on."""
    return _signed(sum(1 << i for i in range(width) if i // run % 2 == 0))


class Word:
    """Many 64-bit words in a NumPy array, with a column's names for bitwise operations, so that both compile alike.

    A constant is a number; where it is all zeros or all ones nothing is computed.
    """

    __slots__ = ("v",)

    def __init__(self, v: Any):
        self.v = v

    def _parted(self, other: Word) -> tuple[int, Word, Word]:
        """-1 or 0 if one of both is all ones or zeros, then that one and the other; else 1."""
        for one, rest in ((self, other), (other, self)):
            if one.v.ndim == 0:
                value = int(one.v)
                if value in (0, _FULL):
                    return -(value & 1), one, rest
        return 1, self, other

    def bitwiseAND(self, other: Word) -> Word:  # noqa: N802
        kind, one, rest = self._parted(other)
        return rest if kind < 0 else one if kind == 0 else Word(one.v & rest.v)

    def bitwiseOR(self, other: Word) -> Word:  # noqa: N802
        kind, one, rest = self._parted(other)
        return one if kind < 0 else rest if kind == 0 else Word(one.v | rest.v)

    def bitwiseXOR(self, other: Word) -> Word:  # noqa: N802
        kind, one, rest = self._parted(other)
        return Word(~rest.v) if kind < 0 else rest if kind == 0 else Word(one.v ^ rest.v)


_FULL = (1 << 64) - 1


def column_word(word: int) -> Column:
    return F.lit(word).cast("long")


def array_word(word: int) -> Word:
    import numpy as np

    return Word(np.uint64(word & (1 << 64) - 1))


def _flip(w: Any) -> Any:
    return Word(~w.v) if isinstance(w, Word) else F.bitwise_not(w)


def _right(w: Any, n: int) -> Any:
    return Word(w.v >> w.v.dtype.type(n)) if isinstance(w, Word) else F.shiftrightunsigned(w, n)


def _left(w: Any, n: int) -> Any:
    return Word(w.v << w.v.dtype.type(n)) if isinstance(w, Word) else F.shiftleft(w, n)


@dataclass(frozen=True)
class Lanes:
    """``planes[i]`` holds bit i of every lane; no plane stands for zeros above the last. ``lit`` makes a constant word of the planes' kind."""

    planes: tuple[Any, ...]
    width: int = 32
    lit: Callable[[int], Any] = column_word

    @property
    def bits(self) -> int:
        return len(self.planes)

    # -- building blocks

    def _ones(self) -> Column:
        return self.lit(full(self.width))

    def _zero(self) -> Column:
        return self.lit(0)

    def _not(self, word: Column) -> Column:
        flipped = _flip(word)
        return flipped if self.width == 64 else flipped.bitwiseAND(self._ones())

    def plane(self, i: int) -> Column:
        """Bit i of every lane as a mask."""
        return self.planes[i] if i < self.bits else self._zero()

    def _with(self, planes: list[Column]) -> Lanes:
        return Lanes(tuple(planes), self.width, self.lit)

    # -- conversions

    @classmethod
    def constant(cls, value: int, width: int = 32, lit: Callable[[int], Any] = column_word) -> Lanes:
        """The same number in every lane: bits up to the highest set and one more, a single one for 0."""
        n = value.bit_length() + 1 if value else 1
        return cls(tuple(lit(full(width) if value >> i & 1 else 0) for i in range(n)), width, lit)

    @classmethod
    def of_mask(cls, mask: Any, width: int = 32, lit: Callable[[int], Any] = column_word) -> Lanes:
        return cls((mask,), width, lit)

    def resized(self, bits: int) -> Lanes:
        """Cut off above, or filled up with zeros."""
        return self._with([self.plane(i) for i in range(bits)])

    def get_at(self, lane: int) -> Column:
        """The number in a lane."""
        self._check(lane)
        out = self._zero()
        for i, p in enumerate(self.planes):
            out = out.bitwiseOR(_left(_right(p, lane).bitwiseAND(self.lit(1)), i))
        return out

    def set_at(self, lane: int, value: int) -> Lanes:
        self._check(lane)
        one = _signed(1 << lane)
        return self._with([p.bitwiseOR(self.lit(one)) if value >> i & 1 else p.bitwiseAND(self.lit(~one)) for i, p in enumerate(self.planes)])

    def _check(self, lane: int) -> None:
        if not 0 <= lane < self.width:
            raise IndexError(f"lane {lane} of {self.width}")

    # -- arithmetic and bitwise

    def plus(self, other: Lanes) -> Lanes:
        """Sum modulo two to the wider width."""
        carry, out = None, []
        for i in range(max(self.bits, other.bits)):
            a, b = self.plane(i), other.plane(i)
            half = a.bitwiseXOR(b)
            out.append(half if carry is None else half.bitwiseXOR(carry))
            made = a.bitwiseAND(b)
            carry = made if carry is None else made.bitwiseOR(carry.bitwiseAND(half))
        return self._with(out)

    def widened_plus(self, other: Lanes) -> Lanes:
        """Sum with room for the carry."""
        n = max(self.bits, other.bits) + 1
        return self.resized(n).plus(other.resized(n))

    def divided_on(self, bit: Any, number: int) -> Lanes:
        """One step of long division: what remains of twice these remainders of ``number`` and one more bit."""
        size = number.bit_length()
        twice = self._with([bit, *(self.plane(i) for i in range(size))])
        less, borrow = [], self._zero()  # twice minus number, and where that is negative
        for i, a in enumerate(twice.planes):
            apart = a.bitwiseXOR(borrow)
            if number >> i & 1:
                less.append(self._not(apart))
                borrow = self._not(a).bitwiseOR(borrow)
            else:
                less.append(apart)
                borrow = self._not(a).bitwiseAND(borrow)
        return twice.chosen(borrow, self._with(less)).resized(size)

    def modulo(self, number: int) -> Lanes:
        """Remainder by any number above 0, for powers of two without division."""
        if number <= 0:
            raise ValueError("planes divide by positive numbers only")
        if number & (number - 1) == 0:
            return self.resized(max(1, number.bit_length() - 1)) if number > 1 else self._with([self._zero()])
        rest = self._with([self._zero()])
        for bit in reversed(self.planes):
            rest = rest.divided_on(bit, number)
        return rest

    def ored(self, other: Lanes) -> Lanes:
        return self._with([self.plane(i).bitwiseOR(other.plane(i)) for i in range(max(self.bits, other.bits))])

    def xored(self, other: Lanes) -> Lanes:
        return self._with([self.plane(i).bitwiseXOR(other.plane(i)) for i in range(max(self.bits, other.bits))])

    def anded(self, other: Lanes) -> Lanes:
        return self._with([self.plane(i).bitwiseAND(other.plane(i)) for i in range(max(self.bits, other.bits))])

    def anded_constant(self, value: int) -> Lanes:
        return self._with([p if value >> i & 1 else self._zero() for i, p in enumerate(self.planes)])

    def ored_constant(self, value: int) -> Lanes:
        return self._with([self._ones() if value >> i & 1 else p for i, p in enumerate(self.planes)])

    def xored_constant(self, value: int) -> Lanes:
        return self._with([self._not(p) if value >> i & 1 else p for i, p in enumerate(self.planes)])

    def inverted(self) -> Lanes:
        return self._with([self._not(p) for p in self.planes])

    def masked(self, mask: Column) -> Lanes:
        """Lanes that the mask lacks become 0."""
        return self._with([p.bitwiseAND(mask) for p in self.planes])

    def masked_constant(self, word: int) -> Lanes:
        """Lanes whose bit of the constant word is clear become 0."""
        return self.masked(self.lit(_signed(word & (1 << self.width) - 1)))

    def chosen(self, mask: Column, other: Lanes) -> Lanes:
        """These lanes where the mask is set, the other's elsewhere."""
        return self.masked(mask).ored(other.masked(self._not(mask)))

    # -- moving lanes

    def shifted_right(self, n: int) -> Lanes:
        """Lane i takes what lane i + n held."""
        return self._with([_right(p, n) for p in self.planes])

    def shifted_left(self, n: int) -> Lanes:
        """Lane i takes what lane i - n held."""
        return self._with([_left(p, n).bitwiseAND(self._ones()) for p in self.planes])

    def _swapped(self, run: int) -> Lanes:
        low = self.lit(pattern(self.width, run))
        return self._with([_right(p, run).bitwiseAND(low).bitwiseOR(_left(p.bitwiseAND(low), run)) for p in self.planes])

    def swapped_pairs(self) -> Lanes:
        """Lanes 2i and 2i + 1 change places."""
        return self._swapped(1)

    def swapped_rows_of_8(self) -> Lanes:
        """Neighbouring rows of eight lanes change places."""
        return self._swapped(8)

    # -- comparisons, each a mask

    def equals(self, other: Lanes) -> Column:
        return self._not(self.differs(other))

    def differs(self, other: Lanes) -> Column:
        out = self._zero()
        for i in range(max(self.bits, other.bits)):
            out = out.bitwiseOR(self.plane(i).bitwiseXOR(other.plane(i)))
        return out

    def equals_constant(self, value: int) -> Column:
        """Compares the bits that the lanes have; higher ones of the constant are not looked at."""
        out = self._ones()
        for i, p in enumerate(self.planes):
            out = out.bitwiseAND(p if value >> i & 1 else self._not(p))
        return out

    def greater(self, other: Lanes) -> Column:
        """Unsigned, decided by the highest bit that differs."""
        out, open_ = self._zero(), self._ones()
        for i in reversed(range(max(self.bits, other.bits))):
            a, b = self.plane(i), other.plane(i)
            out = out.bitwiseOR(open_.bitwiseAND(a).bitwiseAND(self._not(b)))
            open_ = open_.bitwiseAND(self._not(a.bitwiseXOR(b)))
        return out

    def less(self, other: Lanes) -> Column:
        return other.greater(self)
