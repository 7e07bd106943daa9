"""Jumping ahead in the 32-bit Mersenne Twister, so that many tasks can each make their own stretch of one sequence.

The generator's state is linear over GF(2), so the state n words on is a polynomial in the one-word step, x^n modulo the step's
characteristic polynomial. That is found from the generator's own output (Berlekamp and Massey); powers come by squaring. Polynomials are Python integers.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Fixed values of the generator: words of its state, and the bits of them that count.
WORDS, DEGREE = 624, 19937


def first_state(seed: int) -> np.ndarray:
    return np.random.RandomState(seed).get_state(legacy=True)[1].copy()


def _generator(state: np.ndarray) -> np.random.RandomState:
    out = np.random.RandomState()
    out.set_state(("MT19937", state, WORDS))
    return out


def words(state: np.ndarray, n: int) -> np.ndarray:
    """The next ``n`` outputs, tempered."""
    return _generator(state).randint(0, 1 << 32, n, dtype="u4")


def _raw(state: np.ndarray, n: int) -> np.ndarray:
    """The state's words and those after it, ``n`` in all, untempered."""
    g, parts = _generator(state), [state]
    while sum(map(len, parts)) < n:
        g.randint(0, 1 << 32, WORDS, dtype="u4")
        parts.append(g.get_state(legacy=True)[1].copy())
    return np.concatenate(parts)[:n]


@lru_cache(maxsize=1)
def characteristic() -> int:
    """The least polynomial that a bit of the sequence obeys, highest power first as the highest bit."""
    bits = _raw(first_state(1), WORDS + 2 * DEGREE + 64)[WORDS:] & 1
    c, b, size, gap, seen = 1, 1, 0, 1, 0
    for i in range(2 * DEGREE + 64):
        seen = seen << 1 | int(bits[i])  # the latest bit lowest
        if (c & seen).bit_count() & 1:
            if 2 * size <= i:
                c, b, size, gap = c ^ b << gap, c, i + 1 - size, 1
            else:
                c ^= b << gap
                gap += 1
        else:
            gap += 1
    # c has the newest term lowest; turned round, the oldest.
    return int(format(c, f"0{size + 1}b")[::-1], 2)


def _reduced(a: int) -> int:
    p = characteristic()
    n = p.bit_length()
    while (over := a.bit_length() - n) >= 0:
        a ^= p << over
    return a


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        low = b & -b
        out ^= a << low.bit_length() - 1
        b ^= low
    return _reduced(out)


def jump(n: int) -> int:
    """x^n modulo the characteristic polynomial."""
    out = 1
    for bit in format(n, "b"):
        out = _reduced(int(format(out, "b"), 4))  # a square only spreads the bits
        if bit == "1":
            out = _reduced(out << 1)
    return out


def combined(a: int, b: int) -> int:
    """The jump that two jumps make."""
    return _times(a, b)


def moved(state: np.ndarray, jump_: int) -> np.ndarray:
    """The state after a jump."""
    raw = _raw(state, DEGREE + WORDS)
    at = np.flatnonzero(np.array(list(format(jump_, "b")[::-1]), "U1") == "1")
    out = np.zeros(WORDS, "u4")
    for k in at:
        out ^= raw[k : k + WORDS]
    return out
