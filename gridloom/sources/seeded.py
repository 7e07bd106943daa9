"""Initial grids from a seed, of any size, made by the executors."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom.automata import Automaton
from gridloom.operators.grid import Grid, States, skeleton
from gridloom.plans import words
from gridloom.sources import twister

DEFAULT_SEED = 12345
#: Cells that a task draws in one go.
CHUNK = 1 << 20
Start = tuple[tuple[int, float], ...]


def thresholds(start: Start) -> list[tuple[int, float]]:
    """(state, cumulated probability); a state is taken where a random number is at most its threshold and over the one before."""
    total = sum(p for _, p in start)
    if abs(total - 1) > 0.001:
        warnings.warn(f"probabilities sum to {total} instead of 1", stacklevel=3)
    return list(zip([s for s, _ in start], accumulate(p for _, p in start)))


def two_states(primary: int, probability: float, secondary: int) -> Start:
    """The distribution of a grid of two states, the first of which has the given probability."""
    return (primary, probability), (secondary, 1 - probability)


def _states_of(r: np.ndarray, limits: list[tuple[int, float]]) -> np.ndarray:
    out = np.zeros(len(r), "i4")
    open_ = np.ones(len(r), bool)
    for state, limit in limits:
        hit = open_ & (r <= limit)
        out[hit] = state
        open_ &= ~hit
    return out


def _drawn(generator: np.random.RandomState, n: int, limits: list[tuple[int, float]]) -> np.ndarray:
    """``n`` states from the 32-bit Mersenne Twister, two outputs to a double: low word first, both over 2^64."""
    raw = generator.randint(0, 1 << 32, 2 * n, dtype="u4").astype("f8")
    r = (raw[0::2] + raw[1::2] * 4294967296.0) / 18446744073709551616.0
    r[r >= 1] = math.nextafter(1.0, 0.0)
    return _states_of(r, limits)


def random_values(start: Start, width: int, height: int, seed: int = DEFAULT_SEED) -> np.ndarray:
    """Row-major states as an array of this process."""
    return _drawn(np.random.RandomState(seed), width * height, thresholds(start)).reshape(height, width)


def _from(seed: int, cell: int) -> np.random.RandomState:
    """The generator as it is when so many cells have been drawn."""
    out = np.random.RandomState(seed)
    if cell:
        out.set_state(("MT19937", twister.moved(twister.first_state(seed), twister.jump(2 * cell)), twister.WORDS))
    return out


def from_array(spark: SparkSession, values: np.ndarray, states: States) -> Grid:
    """A grid of an array held by the driver."""
    h, w = values.shape
    table = pa.table({"x": np.tile(np.arange(w, dtype="i4"), h), "y": np.repeat(np.arange(h, dtype="i4"), w), "s": values.reshape(-1).astype("i4")})
    return Grid(spark.createDataFrame(table), w, h, states)


def random_grid(spark: SparkSession, automaton: Automaton, width: int, height: int, seed: int = DEFAULT_SEED) -> Grid:
    """The automaton's initial grid for a seed, from one sequence of random numbers into which each task jumps; for wire its circuit."""
    if not automaton.start:
        return circuit(spark, automaton, width, height, seed)
    limits, total = thresholds(automaton.start), width * height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                first, n = k * CHUNK, min(CHUNK, total - k * CHUNK)
                at = first + np.arange(n)
                yield pa.RecordBatch.from_arrays([pa.array((at % width).astype("i4")), pa.array((at // width).astype("i4")), pa.array(_drawn(_from(seed, first), n, limits))], names=["x", "y", "s"])

    chunks = -(-total // CHUNK)
    return Grid(spark.range(0, chunks, 1, chunks).mapInArrow(run, "x int, y int, s int"), width, height, automaton.states)


def random_words(spark: SparkSession, automaton: Automaton, width: int, height: int, seed: int = DEFAULT_SEED, block: int = 0) -> words.WordGrid:
    """``random_grid`` as blocks of bit planes, a band of blocks a task."""
    if not automaton.start:
        return words.generated(spark, width, height, automaton.states, _circuit_of(width, height, seed), block)
    limits, states = thresholds(automaton.start), automaton.states
    ys, xs = words.layout(spark, width, height, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for by in batch.column(0).to_pylist():
                generator, parts = _from(seed, ys[by] * width), []
                step = max(1, CHUNK // width)
                for y in range(ys[by], ys[by + 1], step):
                    n = min(step, ys[by + 1] - y)
                    parts.append(np.stack(words.packed_planes(states, _drawn(generator, n * width, limits).reshape(n, width))))
                band = np.concatenate(parts, axis=1)
                for bx, (a, b) in enumerate(zip(xs, xs[1:])):
                    raw = band[:, :, a // words.LANES : b // words.LANES].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([by], pa.int32()), pa.array([bx], pa.int32()), pa.array([raw], pa.binary())], names=["by", "bx", "words"])

    bands = len(ys) - 1
    return words.WordGrid(spark.range(0, bands, 1, bands).mapInArrow(run, words.BLOCK), ys, xs, states)


def _limits(automaton: Automaton) -> list[tuple[int, float]]:
    return thresholds(automaton.start or ((3, 0.95), (1, 0.025), (2, 0.025)))


def hashed_grid(spark: SparkSession, automaton: Automaton, width: int, height: int, seed: int = DEFAULT_SEED) -> Grid:
    """A grid with the same distribution, each cell drawn by a hash of its place and the seed; other data than ``random_grid``'s."""
    r = (F.xxhash64("x", "y", F.lit(seed).cast("int")).bitwiseAND(F.lit((1 << 53) - 1).cast("long")) / float(1 << 53)).alias("r")
    rows = skeleton(spark, width, height).select("x", "y", r)
    chain = None
    for state, limit in _limits(automaton):
        chain = F.when(F.col("r") <= limit, state) if chain is None else chain.when(F.col("r") <= limit, state)
    return Grid(rows.select("x", "y", chain.otherwise(0).cast("int").alias("s")), width, height, automaton.states)


_P1, _P2, _P3, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def hash_ints(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """XXH64 of 32-bit integers as ``xxhash64`` has it, ``seed`` being the hash so far (42 at first)."""
    with np.errstate(over="ignore"):
        h = seed + _P5 + np.uint64(4) ^ (value.astype("i8").astype("u8") & np.uint64(0xFFFFFFFF)) * _P1
        h = (h << np.uint64(23) | h >> np.uint64(41)) * _P2 + _P3
        h = (h ^ h >> np.uint64(33)) * _P2
        h = (h ^ h >> np.uint64(29)) * _P3
        return h ^ h >> np.uint64(32)


def _placed(y0: int, y1: int, x0: int, x1: int, seed: int) -> np.ndarray:
    """The hash of each place of a block."""
    x = hash_ints(np.arange(x0, x1), np.uint64(42))[None, :]
    xy = hash_ints(np.arange(y0, y1)[:, None], np.broadcast_to(x, (y1 - y0, x1 - x0)))
    return hash_ints(np.asarray(seed), xy)


def hashed_words(spark: SparkSession, automaton: Automaton, width: int, height: int, seed: int = DEFAULT_SEED, block: int = 0) -> words.WordGrid:
    """``hashed_grid`` as blocks of bit planes, cell for cell the same."""
    limits = _limits(automaton)

    def fill(y0: int, y1: int, x0: int, x1: int) -> np.ndarray:
        parts = []
        for y in range(y0, y1, 128):
            h = _placed(y, min(y + 128, y1), x0, x1, seed)
            r = (h & np.uint64((1 << 53) - 1)).astype("f8") / float(1 << 53)
            parts.append(_states_of(r.reshape(-1), limits).reshape(r.shape))
        return np.concatenate(parts)

    return words.generated(spark, width, height, automaton.states, fill, block)


#: Edge of the tiles of a circuit, and the share of tiles that each kind of wire crosses.
TILE, ACROSS = 16, 0.7


def _circuit_of(width: int, height: int, seed: int) -> Callable:
    """A wire world of tiles: a hash of each tile says whether a wire crosses it from side to side, another whether one crosses it from top to
    bottom, and where on it an electron is on its way, a head before its tail; so any block can be made by itself."""

    def fill(y0: int, y1: int, x0: int, x1: int) -> np.ndarray:
        x, y = np.arange(x0, x1)[None, :], np.arange(y0, y1)[:, None]
        ix, iy = x % TILE, y % TILE
        out = np.zeros((y1 - y0, x1 - x0), "i4")
        whole = (x // TILE * TILE + TILE <= width) & (y // TILE * TILE + TILE <= height)  # no electron is cut off at the edge
        share = lambda h: (h >> np.uint64(40)).astype("f8") / float(1 << 24)
        for kind, along, across in ((0, ix, iy), (1, iy, ix)):
            h = _placed_tiles(x // TILE, y // TILE, seed * 2 + kind)
            wire = (share(h) < ACROSS) & (across == TILE // 2)
            out[wire] = 3
            # Electrons keep clear of the crossing in the middle of a tile.
            head = 3 + (h % np.uint64(TILE // 2 - 4)).astype("i8")
            runs = wire & whole & (h >> np.uint64(8) & np.uint64(3) == 0)
            out[runs & (along == head)] = 1
            out[runs & (along == head - 1)] = 2
        return out

    return fill


def _placed_tiles(tx: np.ndarray, ty: np.ndarray, salt: int) -> np.ndarray:
    shape = np.broadcast_shapes(tx.shape, ty.shape)
    return hash_ints(np.asarray(salt), hash_ints(ty, np.broadcast_to(hash_ints(tx, np.uint64(42)), shape)))


def circuit(spark: SparkSession, automaton: Automaton, width: int, height: int, seed: int = DEFAULT_SEED) -> Grid:
    """The circuit's cells, made in bands of rows."""
    fill = _circuit_of(width, height, seed)
    step = max(1, CHUNK // width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                y0, y1 = k * step, min(height, (k + 1) * step)
                s = fill(y0, y1, 0, width)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(width, dtype="i4"), y1 - y0)), pa.array(np.repeat(np.arange(y0, y1, dtype="i4"), width)), pa.array(s.reshape(-1))], names=["x", "y", "s"])

    bands = -(-height // step)
    return Grid(spark.range(0, bands, 1, bands).mapInArrow(run, "x int, y int, s int"), width, height, automaton.states)
