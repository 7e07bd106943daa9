"""Analytics over benchmark results: one row a measured configuration, in the 24-column schema below."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The columns of a results file, in order.
SCHEMA = (
    "automaton string, device string, traverser string, evaluator string, layout string, reference_impl string, x_size int, y_size int, steps int, rounds int, "
    "warmup_rounds int, x_tile_size int, y_tile_size int, cuda_block_size_x int, cuda_block_size_y int, seed int, word_size int, temporal_steps int, "
    "temporal_tile_size_y int, average_time_ms double, average_time_per_cell_ps double, std_time_ms double, rounds_had_same_checksums boolean, checksum string"
)
_TEXTS = ("automaton", "device", "traverser", "evaluator", "layout", "reference_impl", "checksum")
#: What each implementation is known by; a row belongs to the first whose fields all match.
IMPLEMENTATIONS: dict[str, dict[str, object]] = {
    "Baseline": {"reference_impl": "baseline"},
    "Standard": {"traverser": "simple", "evaluator": "standard", "layout": "standard"},
    "Bit Array (32-bit)": {"traverser": "simple", "evaluator": "bit_array", "layout": "bit_array", "word_size": 32},
    "Bit Array (64-bit)": {"traverser": "simple", "evaluator": "bit_array", "layout": "bit_array", "word_size": 64},
    "Bit Planes (32-bit)": {"traverser": "simple", "evaluator": "bit_planes", "layout": "bit_planes", "word_size": 32},
    "Bit Planes (64-bit)": {"traverser": "simple", "evaluator": "bit_planes", "layout": "bit_planes", "word_size": 64},
    "Tiled BP (32-bit)": {"traverser": "simple", "evaluator": "tiled_bit_planes", "layout": "tiled_bit_planes", "word_size": 32},
    "Tiled BP (64-bit)": {"traverser": "simple", "evaluator": "tiled_bit_planes", "layout": "tiled_bit_planes", "word_size": 64},
    "Temporal Linear (32-bit)": {"traverser": "temporal", "evaluator": "bit_planes", "layout": "bit_planes", "word_size": 32},
    "Temporal Linear (64-bit)": {"traverser": "temporal", "evaluator": "bit_planes", "layout": "bit_planes", "word_size": 64},
    "Temporal Tiled (32-bit)": {"traverser": "temporal", "evaluator": "tiled_bit_planes", "layout": "tiled_bit_planes", "word_size": 32},
    "Temporal Tiled (64-bit)": {"traverser": "temporal", "evaluator": "tiled_bit_planes", "layout": "tiled_bit_planes", "word_size": 64},
}
#: Families of implementations, over all word sizes.
FAMILIES: dict[str, tuple[str, ...]] = {
    "baseline": ("Baseline",),
    "bit_array": ("Bit Array (32-bit)", "Bit Array (64-bit)"),
    "bit_planes": ("Bit Planes (32-bit)", "Bit Planes (64-bit)", "Tiled BP (32-bit)", "Tiled BP (64-bit)"),
    "temporal": ("Temporal Linear (32-bit)", "Temporal Linear (64-bit)", "Temporal Tiled (32-bit)", "Temporal Tiled (64-bit)"),
}
#: Grid edges and step counts of the benchmark sweep, and its other parameters.
EDGES = (4096, 8192, 16384, 32768)
STEPS = (1024, 256, 128, 64)
Y_BLOCKS = (2, 4, 8, 16, 32)
WORDS = (32, 64)
TEMPORAL_STEPS = (2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 17, 18, 20, 22, 24)
#: Bytes of the fast memory that a temporal tile's two buffers share, and words of a tile in x.
TILE_BYTES, TILE_WORDS = 48 << 10, 32


def biggest_tile(bits: int, word: int) -> int:
    """The highest temporal tile, a power of two, whose two buffers of bit planes fit."""
    return 1 << (TILE_BYTES // (2 * bits * word // 8 * TILE_WORDS)).bit_length() - 1


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A results file or folder; empty texts stay empty instead of null."""
    rows = spark.read.schema(SCHEMA).csv(path, header=True)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) if c in _TEXTS else F.col(c) for c in rows.columns])


def write_results(rows: DataFrame, path: str) -> None:
    rows.select([c.split()[0] for c in SCHEMA.split(", ")]).write.csv(path, header=True, emptyValue="")


def report(rounds: DataFrame, keys: list[str]) -> DataFrame:
    """From one row a round (keys, x_size, y_size, steps, time_ms, checksum): mean, population deviation, picoseconds a cell and step, equality of checksums."""
    mean = F.avg("time_ms")
    cells = F.first("x_size").cast("double") * F.first("y_size")
    ps = F.when(cells == 0, F.lit(0.0)).otherwise(mean * 1e9 / cells / F.first("steps"))
    return rounds.groupBy(*keys).agg(mean.alias("average_time_ms"), F.stddev_pop("time_ms").alias("std_time_ms"), ps.alias("average_time_per_cell_ps"), (F.count_distinct("checksum") == 1).alias("rounds_had_same_checksums"))


def normalised_ps() -> Column:
    """Picoseconds a cell and step."""
    return F.col("average_time_ms") / (F.col("steps").cast("long") * F.col("x_size") * F.col("y_size")) * 1e9


def throughput(ps: Column) -> Column:
    """Updates of cells a second, in units of 10^12."""
    return 1 / ps


def size_bucket(targets: tuple[int, ...], tolerance: float = 0.1) -> Column:
    """The first target that the number of cells is within ``tolerance`` of; null for none."""
    n = F.col("x_size").cast("long") * F.col("y_size")
    return F.coalesce(*[F.when(F.abs(n - t) <= tolerance * t, F.lit(t).cast("long")) for t in targets])


def implementation() -> Column:
    """Name of the first implementation that a row matches; null for none."""
    matches = lambda fields: reduce(lambda a, b: a & b, [F.col(k).cast("string") == F.lit(str(v)) for k, v in fields.items()])
    return F.coalesce(*[F.when(matches(fields), F.lit(name)) for name, fields in IMPLEMENTATIONS.items()])


def prepared(rows: DataFrame, targets: tuple[int, ...] = tuple(e * e for e in EDGES)) -> DataFrame:
    """Rows with bucket, impl and ps; rows of no bucket or implementation are dropped."""
    return rows.withColumns({"bucket": size_bucket(targets), "impl": implementation(), "ps": normalised_ps()}).where("bucket is not null and impl is not null")


def best(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The quickest row of each group, the first in ``order`` on ties."""
    rest = [c for c in rows.columns if c not in keys]
    top = F.min_by(F.struct(*rest), F.struct("ps", *order)).alias("_top")
    return rows.groupBy(*keys).agg(top).select(*keys, "_top.*")


def sorted_runs(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with their rank in the group by time and their time over the group's best."""
    w = Window.partitionBy(*keys)
    return rows.withColumns({"rank": F.row_number().over(w.orderBy("ps", *order)), "ratio": F.col("ps") / F.min("ps").over(w)})


def speedups(rows: DataFrame, order: list[str]) -> DataFrame:
    """(bucket, automaton, impl, ps, speedup) of the best rows; automata without a baseline are skipped."""
    tops = best(rows.select("bucket", "automaton", "impl", "ps", *order), ["bucket", "automaton", "impl"], order)
    base = tops.where(F.col("impl") == "Baseline").select("bucket", "automaton", F.col("ps").alias("base_ps"))
    return tops.join(base, ["bucket", "automaton"]).select("bucket", "automaton", "impl", "ps", (F.col("base_ps") / F.col("ps")).alias("speedup"))


def speedup_table(rows: DataFrame, order: list[str]) -> DataFrame:
    """``speedups`` with a column for each implementation."""
    return speedups(rows, order).groupBy("bucket", "automaton").pivot("impl", list(IMPLEMENTATIONS)).agg(F.first("speedup"))


def ranked(rows: DataFrame, order: list[str], top: int = 3) -> DataFrame:
    """The ``top`` implementations of each size and automaton by speed-up."""
    place = {name: i for i, name in enumerate(IMPLEMENTATIONS)}
    listed = F.create_map(*[F.lit(x) for pair in place.items() for x in pair])[F.col("impl")]
    w = Window.partitionBy("bucket", "automaton").orderBy(F.desc("speedup"), listed)
    return speedups(rows, order).withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def family_best(rows: DataFrame) -> DataFrame:
    """(bucket, automaton, family, ps): the best of each family of implementations."""
    family = F.coalesce(*[F.when(F.col("impl").isin(*names), F.lit(name)) for name, names in FAMILIES.items()])
    return rows.withColumn("family", family).where("family is not null").groupBy("bucket", "automaton", "family").agg(F.min("ps").alias("ps"))


def time_steps(rows: DataFrame, steps: tuple[int, ...] = TEMPORAL_STEPS) -> DataFrame:
    """(bucket, automaton, layout, temporal_steps, ps, speedup): the best for each number of steps, 1 being the simple traverser; null where nothing ran.

    Speed-ups are against the simple traverser on the same layout; series without one are skipped.
    """
    kept = rows.where(F.col("layout").isin("bit_planes", "tiled_bit_planes") & (F.col("impl") != "Baseline"))
    one = F.when(F.col("traverser") == "simple", 1).otherwise(F.col("temporal_steps"))
    found = kept.select("bucket", "automaton", "layout", one.alias("temporal_steps"), "ps").groupBy("bucket", "automaton", "layout", "temporal_steps").agg(F.min("ps").alias("ps"))
    base = found.where("temporal_steps = 1").select("bucket", "automaton", "layout", F.col("ps").alias("base"))
    wanted = base.select("bucket", "automaton", "layout", "base", F.explode(F.array(*[F.lit(s) for s in (1, *steps)])).alias("temporal_steps"))
    return wanted.join(found, ["bucket", "automaton", "layout", "temporal_steps"], "left").select("bucket", "automaton", "layout", "temporal_steps", "ps", (F.col("base") / F.col("ps")).alias("speedup"))


def gap_segments(series: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Runs of points without a missing value between them: (keys, segment, first, last, points), segments numbered from 1."""
    w = Window.partitionBy(*keys).orderBy(at)
    cut = F.sum(F.when(F.col(value).isNull(), 1).otherwise(0)).over(w)
    runs = series.withColumn("_cut", cut).where(F.col(value).isNotNull()).groupBy(*keys, "_cut").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("points"))
    return runs.withColumn("segment", F.row_number().over(Window.partitionBy(*keys).orderBy("_cut"))).drop("_cut")


def effective_tile(tile: int, temporal_steps: int, cells_per_word: int, radius: float = 1.0) -> int:
    """What is left of a tile's words after halos for so many steps on both sides."""
    halo = -(-int(-(-temporal_steps * radius * 0.999 // 1)) // cells_per_word)
    return tile - 2 * halo


def fitted_size(cells: int, x_divisor: int, y_divisor: int) -> tuple[int, int]:
    """A width near the root and a height near the rest, both rounded down to multiples."""
    root = int(cells**0.5)
    x = root - root % x_divisor
    y = cells // x
    return x, y - y % y_divisor


def sweep(spark: SparkSession, bits: dict[str, int], edges: tuple[int, ...] = (16384,), steps: tuple[int, ...] = (128,)) -> DataFrame:
    """The benchmark's configurations: automata x sizes x block heights x word sizes x temporal steps, without those that can't run.

    One row a run: automaton, impl, cells, steps, y_block, and where they apply word_size, temporal_steps and temporal_tile_size_y.
    """
    automata = spark.createDataFrame([(a, b) for a, b in bits.items()], "automaton string, bits int")
    listed = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} int")
    sizes = spark.createDataFrame([(e * e, s) for e, s in zip(edges, steps)], "cells long, steps int")
    base = automata.crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(listed("y_block", Y_BLOCKS)))  # a handful of constants each
    none = F.lit(None).cast("int")
    plain = base.select("automaton", F.explode(F.array(F.lit("Baseline"), F.lit("Standard"))).alias("impl"), "cells", "steps", "y_block", none.alias("word_size"), none.alias("temporal_steps"), none.alias("temporal_tile_size_y"))
    words = base.crossJoin(F.broadcast(listed("word_size", WORDS)))
    named = lambda prefix: F.concat(F.lit(prefix + " ("), F.col("word_size").cast("string"), F.lit("-bit)"))
    packed = words.select("automaton", F.explode(F.array(*[named(p) for p in ("Bit Array", "Bit Planes", "Tiled BP")])).alias("impl"), "cells", "steps", "y_block", "word_size", none.alias("temporal_steps"), none.alias("temporal_tile_size_y"))
    tile = F.create_map(*[x for w in WORDS for b in sorted(set(bits.values())) for x in (F.lit(f"{w}/{b}"), F.lit(biggest_tile(b, w)))])[F.concat_ws("/", "word_size", "bits")]
    timed = words.crossJoin(F.broadcast(listed("temporal_steps", TEMPORAL_STEPS))).withColumn("temporal_tile_size_y", tile)
    timed = timed.where((F.col("temporal_tile_size_y") >= F.col("y_block")) & (F.col("temporal_tile_size_y") % F.col("y_block") == 0))
    halo = F.ceil(F.col("temporal_steps") * 0.999)
    linear = F.col("temporal_tile_size_y") - 2 * halo > 0
    tiled = F.col("temporal_tile_size_y") - 2 * F.ceil(halo / (F.col("word_size") / 8)) > 0
    kinds = F.filter(F.array(F.when(linear, named("Temporal Linear")), F.when(tiled, named("Temporal Tiled"))), lambda k: k.isNotNull())
    temporal = timed.select("automaton", F.explode(kinds).alias("impl"), "cells", "steps", "y_block", "word_size", "temporal_steps", "temporal_tile_size_y")
    return plain.unionByName(packed).unionByName(temporal)


def checksums_differ(rows: DataFrame) -> DataFrame:
    """Of results rows (automaton, x_size, y_size, steps, seed, checksum, ..) those whose checksum isn't that of the baseline with the same size, steps and seed.

    A configuration without a baseline is not reported; where baselines differ among themselves all rows are.
    """
    keys = ["automaton", "x_size", "y_size", "steps", "seed"]
    base = rows.where(F.col("reference_impl") == "baseline").groupBy(*keys).agg(F.min("checksum").alias("_least"), F.max("checksum").alias("_most"))
    return rows.join(base, keys).where((F.col("checksum") != F.col("_least")) | (F.col("_least") != F.col("_most"))).drop("_least", "_most")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cells (x, y, left, right) in which two grids differ; a verification that, unlike tile sums, misses nothing."""
    both = left.select("x", "y", F.col("s").alias("left")).join(right.select("x", "y", F.col("s").alias("right")), ["x", "y"], "full")
    return both.where(~F.col("left").eqNullSafe(F.col("right")))
