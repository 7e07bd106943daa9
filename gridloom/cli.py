"""Command line: run an automaton and print a line of results, with ``--report`` a report too, with ``--verify`` against the baseline.

    python -m gridloom.cli --automaton game-of-life --layout bit_planes --word_size 32 --x_size 256 --y_size 256 --steps 8
"""

from __future__ import annotations

import argparse
import sys
import time
from statistics import fmean, pstdev

from pyspark.sql import SparkSession

from gridloom.automata import AUTOMATA, automaton
from gridloom.functions.planes import compiles
from gridloom.operators import tables
from gridloom.operators.results import SCHEMA
from gridloom.plans import bands, planes, tiles, words
from gridloom.plans.lineage import cut
from gridloom.plans.run import run
from gridloom.sources.seeded import random_grid, random_words

#: (layout, traverser) to strategy; what isn't here is refused. Names of devices and sizes of tiles are accepted and written to the results, and choose nothing.
STRATEGY = {("standard", "simple"): "cells", ("bit_array", "simple"): "bit_array", ("bit_planes", "simple"): "planes", ("tiled_bit_planes", "simple"): "tiled", ("bit_planes", "spatial"): "blocked",
            ("bit_planes", "temporal"): "strips", ("tiled_bit_planes", "temporal"): "tiles"}
FIELDS = [c.split()[0] for c in SCHEMA.split(", ")]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--automaton", help=", ".join(AUTOMATA))
    p.add_argument("--device", default="CPU")
    p.add_argument("--traverser", default=None, choices=("simple", "spatial", "temporal"))
    p.add_argument("--evaluator", default=None)
    p.add_argument("--layout", default=None, choices=("standard", "bit_array", "bit_planes", "tiled_bit_planes"))
    p.add_argument("--reference_impl", default="", choices=("", "baseline"), help="run cell by cell, whatever the layout")
    for name, default in (("x_size", 0), ("y_size", 0), ("steps", 0), ("word_size", 0), ("x_tile_size", 0), ("y_tile_size", 0), ("temporal_steps", 0), ("temporal_tile_size_y", 0), ("rounds", 1), ("warmup_rounds", 0), ("seed", 42), ("cuda_block_size_x", 32), ("cuda_block_size_y", 8)):
        p.add_argument(f"--{name}", type=int, default=default)
    p.add_argument("--print", action="store_true", help="show the parameters and every generation")
    p.add_argument("--report", action="store_true", help="write a report of the run to stderr")
    p.add_argument("--verify", action="store_true", help="run the baseline of the same size too; the exit code is 1 if checksums differ")
    p.add_argument("--print_csv_header", action="store_true")
    return p


def checked(args: argparse.Namespace) -> argparse.Namespace:
    """The arguments, if those that a run needs are there and fit together."""
    needed = ["automaton", "x_size", "y_size", "steps"] + ([] if args.reference_impl else ["traverser", "layout"])
    if args.layout in ("bit_array", "bit_planes", "tiled_bit_planes") and not args.reference_impl:
        needed.append("word_size")
    if args.traverser == "temporal":
        needed.append("temporal_steps")
    missing = [n for n in needed if not getattr(args, n)]
    if missing:
        raise SystemExit(f"missing required option: {missing[0]}")
    if not args.reference_impl and (args.layout, args.traverser) not in STRATEGY:
        raise SystemExit(f"no plan for layout {args.layout} with traverser {args.traverser}")
    if args.traverser == "temporal" and args.steps % args.temporal_steps:
        raise SystemExit("steps must be a multiple of temporal_steps")
    return args


def result_line(args: argparse.Namespace, times: list[float], checksums: list[str]) -> dict[str, object]:
    mean = fmean(times)
    ps = mean * 1e9 / (args.x_size * args.y_size) / args.steps if args.x_size and args.y_size else 0.0
    made = {"average_time_ms": mean, "average_time_per_cell_ps": ps, "std_time_ms": pstdev(times), "rounds_had_same_checksums": "true" if len(set(checksums)) == 1 else "false", "checksum": checksums[0]}
    return {f: made.get(f, getattr(args, f, None)) if getattr(args, f, None) is not None or f in made else "" for f in FIELDS}


def prepared(spark: SparkSession, args: argparse.Namespace):  # noqa: ANN201
    """(start, advance, checksum): the initial grid made and packed, a function from it to the result's rows, and one from these to the checksum."""
    a = automaton(args.automaton)
    strategy = "cells" if args.reference_impl else STRATEGY[args.layout, args.traverser]
    if strategy == "strips" and args.x_size % words.LANES == 0 and args.temporal_steps <= words.DEPTH and compiles(a.rule, a.states):
        start = random_words(spark, a, args.x_size, args.y_size, args.seed)
        start = start.with_rows(cut(start.rows))
        return start, lambda: words.run(start, a.rule, args.steps, 0, args.temporal_steps).rows, lambda rows: start.with_rows(rows).checksum()
    grid = random_grid(spark, a, args.x_size, args.y_size, args.seed)
    if strategy in ("bit_array", "planes", "tiled"):
        packed = planes.PACK["bit_planes" if strategy == "planes" else strategy](grid, args.word_size)
        packed = planes.Packed(cut(packed.words), packed.kind, packed.width, packed.height, packed.states, packed.word)
        again = lambda rows: planes.Packed(rows, packed.kind, packed.width, packed.height, packed.states, packed.word)
        return packed, lambda: planes.run_packed(packed, a.rule, args.steps).words, lambda rows: again(rows).unpacked().checksum()
    if strategy == "blocked":
        start = bands.from_grid(grid, args.word_size)
        start = start.with_rows(start.rows.persist())
        return start, lambda: bands.run_bands(start, a.rule, args.steps).rows, lambda rows: start.with_rows(rows).unpacked().checksum()
    if strategy == "tiles":
        start = tiles.from_grid(grid, args.word_size)
        start = start.with_rows(cut(start.rows))
        return start, lambda: tiles.run(start, a.rule, args.steps, 0, args.temporal_steps).rows, lambda rows: start.with_rows(rows).grid().checksum()
    grid = grid.with_cells(cut(grid.cells))
    return grid, lambda: run(grid, a.rule, args.steps, strategy, temporal_steps=args.temporal_steps).cells, lambda rows: grid.with_cells(rows).checksum()


def shown(spark: SparkSession, args: argparse.Namespace) -> None:
    """The parameters and every generation, on stderr."""
    a = automaton(args.automaton)
    print(tables.parameters(vars(args)), file=sys.stderr)
    grid = random_grid(spark, a, args.x_size, args.y_size, args.seed)
    grid = grid.with_cells(cut(grid.cells))
    print(grid.rendered(), file=sys.stderr)
    run(grid, a.rule, args.steps, "cells", on_step=lambda t, cells: print(f"\nafter step {t + 1}\n{grid.with_cells(cells).rendered()}", file=sys.stderr))


def measure(spark: SparkSession, args: argparse.Namespace) -> dict[str, object]:
    """Warm-up rounds, then timed ones, each over the same initial grid. A round's time is that of the generations: the grid is packed before, and unpacked and summed after."""
    if args.print:
        shown(spark, args)
    _, advance, checksum = prepared(spark, args)
    times, checksums = [], []
    for number in range(args.warmup_rounds + args.rounds):
        began = time.perf_counter()
        rows = advance().persist()
        rows.count()
        took = (time.perf_counter() - began) * 1000
        if number >= args.warmup_rounds:
            times.append(took)
            checksums.append(checksum(rows).first()[0])
        rows.unpersist()
    line = result_line(args, times, checksums)
    if args.report:
        print(tables.report(line, times, sys.stderr.isatty()), file=sys.stderr)
    return line


def verified(spark: SparkSession, args: argparse.Namespace, line: dict[str, object]) -> bool:
    """Whether the baseline of the same automaton, size, steps and seed gives the same checksum."""
    base = argparse.Namespace(**vars(args) | {"reference_impl": "baseline", "rounds": 1, "warmup_rounds": 0, "print": False, "report": False})
    same = measure(spark, base)["checksum"] == line["checksum"]
    print("verified against the baseline" if same else "differs from the baseline", file=sys.stderr)
    return same


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.print_csv_header:
        print(",".join(FIELDS))
        return 0
    args = checked(args)
    spark = SparkSession.builder.appName("gridloom").getOrCreate()
    line = measure(spark, args)
    print(",".join(str(v) for v in line.values()))
    return 0 if not args.verify or verified(spark, args, line) else 1


if __name__ == "__main__":
    raise SystemExit(main())
