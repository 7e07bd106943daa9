"""A long run over a grid made of a text table, kept in snapshots and taken up again where it broke off.

Every line of every text falls on a cell of a torus: its length is the place across, its document's id and its place in the text the place
down; as many lines, modulo the number of states, is the cell's state. The automaton of the settings then runs for ``steps`` generations.

Output:

* ``cells/generation=/band=``: the grid at generation 0, every ``every`` generations and at the last, in bands of rows;
* ``snapshots/generation=``: of each a row with its cells, checksum and what it was made of, written once its cells are there. It is the run's mark.

A run goes on from the last snapshot that has its row, so one that was killed loses no more than ``every`` generations, and one that is done leaves all as
it is. A snapshot belongs to its settings and the files of its table (their number, sizes and times); where those have changed, the run begins
anew and takes the old snapshots' place. With ``verify_with`` each stretch is run by a second strategy too, and a cell that differs stops the job.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.automata import AUTOMATA, Automaton
from gridloom.operators.grid import Grid
from gridloom.operators.results import differences
from gridloom.plans.run import run as run_grid
from gridloom.sources.tables import rasterised
from jobs.common import Settings, command_line, defaults, log_of, read_if_there

LOG = log_of("grid_snapshots")
CELLS = "x int, y int, s int, generation int, band int"
SNAPSHOTS = "made_of string, automaton string, cells long, checksum string, generation int"


def lines_of(texts: DataFrame) -> DataFrame:
    """A row a line with its length and place; null texts have none, and texts without an id are on no cell."""
    lines = texts.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("nth", "line"))
    return lines.select(F.char_length("line").alias("length"), (F.col("doc_id") + F.col("nth")).alias("place"))


def made_of(spark: SparkSession, path: str, config: Settings) -> str:
    """What tells this run from others: its settings, and the number, sizes and times of the table's files. No column of the table is read."""
    files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    found = files.agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"), F.max("file_modification_time").cast("string").alias("last")).first().asDict()
    return json.dumps({k: v for k, v in config.items() if k not in ("strategy", "verify_with", "steps")} | found, sort_keys=True)


def _kept(cells: DataFrame, generation: int, out: str, rows_per_band: int, anew: bool) -> None:
    banded = cells.select("x", "y", "s", F.lit(generation).alias("generation"), F.expr(f"int(y div {rows_per_band})").alias("band"))
    # Dealt by size, so that a band of very many cells is several files; ``anew`` takes the place of all snapshots of another run.
    dealt = banded.hint("rebalance", "band").sortWithinPartitions("y", "x")
    dealt.write.partitionBy("generation", "band").option("partitionOverwriteMode", "static" if anew else "dynamic").mode("overwrite").parquet(f"{out}/cells")


def run(spark: SparkSession, tables: str, out: str, config: Settings | None = None) -> dict[str, object]:
    """Bring the snapshots in ``out`` up to the run that the settings ask for, and say which were there and which were made."""
    config = defaults("grid_snapshots") | (config or {})
    path, a, every, last = f"{tables}/{config['table']}.parquet", AUTOMATA[config["automaton"]], config["every"], config["steps"]
    wanted, mark = sorted({*range(0, last + 1, every), last}), made_of(spark, path, config)
    log = read_if_there(spark, f"{out}/snapshots", SNAPSHOTS).where(F.col("made_of") == mark)
    there = {r.generation for r in log.select("generation").collect()}  # a row a snapshot
    done = [g for i, g in enumerate(wanted) if there.issuperset(wanted[: i + 1])]
    LOG.info("%s: %d of %d snapshots are there", path, len(done), len(wanted))
    for g in wanted[len(done) :]:
        anew = not there and g == 0
        if g == 0:
            cells = rasterised(lines_of(spark.read.parquet(path).select("doc_id", "text")), F.col("length"), F.col("place"), config["width"], config["height"], a.states).cells
        else:
            cells = _advanced(_read(spark, out, wanted[wanted.index(g) - 1], a, config), a, wanted[wanted.index(g) - 1], g, config)
        _kept(cells, g, out, config["rows_per_band"], anew)
        grid = _read(spark, out, g, a, config)
        row = grid.checksum().select(F.lit(mark).alias("made_of"), F.lit(a.name).alias("automaton"), F.lit(config["width"] * config["height"]).cast("long").alias("cells"), "checksum", F.lit(g).alias("generation"))
        row.write.partitionBy("generation").option("partitionOverwriteMode", "static" if anew else "dynamic").mode("overwrite").parquet(f"{out}/snapshots")
        LOG.info("wrote generation %d, %d cells", g, config["width"] * config["height"])
    return {"there": done, "made": wanted[len(done) :]}


def _read(spark: SparkSession, out: str, generation: int, a: Automaton, config: Settings) -> Grid:
    cells = spark.read.schema(CELLS).parquet(f"{out}/cells").where(F.col("generation") == generation).select("x", "y", "s")
    return Grid(cells, config["width"], config["height"], a.states)


def _advanced(grid: Grid, a: Automaton, first: int, last: int, config: Settings) -> DataFrame:
    cells = run_grid(grid, a.rule, last - first, config["strategy"], first).cells
    if config["verify_with"]:
        wrong = differences(cells, run_grid(grid, a.rule, last - first, config["verify_with"], first).cells)
        if not wrong.isEmpty():
            raise ValueError(f"{config['strategy']} and {config['verify_with']} differ in generation {last}, first at {wrong.first()}")
    return cells


if __name__ == "__main__":
    command_line("grid_snapshots", __doc__.splitlines()[0], run)
