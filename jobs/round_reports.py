"""Daily reports of benchmark rounds, kept up as rounds come in.

The events table is a log of rounds: a user is a configuration (automaton, implementation, size), an event a round of it, its value
the milliseconds and its props' ``k`` the checksum; types in ``failed`` are rounds that broke off, types in neither list warm-ups.

Output:

* ``rounds/day=/batch=``: the rounds of each batch, as they came;
* ``reports/day=``: of each configuration and day the rounds and failures, mean, deviation, picoseconds a cell and step, whether checksums agree, and the
  speed-up over the day's baseline of the same automaton and size;
* ``checkpoint``: the stream's own mark of the files that it has taken.

A run takes the files that are new since the last, and makes the reports of the days anew that they have rounds for. A batch that broke off is taken again under its
number and overwrites its own rounds; a round that is delivered again counts once. So any number of runs over the same files leave the same reports.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.automata import AUTOMATA
from gridloom.operators.results import EDGES, IMPLEMENTATIONS, STEPS, report
from jobs.common import Settings, command_line, defaults, log_of

LOG = log_of("round_reports")
ROUNDS = "event_id long, automaton string, impl string, x_size int, y_size int, steps int, time_ms double, checksum string, failed boolean, day date, batch long"
KEYS = ["day", "automaton", "impl", "x_size", "y_size", "steps"]


def _nth(values: tuple | list, number: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(number, F.lit(len(values))).cast("int"))


def rounds_of(events: DataFrame, config: Settings) -> DataFrame:
    """Events as rounds, warm-ups left out; those without a time of day or a user are no rounds."""
    user, kinds = F.col("user_id"), len(IMPLEMENTATIONS)
    size = F.floor(user / (kinds * len(AUTOMATA)))
    failed = F.col("event_type").isin(*config["failed"])
    rows = events.where("ts is not null and user_id is not null").where(failed | F.col("event_type").isin(*config["measured"]))
    return rows.select(
        F.col("event_id").cast("long").alias("event_id"),
        _nth(list(AUTOMATA), F.floor(user / kinds)).alias("automaton"),
        _nth(list(IMPLEMENTATIONS), user).alias("impl"),
        _nth(EDGES, size).alias("x_size"),
        _nth(EDGES, size).alias("y_size"),
        _nth(STEPS, size).alias("steps"),
        F.col("value").cast("double").alias("time_ms"),
        F.get_json_object("props", "$.k").alias("checksum"),
        failed.alias("failed"),
        F.to_date("ts").alias("day"),
    )


def reports_of(rounds: DataFrame, digits: int) -> DataFrame:
    """A row a configuration and day; deliveries of one round count once, the first by time and checksum."""
    rest = [c for c in rounds.columns if c not in ("day", "event_id", "batch")]
    once = rounds.groupBy("day", "event_id").agg(F.min(F.struct(*rest)).alias("_r")).select("day", "event_id", "_r.*")
    counts = once.groupBy(*KEYS).agg(F.count_if(~F.col("failed")).alias("rounds"), F.count_if("failed").alias("failed"))
    timed = report(once.where(~F.col("failed")), KEYS)
    both = counts.join(timed, KEYS, "left")
    base = F.max(F.when(F.col("impl") == "Baseline", F.col("average_time_ms"))).over(Window.partitionBy("day", "automaton", "x_size"))
    out = both.withColumn("speedup", base / F.col("average_time_ms"))
    return reduce(lambda df, c: df.withColumn(c, F.round(c, digits)), ["average_time_ms", "std_time_ms", "average_time_per_cell_ps", "speedup"], out)


def _written(df: DataFrame, path: str, *partitions: str) -> int:
    """Write over the partitions that ``df`` has rows of, and no others; how many rows that were."""
    seen = Observation()
    # Dealt by size, so that a day of very many rows is several files and small days share a task.
    df.hint("rebalance", partitions[0]).observe(seen, F.count(F.lit(1)).alias("n")).write.partitionBy(*partitions).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    return seen.get["n"]


def run(spark: SparkSession, tables: str, out: str, config: Settings | None = None) -> dict[str, int]:
    """Take the rounds that are new in ``tables``, bring the reports in ``out`` up to them, and say how many rows were read and written."""
    config = defaults("round_reports") | (config or {})
    path, total = f"{tables}/{config['table']}.parquet", {"batches": 0, "read": 0, "rounds": 0, "reports": 0}

    def take(events: DataFrame, number: int) -> None:
        session, seen = events.sparkSession, Observation()
        new = rounds_of(events.observe(seen, F.count(F.lit(1)).alias("n")), config).withColumn("batch", F.lit(number).cast("long"))
        rounds = _written(new, f"{out}/rounds", "day", "batch")
        reports = 0
        if rounds:
            known = session.read.schema(ROUNDS).parquet(f"{out}/rounds")
            days = known.where(F.col("batch") == number).select("day").distinct()
            reports = _written(reports_of(known.join(days, "day", "left_semi"), config["digits"]), f"{out}/reports", "day")
        for name, n in (("batches", 1), ("read", seen.get["n"]), ("rounds", rounds), ("reports", reports)):
            total[name] += n
        LOG.info("batch %d: read %d events, wrote %d rounds and %d reports", number, seen.get["n"], rounds, reports)

    # As a pattern, as a stream takes a folder by its name but a table of one file only so.
    files = f"{tables}/[{config['table'][0]}]{config['table'][1:]}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(files)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    LOG.info("%s: %s", path, ", ".join(f"{n} {name}" for name, n in total.items()))
    return total


if __name__ == "__main__":
    command_line("round_reports", __doc__.splitlines()[0], run)
