"""The jobs as queries over whole tables, each run twice into a folder of its own, with matching SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.automata import AUTOMATA
from gridloom.operators.results import EDGES, IMPLEMENTATIONS, STEPS
from gridloom.plans.lineage import shared_dir
from gridloom.queries import _RULES, _around_sql, _sized
from jobs import grid_snapshots, round_reports
from jobs.common import defaults


def _twice(spark: SparkSession, job: Callable[..., object], sf_dir: str, name: str) -> str:
    """The output folder of two runs of a job into the same new one."""
    out = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for _ in range(2):
        job(spark, sf_dir, out)
    return out


def job1_round_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _twice(spark, round_reports.run, sf_dir, "job1")
    return spark.read.parquet(f"{out}/reports").withColumn("day", F.col("day").cast("date"))


def _reports_sql() -> str:
    c, kinds = defaults("round_reports"), len(IMPLEMENTATIONS)
    listed = lambda v: "[" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in v) + "]"
    nth = lambda v, i: f"{listed(v)}[CAST(({i}) % {len(v)} AS INT) + 1]"
    size = f"user_id // {kinds * len(AUTOMATA)}"
    rounded = lambda e: f"round({e}, {c['digits']})"
    return f"""
    WITH r AS (
      SELECT event_id, CAST(ts AS DATE) AS day, {nth(list(AUTOMATA), f"user_id // {kinds}")} AS automaton, {nth(list(IMPLEMENTATIONS), "user_id")} AS impl,
             CAST({nth(EDGES, size)} AS INT) AS x_size, CAST({nth(STEPS, size)} AS INT) AS steps, value AS ms, json_extract_string(props, '$.k') AS k, event_type IN ({listed(c["failed"])[1:-1]}) AS bad
      FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL AND event_type IN ({listed(c["measured"] + c["failed"])[1:-1]})),
    g AS (
      SELECT day, automaton, impl, x_size, x_size AS y_size, steps, count(*) FILTER (NOT bad) AS rounds, count(*) FILTER (bad) AS failed, avg(ms) FILTER (NOT bad) AS mean,
             stddev_pop(ms) FILTER (NOT bad) AS std, count(DISTINCT k) FILTER (NOT bad) AS sums FROM r GROUP BY ALL)
    SELECT day, automaton, impl, x_size, y_size, steps, rounds, failed, {rounded("mean")} AS average_time_ms, {rounded("std")} AS std_time_ms,
           {rounded("mean * 1e9::DOUBLE / (CAST(x_size AS DOUBLE) * y_size) / steps")} AS average_time_per_cell_ps, CASE WHEN rounds > 0 THEN sums = 1 END AS rounds_had_same_checksums,
           {rounded("max(CASE WHEN impl = 'Baseline' THEN mean END) OVER (PARTITION BY day, automaton, x_size) / mean")} AS speedup FROM g"""


def job2_grid_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _twice(spark, grid_snapshots.run, sf_dir, "job2")
    return spark.read.schema(grid_snapshots.CELLS).parquet(f"{out}/cells")


def _snapshots_sql() -> str:
    c = defaults("grid_snapshots")
    x, y, last = c["width"], c["height"], c["steps"]
    k, rule = _RULES[c["automaton"]]
    kept = ", ".join(str(g) for g in sorted({*range(0, last + 1, c["every"]), last}))
    return _sized(
        f"""WITH RECURSIVE lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS nth FROM {c["table"]} WHERE text IS NOT NULL),
        n AS (SELECT length(line) % {x} AS kx, (doc_id + nth) % {y} AS ky, count(*) AS n FROM lines GROUP BY 1, 2),
        g AS (SELECT CAST(i % {x} AS INT) AS x, CAST(i // {x} AS INT) AS y, CAST(coalesce(n, 0) % {k} AS INT) AS s FROM range({x * y}) AS r(i) LEFT JOIN n ON i % {x} = kx AND i // {x} = ky),
        r AS (SELECT 0 AS t, x, y, s FROM g UNION ALL SELECT t + 1, x, y, CAST({rule} AS INT) FROM ({_around_sql("r", where=f"WHERE t < {last}")}))
        SELECT CAST(t AS INT) AS generation, CAST(y // {c["rows_per_band"]} AS INT) AS band, x, y, s FROM r WHERE t IN ({kept})""",
        x,
        y,
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_round_reports": job1_round_reports, "job2_grid_snapshots": job2_grid_snapshots}
ORACLES: dict[str, str] = {"job1_round_reports": _reports_sql(), "job2_grid_snapshots": _snapshots_sql()}
