"""The streaming job: growing input, repeated deliveries, batches that break off, its command line, its SQL."""

from __future__ import annotations

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from jobs import round_reports
from jobs.common import defaults, settings
from jobs.queries import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture
def growing(spark, sf_dir, tmp_path):
    """A copy of the tables' events in two parts: one there, the other to be added."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    early = F.col("event_id") < 600
    tables = tmp_path / "tables"
    events.where(early).coalesce(1).write.parquet(f"{tables}/events.parquet")
    return str(tables), lambda more=events.where(~early): more.coalesce(1).write.mode("append").parquet(f"{tables}/events.parquet")


def test_two_runs_over_growing_input(spark, sf_dir, growing, tmp_path, duck, collected):
    tables, grow = growing
    out = f"{tmp_path}/out"
    first = round_reports.run(spark, tables, out)
    assert first["read"] == 600
    grow()
    second = round_reports.run(spark, tables, out)
    assert second["read"] == 400  # only what is new
    assert round_reports.run(spark, tables, out) == {"batches": 0, "read": 0, "rounds": 0, "reports": 0}
    assert collected(spark.read.parquet(f"{out}/reports")) == duck(ORACLES["job1_round_reports"])


def test_a_day_without_new_rounds_is_left_alone(spark, growing, tmp_path):
    tables, grow = growing
    out = f"{tmp_path}/out"
    round_reports.run(spark, tables, out)
    files = lambda: {p.parent.name: p.name for p in Path(out, "reports").rglob("*.parquet")}
    before = files()
    late = spark.read.parquet(f"{tables}/events.parquet").where("event_type = 'view'").limit(1).withColumn("event_id", F.lit(10**6).cast("long"))
    day = late.select(F.to_date("ts").cast("string")).first()[0]
    grow(late)
    assert round_reports.run(spark, tables, out)["rounds"] == 1
    assert {d for d, name in files().items() if before.get(d) != name} == {f"day={day}"}


def test_repeated_deliveries_count_once(spark, growing, tmp_path, collected):
    tables, grow = growing
    out = f"{tmp_path}/out"
    round_reports.run(spark, tables, out)
    once = collected(spark.read.parquet(f"{out}/reports"))
    grow(spark.read.parquet(f"{tables}/events.parquet"))
    assert round_reports.run(spark, tables, out)["read"] == 600
    assert collected(spark.read.parquet(f"{out}/reports")) == once


def test_a_batch_that_broke_off_is_taken_again(spark, growing, tmp_path, monkeypatch, collected):
    tables, _ = growing
    whole, broken = f"{tmp_path}/whole", f"{tmp_path}/broken"
    round_reports.run(spark, tables, whole)
    with monkeypatch.context() as m:
        m.setattr(round_reports, "reports_of", lambda *a: 1 / 0)  # its rounds are written by then
        with pytest.raises(StreamingQueryException):
            round_reports.run(spark, tables, broken)
    assert spark.read.parquet(f"{broken}/rounds").count() > 0
    round_reports.run(spark, tables, broken)
    for part in ("rounds", "reports"):
        assert collected(spark.read.parquet(f"{broken}/{part}")) == collected(spark.read.parquet(f"{whole}/{part}"))


def test_odd_events(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string, extra int"
    rows = [(1, None, 1, "view", 1.0, "{}", 0), (2, "2024-01-01 00:00:00", None, "view", 1.0, "{}", 0), (3, "2024-01-01 00:00:00", 1, None, 1.0, None, 0), (4, "2024-01-01 10:00:00", 1, "view", None, "not json", 0)]
    df = spark.createDataFrame([(i, None if t is None else t, *r) for i, t, *r in rows], schema.replace("timestamp_ntz", "string")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(f"{tmp_path}/events.parquet")
    assert round_reports.run(spark, str(tmp_path), f"{tmp_path}/out")["rounds"] == 1
    r = spark.read.parquet(f"{tmp_path}/out/reports").first()
    assert (r.rounds, r.failed, r.average_time_ms, r.rounds_had_same_checksums, r.speedup) == (1, 0, None, False, None)


def test_empty_table(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("false").write.parquet(f"{tmp_path}/events.parquet")
    assert round_reports.run(spark, str(tmp_path), f"{tmp_path}/out")["rounds"] == 0


def test_settings(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"digits": 2}))
    assert settings(spark, "round_reports", str(path)) == defaults("round_reports") | {"digits": 2}
    path.write_text(json.dumps({"digit": 2}))
    with pytest.raises(ValueError):
        settings(spark, "round_reports", str(path))


def test_command_line(spark, sf_dir, tmp_path):
    call = [sys.executable, "-m", "jobs.round_reports", "--input", sf_dir, "--output", f"{tmp_path}/out", "--config", str(ROOT / "jobs/round_reports.json")]
    done = subprocess.run(call, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert "read 1000 events" in done.stderr
    assert spark.read.parquet(f"{tmp_path}/out/reports").count() > 0


def test_sql(spark, sf_dir, duck, collected):
    assert collected(QUERIES["job1_round_reports"](spark, sf_dir)) == duck(ORACLES["job1_round_reports"])
