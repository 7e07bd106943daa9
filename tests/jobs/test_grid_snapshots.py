"""The snapshot job: reruns, runs that broke off, changed input and settings, verification, its command line, its SQL."""

from __future__ import annotations

import json
import subprocess
import sys
from pathlib import Path

import pytest

from gridloom.plans.run import run as run_grid
from jobs import grid_snapshots
from jobs.queries import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parents[2]
SMALL = {"width": 64, "height": 20, "steps": 5, "every": 2, "rows_per_band": 8, "automaton": "forest-fire"}


def files(out):
    return sorted(str(p) for p in Path(out).rglob("*.parquet"))


def cells(spark, out, collected):
    return collected(spark.read.parquet(f"{out}/cells"))


def test_a_rerun_leaves_all_as_it_is(spark, sf_dir, tmp_path):
    out = f"{tmp_path}/out"
    assert grid_snapshots.run(spark, sf_dir, out, SMALL) == {"there": [], "made": [0, 2, 4, 5]}
    before = files(out)
    assert grid_snapshots.run(spark, sf_dir, out, SMALL) == {"there": [0, 2, 4, 5], "made": []}
    assert files(out) == before
    assert {r.generation: r.cells for r in spark.read.parquet(f"{out}/snapshots").collect()} == dict.fromkeys([0, 2, 4, 5], 1280)


def test_a_run_that_broke_off_goes_on(spark, sf_dir, tmp_path, monkeypatch, collected):
    whole, broken = f"{tmp_path}/whole", f"{tmp_path}/broken"
    grid_snapshots.run(spark, sf_dir, whole, SMALL)
    kept = grid_snapshots._kept

    def killed(rows, generation, *rest):
        kept(rows, generation, *rest)
        if generation == 4:
            raise RuntimeError("killed before its mark")

    with monkeypatch.context() as m:
        m.setattr(grid_snapshots, "_kept", killed)
        with pytest.raises(RuntimeError):
            grid_snapshots.run(spark, sf_dir, broken, SMALL)
    assert grid_snapshots.run(spark, sf_dir, broken, SMALL) == {"there": [0, 2], "made": [4, 5]}
    assert cells(spark, broken, collected) == cells(spark, whole, collected)


def test_more_steps_go_on_and_other_input_begins_anew(spark, sf_dir, tmp_path, collected):
    tables, out, fresh = f"{tmp_path}/tables", f"{tmp_path}/out", f"{tmp_path}/fresh"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.where("doc_id < 100").write.parquet(f"{tables}/documents.parquet")
    grid_snapshots.run(spark, tables, out, SMALL | {"steps": 4})
    assert grid_snapshots.run(spark, tables, out, SMALL | {"steps": 6})["made"] == [6]
    docs.where("doc_id >= 100").write.mode("append").parquet(f"{tables}/documents.parquet")
    assert grid_snapshots.run(spark, tables, out, SMALL | {"steps": 4}) == {"there": [], "made": [0, 2, 4]}
    grid_snapshots.run(spark, tables, fresh, SMALL | {"steps": 4})
    assert cells(spark, out, collected) == cells(spark, fresh, collected)  # nothing of the former run is left


def test_verification_finds_a_wrong_cell(spark, sf_dir, tmp_path, monkeypatch):
    assert grid_snapshots.run(spark, sf_dir, f"{tmp_path}/right", SMALL | {"steps": 2, "verify_with": "cells"})["made"] == [0, 2]

    def wrong(grid, rule, steps, strategy, first):
        made = run_grid(grid, rule, steps, strategy, first)
        return made.with_cells(made.cells.selectExpr("x", "y", "if(x = 3 and y = 4, (s + 1) % 4, s) as s")) if strategy == "planes" else made

    monkeypatch.setattr(grid_snapshots, "run_grid", wrong)
    with pytest.raises(ValueError, match="differ in generation 2"):
        grid_snapshots.run(spark, sf_dir, f"{tmp_path}/wrong", SMALL | {"steps": 2, "strategy": "auto", "verify_with": "planes"})


def test_odd_texts_and_an_empty_table(spark, tmp_path):
    rows = [(None, "on no cell"), (1, None), (2, ""), (-3, "é\n\n" + "x" * 100_000), (2**40, "a\n" * 1000)]
    for name, held in (("odd", rows), ("empty", [])):
        spark.createDataFrame(held, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        grid_snapshots.run(spark, f"{tmp_path}/{name}", f"{tmp_path}/{name}/out", SMALL | {"steps": 0})
        found = {(r.x, r.y): r.s for r in spark.read.parquet(f"{tmp_path}/{name}/out/cells").where("s > 0").collect()}
        want = {}
        for doc, text in held:
            for nth, line in enumerate((text.split("\n") if text is not None else []) if doc is not None else []):
                at = (len(line) % 64, (doc + nth) % 20)
                want[at] = want.get(at, 0) + 1
        assert found == {k: n % 4 for k, n in want.items() if n % 4}


def test_command_line(spark, sf_dir, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps(SMALL | {"steps": 2}))
    call = [sys.executable, "-m", "jobs.grid_snapshots", "--input", sf_dir, "--output", f"{tmp_path}/out", "--config", str(path)]
    done = subprocess.run(call, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert "wrote generation 2, 1280 cells" in done.stderr
    assert spark.read.parquet(f"{tmp_path}/out/cells").count() == 2560


def test_sql(spark, sf_dir, duck, collected):
    assert collected(QUERIES["job2_grid_snapshots"](spark, sf_dir)) == duck(ORACLES["job2_grid_snapshots"])
