from __future__ import annotations

import pytest

from gridloom import cli
from gridloom.automata import AUTOMATA
from gridloom.operators import results


def row(**kw):
    base = dict(automaton="maze", device="CPU", traverser="simple", evaluator="standard", layout="standard", reference_impl="", x_size=100, y_size=100, steps=10, rounds=1, warmup_rounds=0, x_tile_size=0, y_tile_size=0, cuda_block_size_x=32, cuda_block_size_y=8, seed=42, word_size=0, temporal_steps=0, temporal_tile_size_y=0, average_time_ms=1.0, average_time_per_cell_ps=0.0, std_time_ms=0.0, rounds_had_same_checksums=True, checksum="0")
    return base | kw


def frame(spark, rows):
    names = [c.split()[0] for c in results.SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], results.SCHEMA)


def test_files_round_trip(spark, tmp_path):
    rows = frame(spark, [row(), row(reference_impl="baseline", traverser="", evaluator="", layout="")])
    results.write_results(rows, str(tmp_path / "r"))
    back = results.read_results(spark, str(tmp_path / "r"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_buckets_and_classes(spark):
    rows = frame(spark, [row(x_size=95, y_size=100), row(x_size=80, y_size=100), row(layout="bit_array", evaluator="bit_array", word_size=64), row(layout="odd")])
    got = rows.select(results.size_bucket((10_000, 9_000)), results.implementation()).collect()
    assert [tuple(r) for r in got] == [(10_000, "Standard"), (None, "Standard"), (10_000, "Bit Array (64-bit)"), (10_000, None)]


def test_speedups_skip_automata_without_baseline(spark):
    rows = frame(spark, [row(average_time_ms=2.0), row(average_time_ms=8.0, reference_impl="baseline", traverser=""), row(automaton="wire")])
    ready = results.prepared(rows, (10_000,)).withColumn("run", results.F.monotonically_increasing_id())
    got = {(r.automaton, r.impl): r.speedup for r in results.speedups(ready, ["run"]).collect()}
    assert got == {("maze", "Standard"): 4.0, ("maze", "Baseline"): 1.0}
    table = results.speedup_table(ready, ["run"]).collect()
    assert len(table) == 1 and table[0]["Standard"] == 4.0 and table[0]["Tiled BP (32-bit)"] is None


def test_segments_between_gaps(spark):
    series = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 2.0, None, None, 3.0, None])], "k string, at int, v double")
    got = sorted(tuple(r) for r in results.gap_segments(series, ["k"], "at", "v").select("segment", "first", "last", "points").collect())
    assert got == [(1, 0, 1, 2), (2, 4, 4, 1)]


def test_report(spark):
    rounds = spark.createDataFrame([("a", 10, 10, 4, 1.0, "x"), ("a", 10, 10, 4, 3.0, "x"), ("b", 0, 10, 4, 1.0, "x"), ("b", 0, 10, 4, 1.0, "y")], "k string, x_size int, y_size int, steps int, time_ms double, checksum string")
    got = {r.k: r for r in results.report(rounds, ["k"]).collect()}
    assert (got["a"].average_time_ms, got["a"].std_time_ms, got["a"].average_time_per_cell_ps, got["a"].rounds_had_same_checksums) == (2.0, 1.0, 5e6, True)
    assert (got["b"].average_time_per_cell_ps, got["b"].rounds_had_same_checksums) == (0.0, False)


def test_sweep_and_sizes(spark):
    assert results.sweep(spark, {n: a.states.bits for n, a in AUTOMATA.items()}).count() == 3434
    assert results.effective_tile(32, 8, 1) == 16 and results.effective_tile(32, 8, 4) == 28 and results.effective_tile(8, 9, 8) == 4
    assert results.fitted_size(1000, 8, 4) == (24, 40)


def test_differences(spark):
    a = spark.createDataFrame([(0, 0, 1), (1, 0, 0)], "x int, y int, s int")
    b = spark.createDataFrame([(0, 0, 1), (1, 0, 1)], "x int, y int, s int")
    assert [tuple(r) for r in results.differences(a, b).collect()] == [(1, 0, 0, 1)] and results.differences(a, a).count() == 0


def test_stream_of_results(spark, tmp_path):
    from gridloom.streaming.results_stream import results_stream, running_best

    folder = str(tmp_path / "in")
    results.write_results(frame(spark, [row(average_time_ms=3.0), row(average_time_ms=2.0), row(layout="odd")]), folder)
    query = running_best(results_stream(spark, folder)).writeStream.format("memory").queryName("best").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [tuple(r) for r in spark.table("best").collect()] == [("maze", "Standard", 2.0 / 100_000 * 1e9, 2)]


def test_command_line(spark, capsys):
    assert cli.main(["--print_csv_header"]) == 0
    assert capsys.readouterr().out.strip() == ",".join(c.split()[0] for c in results.SCHEMA.split(", "))
    args = cli.checked(cli.parser().parse_args("--automaton maze --traverser simple --layout standard --x_size 16 --y_size 8 --steps 2 --rounds 2 --warmup_rounds 1 --print".split()))
    line = cli.measure(spark, args)
    assert line["rounds_had_same_checksums"] == "true" and line["checksum"].count("-") == 15 and line["average_time_ms"] > 0
    assert "after step 2" in capsys.readouterr().err
    for bad in ("--automaton maze", "--automaton maze --traverser temporal --layout bit_planes --x_size 8 --y_size 8 --steps 3 --word_size 32 --temporal_steps 2", "--automaton maze --traverser temporal --layout standard --x_size 8 --y_size 8 --steps 2 --temporal_steps 2"):
        with pytest.raises(SystemExit):
            cli.checked(cli.parser().parse_args(bad.split()))
    base = cli.checked(cli.parser().parse_args("--automaton fire --reference_impl baseline --x_size 8 --y_size 8 --steps 2".split()))
    assert cli.measure(spark, base)["reference_impl"] == "baseline"


@pytest.mark.parametrize("plan", ["standard simple", "bit_array simple", "bit_planes simple", "tiled_bit_planes simple", "bit_planes spatial", "bit_planes temporal", "tiled_bit_planes temporal"])
def test_each_plan_is_run_and_verified(spark, capsys, monkeypatch, plan):
    layout, traverser = plan.split()
    ran = []
    for module, name in ((cli.planes, "run_packed"), (cli.bands, "run_bands"), (cli.words, "run"), (cli.tiles, "run"), (cli, "run")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda grid, *a, _real=real, _name=name, **kw: (ran.append((_name, getattr(grid, "kind", type(grid).__name__))), _real(grid, *a, **kw))[1])
    args = cli.checked(cli.parser().parse_args(f"--automaton brian --traverser {traverser} --layout {layout} --x_size 64 --y_size 16 --steps 4 --word_size 64 --temporal_steps 2 --report".split()))
    line = cli.measure(spark, args)
    want = {
        "standard simple": ("run", "Grid"), "bit_array simple": ("run_packed", "bit_array"), "tiled_bit_planes simple": ("run_packed", "tiled"), "bit_planes simple": ("run_packed", "bit_planes"),
        "bit_planes spatial": ("run_bands", "Bands"), "bit_planes temporal": ("run", "WordGrid"), "tiled_bit_planes temporal": ("run", "TileGrid"),
    }[plan]
    assert ran == [want]
    assert cli.verified(spark, args, line) and not cli.verified(spark, args, line | {"checksum": "0"})
    said = capsys.readouterr().err
    assert "the same in every round" in said and "differs from the baseline" in said


def test_plans_that_do_not_exist_are_refused():
    with pytest.raises(SystemExit):
        cli.checked(cli.parser().parse_args("--automaton maze --traverser spatial --layout tiled_bit_planes --x_size 64 --y_size 16 --steps 2 --word_size 64 --temporal_steps 2".split()))


def test_tables(spark):
    from gridloom.operators import tables

    df = spark.createDataFrame([("a<b", 1.5, 3), ("c", 12.25, None)], "name string, speed double, n int")
    text = tables.text_table(df, "Title", digits=2).split("\n")
    assert text[0] == "Title" and text[1].split() == ["name", "speed", "n"] and text[3].split() == ["a<b", "1.50", "3"] and text[4].split() == ["c", "12.25", "-"]
    assert len({len(x) for x in text[2:]}) == 1 and tables.text_table(df, most=1).endswith("(1 rows of more)")
    html = tables.html_page([tables.html_table(df, "T", best="speed", digits=2)], "Page")
    assert "<td>a&lt;b</td>" in html and '<tr class="best"><td>c</td><td>12.25</td>' in html and html.count("<tr") == 3
    assert tables.parameters({"x_size": 3, "seed": 0}) == "x size  3"


def test_checksums_against_baselines(spark):
    rows = frame(spark, [row(checksum="1"), row(checksum="2", layout="odd"), row(checksum="1", reference_impl="baseline"), row(checksum="3", seed=1)])
    assert [r.layout for r in results.checksums_differ(rows).collect()] == ["odd"]
