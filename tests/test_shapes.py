"""Shapes drawn into cells, against a brute-force version and with odd rows."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.automata import AUTOMATA
from gridloom.plans.run import run
from gridloom.sources import shapes

SCHEMA = "kind string, x0 long, y0 long, x1 long, y1 long, state int, layer long"


def brute(rows, width, height):
    """Cell by cell: {(x, y): state}."""
    best = {}

    def put(x, y, layer, state):
        key = (x % width, y % height)
        best[key] = max(best.get(key, (layer, state)), (layer, state))

    def line(x0, y0, x1, y1, *rest):
        n = max(abs(x1 - x0), abs(y1 - y0))
        for i in range(n + 1):
            put(x0 + ((x1 - x0) * i * 2 + n) // (2 * n) if n else x0, y0 + ((y1 - y0) * i * 2 + n) // (2 * n) if n else y0, *rest)

    for kind, x0, y0, x1, y1, state, layer in rows:
        if kind == "segment":
            line(x0, y0, x1, y1, layer, state)
        elif kind == "rectangle":
            for a, b, c, d in ((x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0)):
                line(a, b, c, d, layer, state)
        else:
            for dx in range(-x1, x1 + 1):
                for dy in range(-x1, x1 + 1):
                    if math.floor(math.sqrt(dx * dx + dy * dy) + 0.5) == x1:
                        put(x0 + dx, y0 + dy, layer, state)
    return {k: v[1] for k, v in best.items()}


@pytest.mark.parametrize("steps", [3, shapes.RUN])
def test_shapes(spark, monkeypatch, steps):
    rng = random.Random(steps)
    monkeypatch.setattr(shapes, "RUN", steps)
    at = lambda: rng.randint(-30, 60)
    rows = [(k, at(), at(), rng.randint(0, 20) if k == "circle" else at(), at(), rng.randint(1, 3), rng.randint(0, 4)) for k in shapes.KINDS * 12]
    rows += [("circle", 3, 3, 0, 0, 2, 9), ("segment", 5, 5, 5, 5, 1, 9), rows[0], rows[0]]
    got = shapes.drawn(spark.createDataFrame(rows, SCHEMA), 40, 24).collect()
    assert len(got) == len({(r.x, r.y) for r in got})
    assert {(r.x, r.y): r.s for r in got} == brute(rows, 40, 24)


def test_odd_shapes_draw_nothing(spark):
    rows = [("segment", None, 0, 1, 1, 1, 1), ("circle", 0, 0, -1, 0, 1, 1), ("star", 0, 0, 1, 1, 1, 1), (None, 0, 0, 1, 1, 1, 1), ("segment", 0, 0, 1, 1, None, 1)]
    odd = spark.createDataFrame(rows, SCHEMA).withColumn("i", F.lit("clash")).withColumn("steps", F.lit(None))
    assert shapes.drawn(odd, 8, 8).count() == 0
    wire = AUTOMATA["wire"]
    grid = shapes.shapes_grid(odd.limit(0), 8, 8, wire.states, 3).checked()
    assert [tuple(r) for r in grid.histogram().collect()] == [(3, 64)]
    with pytest.raises(Exception, match="too large"):
        shapes.drawn(spark.createDataFrame([("circle", 0, 0, shapes.LARGEST, 0, 1, 1)], SCHEMA), 8, 8).collect()
    with pytest.raises(Exception, match="unknown state 7"):
        shapes.shapes_grid(spark.createDataFrame([("circle", 0, 0, 2, 0, 7, 1)], SCHEMA), 8, 8, wire.states).cells.collect()


def test_a_signal_runs_round_a_rectangle(spark):
    wire = AUTOMATA["wire"]
    made = [("rectangle", 2, 2, 9, 6, 3, 0), ("segment", 4, 2, 4, 2, 1, 1), ("segment", 3, 2, 3, 2, 2, 1)]
    grid = shapes.shapes_grid(spark.createDataFrame(made, SCHEMA), 16, 16, wire.states)
    after = {(r.x, r.y): r.s for r in run(grid, wire.rule, 3).cells.collect()}
    assert [k for k, s in after.items() if s == 1] == [(7, 2)] and [k for k, s in after.items() if s == 2] == [(6, 2)]


def test_a_long_shape_is_drawn_by_many_tasks(spark):
    """One segment of 200,000 steps is cut into runs, each a row."""
    one = spark.createDataFrame([("segment", 0, 0, 200_000, 7, 1, 0)], SCHEMA)
    assert shapes._runs(shapes._sides(one)).count() == -(-200_001 // shapes.RUN)
    assert shapes.drawn(one, 1 << 20, 16).count() == 200_001
