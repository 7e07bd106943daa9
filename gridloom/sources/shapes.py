"""Grids drawn from a table of shapes: segments, outlines of rectangles, and circles.

A shape is cut into runs of at most RUN steps before it is drawn, and runs are dealt over tasks, so that one shape of any size is drawn
by many tasks and no row holds more than one run. Cells are combined before they are shuffled, so what is shuffled is at most a row a cell and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.grid import Grid, States, skeleton

#: Steps along a shape that one row draws.
RUN = 1024
#: Radii and sides are below this, so that squares are whole numbers of a double.
LARGEST = 1 << 25
KINDS = ("segment", "rectangle", "circle")


def segment(x0: Column, y0: Column, x1: Column, y1: Column, state: Column, layer: Column) -> Column:
    """A shape as a structure: the cells from one end to the other, one a step of the longer side, halves rounded up."""
    return _shape("segment", x0, y0, x1, y1, state, layer)


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column, state: Column, layer: Column) -> Column:
    """The outline between two corners."""
    return _shape("rectangle", x0, y0, x1, y1, state, layer)


def circle(x: Column, y: Column, radius: Column, state: Column, layer: Column) -> Column:
    """The cells whose distance from (x, y) rounds to ``radius``; of radius 0 the cell itself."""
    return _shape("circle", x, y, radius, F.lit(0), state, layer)


def _shape(kind: str, x0: Column, y0: Column, x1: Column, y1: Column, state: Column, layer: Column) -> Column:
    long = [c.cast("long").alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1))]
    return F.struct(F.lit(kind).alias("kind"), *long, state.cast("int").alias("state"), layer.cast("long").alias("layer"))


def _sides(shapes: DataFrame) -> DataFrame:
    """Rectangles as their four sides."""
    side = lambda a, b, c, d: F.struct(*[F.col(o).alias(n) for o, n in zip((a, b, c, d), ("x0", "y0", "x1", "y1"))])
    four = F.array(side("x0", "y0", "x1", "y0"), side("x1", "y0", "x1", "y1"), side("x1", "y1", "x0", "y1"), side("x0", "y1", "x0", "y0"))
    one = F.array(side("x0", "y0", "x1", "y1"))
    cut = shapes.withColumn("_side", F.explode(F.when(F.col("kind") == "rectangle", four).otherwise(one)))
    return cut.select(F.when(F.col("kind") == "circle", "circle").otherwise("segment").alias("kind"), "_side.*", "state", "layer")


def _runs(shapes: DataFrame) -> DataFrame:
    """Rows (.., steps, first, last): the steps that each run takes of the ``steps`` of its shape, dealt over tasks."""
    long_side = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))
    sized = shapes.withColumn("steps", F.when(F.col("kind") == "circle", F.col("x1") * 2).otherwise(long_side))
    cut = sized.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("steps"), F.lit(RUN).cast("long"))))
    # A number of its own, as small rows that grow a thousandfold must not be coalesced by their size.
    tasks = int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut.withColumn("last", F.least(F.col("steps"), F.col("first") + RUN - 1)).repartition(tasks, F.xxhash64(*cut.columns))


def drawn(shapes: DataFrame, width: int, height: int) -> DataFrame:
    """(x, y, s): the cells of ``shapes`` (kind, x0, y0, x1, y1, state, layer) on a torus, each once.

    Of shapes that meet on a cell the one of the highest layer is seen, of one layer the highest state. A circle has its radius in ``x1``. Shapes
    with a null, circles of negative radius and unknown kinds draw nothing; shapes that repeat are one. Sides and radii of LARGEST or more are an error.
    """
    whole = shapes.select("kind", *[F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")], F.col("state").cast("int").alias("state"), F.col("layer").cast("long").alias("layer"))
    whole = whole.dropna().distinct().where(F.col("kind").isin(*KINDS) & ((F.col("kind") != "circle") | (F.col("x1") >= 0)))
    size = F.when(F.col("kind") == "circle", F.col("x1")).otherwise(F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))))
    whole = whole.withColumn("x1", F.when(size < LARGEST, F.col("x1")).otherwise(F.raise_error(F.lit("a shape is too large")).cast("long")))
    runs = _runs(_sides(whole)).withColumn("i", F.explode(F.sequence("first", "last")))

    two, n = F.lit(2), F.greatest(F.col("steps"), F.lit(1))

    def along(a: str, b: str) -> Column:
        up = two * (F.col(b) - F.col(a)) * F.col("i") + n
        return F.col(a) + ((up - F.pmod(up, two * n)) / (two * n)).cast("long")

    segments = runs.where("kind = 'segment'").select(along("x0", "x1").alias("x"), along("y0", "y1").alias("y"), "layer", "state")
    # A column of a circle: squares of distances from r² - r + 1 to r² + r are those that round to r.
    r, dx = F.col("x1"), F.col("i") - F.col("x1")
    inner = F.when(r == 0, F.lit(0)).otherwise(F.greatest(r * r - r + 1 - dx * dx, F.lit(0)))
    columns = runs.where("kind = 'circle'").select(
        (F.col("x0") + dx).alias("x"),
        "y0",
        F.explode(F.sequence(F.ceil(F.sqrt(inner.cast("double"))), F.floor(F.sqrt((r * r + r - dx * dx).cast("double"))))).alias("dy"),
        "layer",
        "state",
    )
    circles = columns.select("x", F.explode(F.array(F.col("y0") - F.col("dy"), F.col("y0") + F.col("dy"))).alias("y"), "layer", "state")
    cells = segments.unionByName(circles).select(F.pmod("x", F.lit(width)).cast("int").alias("x"), F.pmod("y", F.lit(height)).cast("int").alias("y"), "layer", "state")
    return cells.groupBy("x", "y").agg(F.max(F.struct("layer", "state")).alias("top")).select("x", "y", F.col("top.state").alias("s"))


def shapes_grid(shapes: DataFrame, width: int, height: int, states: States, background: int = 0) -> Grid:
    """The whole grid, with ``background`` where nothing is drawn; states that the automaton hasn't stop the job."""
    cells = drawn(shapes, width, height)
    every = skeleton(shapes.sparkSession, width, height).join(cells, ["x", "y"], "left")
    known = F.col("s").isin(*states.ordinals)
    s = F.when(F.col("s").isNull(), background).when(known, F.col("s")).otherwise(F.raise_error(F.concat(F.lit("unknown state "), F.col("s").cast("string"))).cast("int"))
    return Grid(every.select("x", "y", s.cast("int").alias("s")), width, height, states)
