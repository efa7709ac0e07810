"""Many selections of a plot at once: shapes become cells of a grid, and points meet the shapes of their cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarium.operators.blocks import attach_small
from sonarium.session import settle

#: The grid: ``2**level`` cells a side. A shape's inner part takes large cells, its edge the smallest ones.
LEVELS = (2, 4, 6)
_STEP = 4
_TINY = 1e-9
CELL = ["level", "cx", "cy"]
#: Edges in a cell that are tested without a function per edge.
_FEW = 4
#: Shapes that one task turns into cells.
_SHAPES_PER_TASK = 2_000


def box_ring(x_low: Column, y_low: Column, x_high: Column, y_high: Column) -> Column:
    """The corners of a box."""
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((x_low, y_low), (x_high, y_low), (x_high, y_high), (x_low, y_high))])


def _finite(*columns: Column) -> Column:
    fine = F.lit(True)
    for c in columns:
        fine = fine & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return fine


def _edges(ring: Column) -> Column:
    def edge(p: Column, i: Column) -> Column:
        q = F.get(ring, F.when(i + 1 < F.size(ring), i + 1).otherwise(0))
        return F.struct(p.x.alias("x0"), p.y.alias("y0"), q.x.alias("x1"), q.y.alias("y1"))

    return F.transform(ring, edge)


def _right(e: Column, px: Column, py: Column) -> Column:
    """1 if the edge lies to the right of the point, else 0; also without an edge."""
    spans = (e.y0 > py) != (e.y1 > py)
    return F.when(spans, (px < e.x0 + (py - e.y0) * ((e.x1 - e.x0) / (e.y1 - e.y0))).cast("int")).otherwise(0)


def inside_edges(edges: Column, px: Column, py: Column) -> Column:
    """Even-odd rule: a point is inside when an odd number of edges lies to its right."""
    return F.aggregate(edges, F.lit(0), lambda n, e: n + _right(e, px, py)) % 2 == 1


def _touches(e: Column, x_low: Column, x_high: Column, y_low: Column, y_high: Column) -> Column:
    """Whether an edge may meet a cell: their extents overlap and the cell is not wholly on one side of the edge's line."""
    sides = [(e.x1 - e.x0) * (y - e.y0) - (e.y1 - e.y0) * (x - e.x0) for x in (x_low, x_high) for y in (y_low, y_high)]
    return (
        (F.greatest(e.x0, e.x1) >= x_low) & (F.least(e.x0, e.x1) <= x_high)
        & (F.greatest(e.y0, e.y1) >= y_low) & (F.least(e.y0, e.y1) <= y_high)
        & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)
    )


def grid_bounds(points: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``x_low, y_low, x_size, y_size``: the extent of all usable points."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    found = points.filter(_finite(a, b)).agg(*[f(c).alias(f"{n}_{m}") for n, c in (("x", a), ("y", b)) for m, f in (("low", F.min), ("high", F.max))])

    def size(n: str) -> Column:
        wide = F.col(f"{n}_high") - F.col(f"{n}_low")
        return F.when(wide > 0, wide).otherwise(1.0).alias(f"{n}_size")

    return found.select("x_low", "y_low", size("x"), size("y"))


def cover_shapes(shapes: DataFrame, bounds: DataFrame) -> DataFrame:
    """``selection, box, level, cx, cy, inside, edges``: grid cells that together hold each shape's part of the plot.

    Beginning with the whole plot, a cell that an edge touches is cut into 16, down to the smallest; cells outside the shape are
    dropped, cells inside it stay as large as they are. Only the smallest cells keep edges, and only those that can count for a point
    of the cell. A shape takes a number of cells that grows with the length of its edge, not with its area; only shapes are shuffled.
    """
    usable = (F.size("ring") >= 3) & F.forall("ring", lambda p: _finite(p.x, p.y))
    grid = bounds.select(F.struct("x_low", "y_low", "x_size", "y_size")).scalar()
    box = F.struct(*[end(F.col(f"ring.{n}")).alias(f"{n}_{m}") for n in "xy" for m, end in (("low", F.array_min), ("high", F.array_max))])
    zero = F.lit(0)
    # by a counted number, as adaptive execution would put few shapes with many cells into one task
    tasks = max(int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shapes.count() // _SHAPES_PER_TASK))
    dealt = shapes.filter(usable).select("selection", "ring", "is_box").repartition(tasks, F.xxhash64("selection", "ring"))
    cells = dealt.select(
        "selection", F.when(F.col("is_box"), box).alias("box"), _edges(F.col("ring")).alias("edges"), grid.alias("grid"),
        zero.alias("level"), zero.alias("cx"), zero.alias("cy"), F.lit(False).alias("inside"),
    ).filter(F.col("grid.x_low").isNotNull())
    for level in LEVELS:
        done = F.col("inside")
        cut = cells.withColumn("k", F.explode(F.when(done, F.array(zero)).otherwise(F.sequence(zero, F.lit(_STEP * _STEP - 1)))))
        cut = cut.withColumns(
            {
                "level": F.when(done, F.col("level")).otherwise(level),
                "cx": F.when(done, F.col("cx")).otherwise(F.col("cx") * _STEP + F.col("k") % _STEP),
                "cy": F.when(done, F.col("cy")).otherwise(F.col("cy") * _STEP + F.floor(F.col("k") / _STEP).cast("int")),
            }
        )
        sides = {}
        for n in "xy":
            size, low = F.col(f"grid.{n}_size") / (1 << level), F.col(f"grid.{n}_low")
            # a point's cell is found with rounding, so cells are taken a little larger
            slack = size * _TINY + (F.abs(low) + F.col(f"grid.{n}_size")) * 1e-14
            sides[f"{n}_from"] = low + F.col(f"c{n}") * size - slack
            sides[f"{n}_to"] = low + (F.col(f"c{n}") + 1) * size + slack
        cut = cut.withColumns(sides)
        x_from, x_to, y_from, y_to = (F.col(c) for c in ("x_from", "x_to", "y_from", "y_to"))
        counting = F.filter(
            "edges", lambda e: (F.greatest(e.y0, e.y1) >= y_from) & (F.least(e.y0, e.y1) <= y_to) & (F.greatest(e.x0, e.x1) >= x_from)
        )
        cut = cut.withColumn("edges", F.when(done, F.col("edges")).otherwise(counting))
        touched = F.exists("edges", lambda e: _touches(e, x_from, x_to, y_from, y_to))
        cut = cut.withColumn("_touched", ~done & touched)
        centre = inside_edges(F.col("edges"), (x_from + x_to) / 2, (y_from + y_to) / 2)
        kept = cut.filter(done | F.col("_touched") | centre)
        cells = kept.select(
            "selection", "box", F.when(F.col("_touched"), F.col("edges")).otherwise(F.slice("edges", 1, 0)).alias("edges"),
            "grid", "level", "cx", "cy", (~F.col("_touched")).alias("inside"),
        )
    return cells.drop("grid")


def _placed(points: DataFrame, bounds: DataFrame, x: str, y: str, **kept: str) -> DataFrame:
    """The kept columns under their new names, ``_x, _y``, and the point's cell ``level, cx, cy`` at each level: a row per level."""
    grid = bounds.select(F.struct("x_low", "y_low", "x_size", "y_size")).scalar()
    placed = points.select(*[F.col(c).alias(n) for n, c in kept.items()], F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    placed = placed.filter(_finite(F.col("_x"), F.col("_y"))).withColumn("_g", grid)

    def at(n: str, level: int) -> Column:
        cell = F.floor((F.col(f"_{n}") - F.col(f"_g.{n}_low")) / F.col(f"_g.{n}_size") * (1 << level))
        return F.least(cell, F.lit((1 << level) - 1)).cast("int")

    levels = F.array(*[F.struct(F.lit(k).alias("level"), at("x", k).alias("cx"), at("y", k).alias("cy")) for k in LEVELS])
    return placed.select(*kept, "_x", "_y", F.inline(levels))


def _meet(keyed: DataFrame, cover: DataFrame, per_part: int, per_task: int) -> DataFrame:
    """Every pair of a point and a shape that share a cell.

    A cell's points and its shapes are both dealt out, and a pair of parts is a key of the join. The tasks are counted from the pairs, so that
    none makes many more than ``per_task``, however many there are in all; adaptive execution sees only the rows that go in.
    """
    shapes = cover.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_m"))
    sizes = settle(keyed.join(F.broadcast(shapes), CELL).groupBy(*CELL, "_m").agg(F.count(F.lit(1)).alias("_n")))
    pairs = int(sizes.agg(F.sum(F.col("_n").cast("decimal(38,0)") * F.col("_m"))).first()[0] or 0)
    tasks = max(keyed.sparkSession.sparkContext.defaultParallelism, -(-pairs // per_task))
    parts = F.broadcast(sizes.select(*CELL, *[F.ceil(F.col(n) / per_part).cast("int").alias(p) for n, p in (("_n", "_of_i"), ("_m", "_of_j"))]))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64(*[c for c in df.columns if c not in CELL]), f"_of{own}").cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(f"_of{other}") - 1))
        placed = df.join(parts, CELL).withColumn(own, part).withColumn(other, every).drop("_of_i", "_of_j")
        return placed.repartition(tasks, *CELL, "_i", "_j")

    return dealt(keyed, "_i", "_j").join(dealt(cover, "_j", "_i"), [*CELL, "_i", "_j"])


def _edge_pairs(keyed: DataFrame, cover: DataFrame, per_part: int, per_task: int) -> DataFrame:
    """The pairs of points and shapes in cells that an edge touches, tested."""
    # a test costs more than a pair that is taken as it is
    met = _meet(keyed.filter(F.col("level") == LEVELS[-1]), cover.filter(~F.col("inside")).drop("inside"), per_part, max(per_task // 4, 1))
    px, py, edges = F.col("_x"), F.col("_y"), F.col("edges")
    in_box = px.between(F.col("box.x_low"), F.col("box.x_high")) & py.between(F.col("box.y_low"), F.col("box.y_high"))
    # most cells hold few edges, which need no function per edge
    few = F.when(F.size(edges) <= _FEW, sum(_right(F.get(edges, F.lit(k)), px, py) for k in range(_FEW)) % 2 == 1)
    return met.filter(F.when(F.col("box").isNotNull(), in_box).otherwise(few.otherwise(inside_edges(edges, px, py))))


def select_many(
    points: DataFrame, shapes: DataFrame, key: str, x: str, y: str, per_part: int = 2_000, per_task: int = 20_000_000
) -> DataFrame:
    """``selection, <key>``: the points of every shape of ``shapes (selection, ring array<struct<x, y>>, is_box)``.

    A ring is a polygon by the even-odd rule, or with ``is_box`` the corners of a box whose edges belong to it. The shapes are rows, so
    there may be any number of them; points meet shapes by an equality on grid cells, and only points of cells that an edge touches are tested.

    The grid has 4,368 cells at most, whatever the data, so the sizes of the cells that shapes use are broadcast: points elsewhere never
    reach the shuffle, and a crowded cell is dealt to one part per ``per_part`` points and as many shapes. The result has a row per point and
    shape, so its size is their product; tasks grow in number with it and make about ``per_task`` pairs each.

    Points with a null, NaN or infinite coordinate are in no shape; rings that are null, have fewer than three corners or such a coordinate
    hold nothing. Repeated points and shapes give repeated rows. Empty tables give no rows. Other columns are ignored.
    """
    bounds = grid_bounds(points, x, y)
    cover = settle(cover_shapes(shapes, bounds))
    keyed = _placed(points, bounds, x, y, _key=key)
    whole = _meet(keyed, cover.filter("inside").select("selection", *CELL), per_part, per_task)
    tested = _edge_pairs(keyed, cover, per_part, per_task)
    return whole.unionByName(tested, allowMissingColumns=True).select("selection", F.col("_key").alias(key))


def select_groups(selected: DataFrame, rows: DataFrame, key: str, by: str) -> DataFrame:
    """``selection, <by>, count, share``: how the rows of every selection fall into groups, equal keys of ``rows`` counted each.

    Rows of a group are counted by the tasks that hold them; only counts are shuffled, and the totals come from the counts.
    """
    counts = selected.join(rows.select(key, by), key).groupBy("selection", by).agg(F.count(F.lit(1)).alias("count"))
    return _with_share(counts)


def count_groups(
    points: DataFrame, shapes: DataFrame, rows: DataFrame, key: str, x: str, y: str, by: str, per_part: int = 2_000, per_task: int = 20_000_000
) -> DataFrame:
    """The counts and shares that :func:`select_groups` gives for :func:`select_many`, without a row per point and shape.

    The groups are counted once per grid cell, and a shape adds up the counts of the cells it holds whole; only in cells that its edge
    touches are points tested one by one.
    """
    bounds = grid_bounds(points, x, y)
    cover = settle(cover_shapes(shapes, bounds))
    at = points.select(F.col(key).alias("_key"), F.col(x).alias("_px"), F.col(y).alias("_py"))
    known = settle(at.join(rows.select(F.col(key).alias("_key"), F.col(by).alias("_by")), "_key"))
    keyed = _placed(known, bounds, "_px", "_py", _key="_key", _by="_by")
    held = keyed.groupBy(*CELL, "_by").agg(F.count(F.lit(1)).alias("_n"))
    whole = attach_small(cover.filter("inside").select("selection", *CELL), held, CELL)
    tested = _edge_pairs(keyed, cover, per_part, per_task).withColumn("_n", F.lit(1).cast("long"))
    found = whole.select("selection", "_by", "_n").unionByName(tested.select("selection", "_by", "_n"))
    return _with_share(found.groupBy("selection", F.col("_by").alias(by)).agg(F.sum("_n").alias("count")))


def _with_share(counts: DataFrame) -> DataFrame:
    total = F.sum("count").over(Window.partitionBy("selection"))
    return counts.withColumn("share", F.col("count") / total)
