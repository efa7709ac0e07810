"""Many boxes and polygons over one plot, against the test of one shape at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarium.operators import embed, selections
from sonarium.plans import cohort

SHAPE = "selection long, ring array<struct<x:double,y:double>>, is_box boolean"


def by_one(points, shapes):
    """Even-odd rule and box test of every shape and point, in Python."""
    out = []
    for name, ring, is_box in shapes:
        if not ring or len(ring) < 3:
            continue
        for key, x, y in points:
            if x is None or y is None or not np.isfinite([x, y]).all():
                continue
            if is_box:
                xs, ys = [p[0] for p in ring], [p[1] for p in ring]
                hit = min(xs) <= x <= max(xs) and min(ys) <= y <= max(ys)
            else:
                hit = False
                for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]]):
                    if (y0 > y) != (y1 > y) and x < x0 + (y - y0) * ((x1 - x0) / (y1 - y0)):
                        hit = not hit
            if hit:
                out.append((name, key))
    return sorted(out)


def selected(spark, points, shapes, **more):
    p = spark.createDataFrame(points, "id long, x double, y double").withColumns({"selection": F.lit(1), "level": F.lit(2), "part": F.lit(3)})
    s = spark.createDataFrame(shapes, SHAPE).withColumns({"x": F.lit(1), "edges": F.lit(1), "cx": F.lit("a")})
    return selections.select_many(p, s, "id", "x", "y", **more)


def rows(df):
    return sorted((r["selection"], r["id"]) for r in df.collect())


def star(rng, n):
    turn = np.sort(rng.uniform(0, 2 * np.pi, n))
    size = rng.uniform(0.01, 1.5, n) * rng.choice([0.05, 0.4, 3.0])
    mx, my = rng.normal(size=2)
    return [(float(mx + r * np.cos(t)), float(my + r * np.sin(t))) for t, r in zip(turn, size)]


@pytest.mark.parametrize("seed", [1, 2])
def test_many_shapes_equal_one_at_a_time(spark, seed):
    rng = np.random.default_rng(seed)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(700, 2)))]
    points += [(1000 + i, 0.25, -0.5) for i in range(400)] + points[:5]  # a crowded place, repeated rows
    shapes = [(k, star(rng, int(rng.integers(3, 40))), False) for k in range(120)]
    for k in range(120, 180):
        (x0, x1), (y0, y1) = np.sort(rng.normal(size=(2, 2)), axis=1).tolist()
        shapes.append((k, [(x0, y0), (x1, y0), (x1, y1), (x0, y1)], True))
    # crossing edges, edges through points, a box of one point, one around and one beside everything
    shapes += [
        (200, [(-2.0, -2.0), (2.0, 2.0), (2.0, -2.0), (-2.0, 2.0)], False),
        (201, [(0.25, -0.5), (0.25, -0.5), (0.25, -0.5), (0.25, -0.5)], True),
        (202, [(-9.0, -9.0), (9.0, -9.0), (9.0, 9.0), (-9.0, 9.0)], False),
        (203, [(50.0, 50.0), (51.0, 50.0), (51.0, 51.0)], False),
        (204, [points[0][1:], points[1][1:], points[2][1:]], False),
        (204, [points[0][1:], points[1][1:], points[2][1:]], False),
    ]
    got = selected(spark, points, shapes, per_part=50)
    assert rows(got) == by_one(points, shapes)
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    one = spark.createDataFrame(points, "id long, x double, y double")
    lasso = sorted(r["id"] for r in embed.select_lasso(one, "x", "y", shapes[7][1]).collect())
    assert [i for k, i in rows(got) if k == 7] == lasso


def test_many_shapes_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    points = [(1, 0.0, 0.0), (2, None, 0.0), (3, nan, 0.0), (4, inf, 0.0), (None, 1.0, 1.0), (5, -inf, nan)]
    around = [(-1.0, -1.0), (2.0, -1.0), (2.0, 2.0), (-1.0, 2.0)]
    shapes = [(1, around, False), (2, None, False), (3, around[:2], False), (4, [(0.0, nan), *around], False), (5, around, None), (None, around, True), (6, [], True)]
    got = sorted(map(str, ((r["selection"], r["id"]) for r in selected(spark, points, shapes).collect())))
    assert got == sorted(map(str, [(s, i) for s in (1, 5, None) for i in (1, None)]))
    assert rows(selected(spark, [], shapes)) == [] == rows(selected(spark, points, []))
    # all points in one place
    same = [(i, 3.0, 1e9) for i in range(5)]
    assert rows(selected(spark, same, [(1, [(0.0, 0.0), (6.0, 0.0), (3.0, 4e9)], False), (2, [(3.0, 1e9)] * 4, True)])) == [(s, i) for s in (1, 2) for i in range(5)]


def test_cover_grows_with_the_edge(spark):
    bounds = spark.sql("SELECT 0.0D AS x_low, 0.0D AS y_low, 1.0D AS x_size, 1.0D AS y_size")
    disc = [(float(0.5 + 0.4 * np.cos(t)), float(0.5 + 0.4 * np.sin(t))) for t in np.linspace(0, 2 * np.pi, 90, endpoint=False)]
    cells = selections.cover_shapes(spark.createDataFrame([(1, disc, False)], SHAPE), bounds).collect()
    smallest = 1 << selections.LEVELS[-1]
    area = sum((1.0 / (1 << c["level"])) ** 2 for c in cells)
    assert abs(area - np.pi * 0.16) < 0.05
    assert len(cells) < 12 * smallest and sum(not c["inside"] for c in cells) < 5 * smallest
    assert max(len(c["edges"]) for c in cells) < 60 and all(c["inside"] or c["level"] == selections.LEVELS[-1] for c in cells)


def test_select_groups(spark):
    chosen = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1), (2, 9)], "selection long, id long")
    facts = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (3, None)], "id long, label string")
    got = {(r["selection"], r["label"]): (r["count"], r["share"]) for r in selections.select_groups(chosen, facts, "id", "label").collect()}
    assert got == {(1, "a"): (2, 0.5), (1, None): (2, 0.5), (2, "a"): (1, 1.0)}


def test_tasks_grow_with_the_pairs(spark):
    points = [(i, float(i % 50), float(i // 50)) for i in range(2000)]
    around = [(-99.0, -99.0), (99.0, -99.0), (99.0, 99.0), (-99.0, 99.0)]
    small = [(20.5, 20.5), (21.5, 20.5), (21.5, 21.5), (20.5, 21.5)]
    shapes = [(k, around, k % 2 == 0) for k in range(300)] + [(k, small, False) for k in range(300, 600)]
    got = selected(spark, points, shapes, per_part=50, per_task=20_000)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    # all points are in half of the shapes: 600,000 pairs, and adaptive execution would join them in one task
    assert sum(sizes) == 300 * 2000 + 300 and max(sizes) < 100_000


def test_groups_counted_by_cells(spark):
    rng = np.random.default_rng(3)
    points = [(i % 900, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(1000, 2)))] + [(None, 0.0, 0.0), (1, None, 0.0), (2, 0.1, 0.1)]
    facts = [(i, None if i % 11 == 0 else f"g{i % 3}") for i in range(950)] + [(5, "g0"), (7, None), (None, "g1")]
    shapes = [(k, star(rng, 12), False) for k in range(40)] + [(k, [(-2.0, -1.0), (2.5, -1.0), (2.5, 3.0), (-2.0, 3.0)], True) for k in (39, 40, None)]
    p = spark.createDataFrame(points, "id long, x double, y double").withColumns({"selection": F.lit(1), "level": F.lit(2)})
    s, f = spark.createDataFrame(shapes, SHAPE), spark.createDataFrame(facts, "id long, level string")
    got = selections.count_groups(p, s, f, "id", "x", "y", "level", per_part=50)
    expected = selections.select_groups(selections.select_many(p, s, "id", "x", "y"), f, "id", "level")
    assert got.dtypes == expected.dtypes and got.columns == ["selection", "level", "count", "share"]
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_label_counts_make_no_pairs(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=4)], i % 3) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    pairs = cohort.embed_select_many(spark, str(tmp_path)).count()

    def no_pairs(*_, **__):
        raise AssertionError("a row per point and shape")

    monkeypatch.setattr(selections, "select_many", no_pairs)
    assert cohort.embed_many_labels(spark, str(tmp_path)).agg(F.sum("count")).first()[0] == pairs > 0
