"""Embedding space: pooling, projection and geometric selection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.operators.blocks import order_stats


def mean_pool(frames: DataFrame, clip: Sequence[str], vector: str = "vector") -> DataFrame:
    """Mean over the frames of each clip, one vector per clip.

    Values are averaged per (clip, dimension) with map-side combine, so a clip with very many frames is no hot spot; only
    one row per dimension is gathered per clip.
    """
    long = frames.select(*clip, F.posexplode(vector).alias("_d", "_x"))
    means = long.groupBy(*clip, "_d").agg(F.avg("_x").alias("_m"))
    gathered = means.groupBy(*clip).agg(F.array_sort(F.collect_list(F.struct("_d", "_m"))).alias("_e"))
    return gathered.select(*clip, F.transform("_e", lambda e: e["_m"]).alias("embedding"))


def embedding_rows(df: DataFrame, file: str, vector: str) -> DataFrame:
    """Usable embeddings with their dimension; files without one are skipped."""
    return df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(
        file, F.col(vector).alias("embedding"), F.size(vector).alias("dimension")
    )


def pca(df: DataFrame, file: str, vector: str, k: int = 3) -> DataFrame:
    """Centred PCA coordinates; the sign makes each axis' largest loading positive. Fewer than two rows give none.

    Rows without a vector, or with a value missing from it, are left out; there are no more axes than dimensions.

    Only the mean and the dimension-by-dimension covariance reach the driver, both of the vector's length, never the rows.
    """
    whole = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    data = df.filter(whole).select(file, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    n, mean = data.select(Summarizer.metrics("count", "mean").summary(F.col("_v")).alias("s")).select("s.*").first()
    if n < 2:
        return df.select(file, F.array().cast("array<double>").alias("coordinates")).limit(0)
    model = PCA(k=min(k, mean.size), inputCol="_v", outputCol="_z").fit(data)
    axes = model.pc.toArray()
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    centre = mean.toArray() @ axes
    turned = F.transform(
        vector_to_array("_z"),
        lambda x, i: (x - F.get(F.lit(centre.tolist()), i)) * F.get(F.lit(signs.tolist()), i),
    )
    return model.transform(data).select(file, turned.alias("coordinates"))


def spatial_regions(points: DataFrame, x: str, y: str) -> DataFrame:
    """Name the region of each point by the ordinal quartiles of both axes, read as scalars by the projection."""
    axes = points.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("axis"), F.col(c).cast("double").alias("v")) for n, c in (("x", x), ("y", y))]))
    )
    found = order_stats(axes, ["axis"], "v", {"q1": ("floor_n", 0.25), "q3": ("floor_n", 0.75)})
    of = [F.max(F.when(F.col("axis") == n, F.col(q))).alias(n + q[1]) for n in "xy" for q in ("q1", "q3")]
    placed = points.withColumn("_q", found.agg(F.struct(*of)).scalar())
    px, py = F.col(x), F.col(y)
    x1, x3, y1, y3 = (F.col(f"_q.{n}") for n in ("x1", "x3", "y1", "y3"))
    region = (
        F.when((px > x3) & (py > y3), "region1")
        .when((px < x1) & (py > y3), "region2")
        .when((px < x1) & (py < y1), "region3")
        .when((px > x3) & (py < y1), "region4")
        .when(px.between(x1, x3) & py.between(y1, y3), "center")
        .when(px.between(x1, x3), "mid_vertical")
        .when(py.between(y1, y3), "mid_horizontal")
        .otherwise("unknown")
    )
    return placed.withColumn("region", region).drop("_q")


def angle_to_plane(x: Column, y: Column, z: Column, plane: str) -> Column:
    """Degrees between a point's vector and a coordinate plane; 0 at the origin."""
    normal = {"xy": z, "xz": y, "yz": x}[plane]
    length = F.sqrt(x * x + y * y + z * z)
    return F.when(length == 0, 0.0).otherwise(90 - F.degrees(F.acos(F.abs(normal) / length)))


def select_by_angle(points: DataFrame, coords: str, plane: str, low: float = 40.0, high: float = 50.0) -> DataFrame:
    """Points with at least three coordinates whose angle lies in [low, high]."""
    c = F.col(coords)
    angle = angle_to_plane(F.get(c, F.lit(0)), F.get(c, F.lit(1)), F.get(c, F.lit(2)), plane)
    return points.filter(F.size(coords) >= 3).withColumn("angle", angle).filter(F.col("angle").between(low, high))


def select_box(points: DataFrame, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float]) -> DataFrame:
    return points.filter(F.col(x).between(*x_range) & F.col(y).between(*y_range))


def select_lasso(points: DataFrame, x: str, y: str, polygon: Sequence[tuple[float, float]]) -> DataFrame:
    """Points inside a polygon by the even-odd rule; the polygon's edges are literals of the filter."""
    px, py = F.col(x), F.col(y)
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in zip(polygon, [*polygon[1:], polygon[0]]):
        if y0 == y1:
            continue
        spans = (F.lit(y0) > py) != (F.lit(y1) > py)
        at = F.lit(x0) + (py - y0) * ((x1 - x0) / (y1 - y0))
        crossings = crossings + (spans & (px < at)).cast("int")
    return points.filter(crossings % 2 == 1)


def axis_bounds(points: DataFrame, axes: Sequence[str], pad: float = 1.1) -> DataFrame:
    """Smallest and largest value of each axis times ``pad``; 0 for an empty axis."""
    return points.agg(
        *[F.coalesce(F.min(a) * pad, F.lit(0.0)).alias(f"{a}_low") for a in axes],
        *[F.coalesce(F.max(a) * pad, F.lit(0.0)).alias(f"{a}_high") for a in axes],
    )


def restrict_to(df: DataFrame, selection: DataFrame, key: str) -> DataFrame:
    """The rows of a selected cohort."""
    return df.join(selection.select(key), key, "left_semi")


def analyses_for(model: str) -> tuple[str, ...]:
    """Which analyses a selection feeds, by model family."""
    if model.startswith("whisper"):
        return ("terms", "features")
    if model.startswith("wav2vec2"):
        return ("labels", "features")
    return ("features",)
