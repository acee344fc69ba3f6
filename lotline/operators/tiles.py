"""Counting features per map tile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lotline.functions.geo import Box, mercator_x, mercator_y


def _tile_range(low: Column, high: Column, z: int, buffer: float) -> tuple[Column, Column]:
    size = float(2**z)
    return (
        F.floor(low * F.lit(size) - F.lit(buffer)).cast("int"),
        F.floor(high * F.lit(size) + F.lit(buffer)).cast("int"),
    )


def tile_rollup(df: DataFrame, box: Box, z: int, category: str, buffer: float = 0.0) -> DataFrame:
    """Features per tile of zoom ``z`` and category: ``(z, x, y, category, n_features)``.

    ``box`` is the bounding box in degrees; for points both corners are the point. A feature
    counts in every tile its box meets, widened by ``buffer`` tile widths. Columns wrap around the
    globe, rows end at the poles.

    Equal tile ranges are counted first, so that many features of one place are one range. A range is not
    spread over its tiles: in each row of tiles it adds at its first column and takes away after its
    last, and the running sum along the row is the count of every tile up to the next change. A row has
    as many changes as columns at most, whatever the number of features.
    """
    last = 2**z - 1
    x0, x1 = _tile_range(mercator_x(box.min_x), mercator_x(box.max_x), z, buffer)
    # North is row 0: the box's upper edge gives the first row.
    y0, y1 = _tile_range(mercator_y(box.max_y), mercator_y(box.min_y), z, buffer)
    ranges = (
        df.select(
            F.col(category).alias("category"),
            x0.alias("x0"),
            F.least(x1, x0 + last).alias("x1"),
            F.least(F.greatest(y0, F.lit(0)), F.lit(last)).alias("y0"),
            F.greatest(F.least(y1, F.lit(last)), F.lit(0)).alias("y1"),
        )
        .filter("x0 is not null and y0 is not null and x1 is not null and y1 is not null")
        .groupBy("category", "x0", "x1", "y0", "y1")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rows = ranges.select("category", "x0", "x1", "n", F.explode(F.sequence("y0", "y1")).alias("y"))
    ends = F.array(F.struct(F.col("x0").alias("x"), F.col("n").alias("d")), F.struct((F.col("x1") + 1).alias("x"), (-F.col("n")).alias("d")))
    changes = rows.select("category", "y", F.inline(ends)).groupBy("category", "y", "x").agg(F.sum("d").alias("d")).filter("d <> 0")
    along = Window.partitionBy("category", "y").orderBy("x")
    runs = changes.select("category", "y", "x", F.sum("d").over(along).alias("n"), F.lead("x").over(along).alias("next")).filter("n > 0")
    tiles = runs.select("category", "y", "n", F.explode(F.sequence("x", F.col("next") - 1)).alias("x"))
    return (
        tiles.groupBy(F.pmod("x", F.lit(2**z)).alias("x"), "y", "category")
        .agg(F.sum("n").alias("n_features"))
        .select(F.lit(z).alias("z"), "x", "y", F.col("category").alias(category), "n_features")
    )


def point_tile_rollup(
    df: DataFrame, lon: str, lat: str, z: int, category: str, buffer: float = 0.0
) -> DataFrame:
    """:func:`tile_rollup` of points. Without a buffer a point is in one tile: one aggregate."""
    x, y = F.col(lon), F.col(lat)
    if buffer:
        return tile_rollup(df, Box(x, y, x, y), z, category, buffer)
    size = 2**z
    return (
        df.filter(x.isNotNull() & y.isNotNull())
        .groupBy(
            F.pmod(F.floor(mercator_x(x) * float(size)).cast("int"), F.lit(size)).alias("x"),
            F.least(F.floor(mercator_y(y) * float(size)).cast("int"), F.lit(size - 1)).alias("y"),
            category,
        )
        .agg(F.count(F.lit(1)).alias("n_features"))
        .select(F.lit(z).alias("z"), "x", "y", category, "n_features")
    )
