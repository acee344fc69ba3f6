"""Merging nearby points for an overview at one zoom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lotline.functions.geo import inverse_mercator_lat, inverse_mercator_lon, mercator_x, mercator_y
from lotline.operators.skew import join_lookup
from lotline.storage import keep

# Cluster radius in pixels, tile extent in pixels, smallest cluster.
RADIUS = 40
EXTENT = 512
MIN_POINTS = 2


def cluster_rollup(
    points: DataFrame,
    z: int,
    id: str = "point_id",
    lon: str = "lon",
    lat: str = "lat",
    weight: str | None = None,
    reduce: dict[str, Column] | None = None,
    radius: int = RADIUS,
    extent: int = EXTENT,
    min_points: int = MIN_POINTS,
) -> DataFrame:
    """Clusters and remaining single points at zoom ``z``.

    Points are grouped by square cells of the cluster radius. Unlike a greedy merge this does not
    depend on input order and needs no neighbour search. A group of at least ``min_points`` points
    (by weight) becomes one row at its weighted centre; the rows of smaller groups stay rows of their
    own, equal ones too. ``weight`` may be a fraction; NULL weighs nothing, and a group that weighs
    nothing has its centre at the mean of its places. ``reduce`` names aggregates over the cluster's
    points. ``point_count`` is ``bigint`` without a weight and ``double`` with one.
    """
    cell = F.lit(float(extent * 2**z) / radius)
    n = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1).cast("bigint")
    placed = (
        points.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull())
        .withColumn("_x", mercator_x(F.col(lon)))
        .withColumn("_y", mercator_y(F.col(lat)))
        .withColumn("_n", n)
        .withColumn("_cx", F.floor(F.col("_x") * cell))
        .withColumn("_cy", F.floor(F.col("_y") * cell))
    )
    extra = reduce or {}

    def summed(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_members"),
            F.sum("_n").alias("point_count"),
            F.coalesce(F.try_divide(F.sum(F.col("_x") * F.col("_n")), F.sum("_n")), F.avg("_x")).alias("_mx"),
            F.coalesce(F.try_divide(F.sum(F.col("_y") * F.col("_n")), F.sum("_n")), F.avg("_y")).alias("_my"),
            F.min(id).alias("first_id"),
            *[column.alias(name) for name, column in extra.items()],
        )

    groups = summed(placed, "_cx", "_cy")
    merged = (F.col("point_count") >= min_points) & (F.col("_members") > 1)
    # A lone point is its own group whatever its weight: nothing to join back.
    alone = F.col("_members") == 1
    columns = [
        merged.alias("is_cluster"),
        "first_id",
        inverse_mercator_lon(F.col("_mx")).alias("lon"),
        inverse_mercator_lat(F.col("_my")).alias("lat"),
        "point_count",
        *extra,
    ]
    result = groups.filter(merged | alone).select(*columns)
    if min_points <= 2 and weight is None:
        # Two points are a cluster: no group with more than one stays apart.
        return result
    # The points of large groups find no partner here, but they are shuffled all the same.
    small = groups.filter(~(merged | alone)).select("_cx", "_cy")
    rest = join_lookup(placed, small, ["_cx", "_cy"], "left_semi")
    if extra:
        # Rows are numbered in a written table: numbers of rows that are computed again would differ.
        rest = summed(keep(rest.withColumn("_row", F.monotonically_increasing_id())), "_row")
    else:
        rest = rest.select(F.col("_n").alias("point_count"), F.col("_x").alias("_mx"), F.col("_y").alias("_my"), F.col(id).alias("first_id"))
    return result.unionByName(rest.select(F.lit(False).alias("is_cluster"), *columns[1:]))
