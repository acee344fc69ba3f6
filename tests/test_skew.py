"""Keys that hold a third of the rows or more: split by adaptive execution, or combined early."""

import pytest
from pyspark.sql import functions as F

from lotline.operators import containment
from lotline.operators.containment import points_within
from lotline.operators.matching import link_properties, representative_property
from lotline.operators.nearest import nearest
from lotline.operators.report import key_overlap
from lotline.plans.building_age import link_buildings

SMALL_PARTITIONS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def small_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL_PARTITIONS}
    for key, value in SMALL_PARTITIONS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def hot(spark, n, key, name, parts=8):
    """``n`` rows in several files' worth of partitions, half of them with one key."""
    return spark.range(n, numPartitions=parts).select(
        F.col("id").alias("ord"), F.when(F.col("id") % 2 == 0, key).otherwise(F.concat(F.lit("K"), "id")).alias(name)
    )


def test_hot_lot_is_split(spark, small_partitions):
    properties = hot(spark, 20000, "HOT", "gis_id").select(
        "ord",
        "gis_id",
        F.concat(F.col("ord").cast("string"), F.lit(" main street")).alias("address"),
        F.lit(1900).cast("bigint").alias("year"),
        F.lit("a").alias("property_class"),
        F.lit("b").alias("zoning"),
    )
    points = properties.select("ord", F.col("gis_id").alias("ml"), F.concat(F.lit("B"), "gis_id").alias("bldg_id"))
    matches = link_properties(properties, points)
    plan = final_plan(matches)
    assert "SortMergeJoin(skew=true)" in plan
    representatives = {r.bldg_id: r for r in representative_property(matches).filter("n_matches > 1").collect()}
    assert list(representatives) == ["BHOT"]
    assert (representatives["BHOT"].n_matches, representatives["BHOT"].address) == (10000, "0 main street")


def test_hot_building_id_is_split_and_blank_ids_are_spread(spark, small_partitions):
    buildings = spark.range(30000, numPartitions=8).select(
        F.col("id").alias("building_ord"),
        F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, "BHOT").otherwise(F.concat(F.lit("B"), "id")).alias("bldg_id"),
        F.repeat(F.lit("x"), 40).alias("geometry"),
    )
    properties = spark.createDataFrame([(0, "L", "1 a", 1900, None, None)], "ord bigint, gis_id string, address string, year bigint, property_class string, zoning string")
    points = spark.createDataFrame([(0, "L", "BHOT")], "ord bigint, ml string, bldg_id string")
    linked = link_buildings(properties, points, buildings, 2026)
    plan = final_plan(linked)
    assert "SortMergeJoin(skew=true)" in plan
    assert {r.join_status: r["count"] for r in linked.groupBy("join_status").count().collect()} == {
        "matched": 10000,
        "unmatched": 20000,
    }


def test_hot_place_is_split(spark, small_partitions):
    points = spark.range(20000, numPartitions=8).select(
        F.col("id").alias("point_id"),
        F.when(F.col("id") % 2 == 0, 10.0).otherwise(F.col("id") % 170).alias("lon"),
        F.lit(0.5).alias("lat"),
    )
    targets = spark.range(100).select(F.col("id").alias("target_id"), F.col("id").cast("double").alias("lon"), F.lit(0.0).alias("lat"))
    found = nearest(points, targets)
    assert "SortMergeJoin(skew=true)" in final_plan(found)
    assert found.filter("target_id = 10").count() >= 10000
    assert found.count() == 20000


def test_small_polygons_leave_points_where_they_are(spark):
    points = spark.range(100).select(F.col("id").alias("point_id"), (F.col("id") / 50).alias("lon"), F.lit(0.5).alias("lat"))
    square = [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]]]
    polygons = spark.createDataFrame([(1, 1, square)], "polygon_id bigint, ord bigint, rings array<array<array<array<double>>>>")
    plan = points_within(points, polygons)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning(level" not in plan


def test_hot_cell_is_split(spark, small_partitions, monkeypatch):
    monkeypatch.setattr(containment, "BROADCAST_BYTES", 0)
    points = spark.range(40000, numPartitions=8).select(
        F.col("id").alias("point_id"),
        F.when(F.col("id") % 2 == 0, 0.5 + F.col("id") * 1e-7).otherwise(F.col("id") % 170).alias("lon"),
        F.lit(0.5).alias("lat"),
    )
    square = [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]]]
    polygons = spark.createDataFrame([(1, 1, square)], "polygon_id bigint, ord bigint, rings array<array<array<array<double>>>>")
    pairs = points_within(points, polygons)
    assert "SortMergeJoin(skew=true)" in final_plan(pairs)
    assert pairs.count() == 20000


def test_hot_ids_are_combined_before_the_shuffle(spark):
    left = hot(spark, 20000, "HOT", "id")
    df = key_overlap(left, left.select("id"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_max") > plan.index("Exchange hashpartitioning")
    assert df.first().asDict() == {"property_ids": 10001, "building_ids": 10001, "common_ids": 10001}
