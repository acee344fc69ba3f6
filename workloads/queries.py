"""One query per operator, over whole driver tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lotline.functions.geo import polygons_box, round_nested
from lotline.functions.text import normalize_id, parse_year, street_number
from lotline.functions.values import bag_has, truthy_coalesce
from lotline.operators import bands as band_ops
from lotline.operators import matching, report, view
from lotline.operators.bags import first_truthy, read_bag
from lotline.operators.clusters import cluster_rollup
from lotline.operators.containment import hit_test, lines_within, points_within, within_any
from lotline.operators.nearest import nearest, nearest_line, nearest_polygon
from lotline.operators.tiles import point_tile_rollup, tile_rollup
from lotline.operators.upserts import apply_feature_diff
from lotline.plans.building_age import building_age_from_files, link_buildings
from lotline.sources.bands import DEFAULT_BANDS, bands_frame, load_bands
from lotline.sources.geojson import key_list, output_features, read_output, with_bag, write_features
from lotline.storage import new_folder
from workloads import tables
from workloads.tables import AS_OF_YEAR, table, text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register under the function's name, less the underscore that keeps it apart from an import."""
    QUERIES[function.__name__.rstrip("_")] = function
    return function


def _linked(spark: SparkSession, sf_dir: str, buildings: DataFrame | None = None) -> DataFrame:
    return link_buildings(
        tables.properties(spark, sf_dir),
        tables.points(spark, sf_dir),
        tables.buildings(spark, sf_dir) if buildings is None else buildings,
        AS_OF_YEAR,
    )


# --- linkage ------------------------------------------------------------------------------


@query
def building_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir)


@query
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.point_lookup(tables.points(spark, sf_dir))


@query
def building_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = matching.link_properties(tables.properties(spark, sf_dir), tables.points(spark, sf_dir))
    return matching.keep_existing(matches, tables.buildings(spark, sf_dir)).select("gis_id", "bldg_id", "ambiguous")


@query
def representative_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = matching.link_properties(tables.properties(spark, sf_dir), tables.points(spark, sf_dir))
    return matching.representative_property(matches)


@query
def drop_blank_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that know their building."""
    return matching.drop_blank_keys(tables.points(spark, sf_dir), "bldg_id").select("ml", "bldg_id")


@query
def lowest_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(
        "p_brand", "p_type", tables.raw_address().alias("address"), F.col("p_partkey").alias("ord")
    )
    return matching.lowest_address(parts, ["p_brand", "p_type"])


# --- reports ------------------------------------------------------------------------------


@query
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.quality_report(_linked(spark, sf_dir))


@query
def band_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.band_counts(_linked(spark, sf_dir), bands_frame(spark))


def _year_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as property bags whose year is a number, a text, null, absent or a boolean."""
    year = tables.raw_year()
    kind = F.col("p_partkey") % 5
    bag = (
        F.when(kind == 0, F.concat(F.lit('{"year_built":'), year, F.lit("}")))
        .when(kind == 1, F.concat(F.lit('{"year_built":"'), year, F.lit('","Condition_YearBuilt":1900}')))
        .when(kind == 2, F.concat(F.lit('{"year_built":null,"Condition_YearBuilt":'), year, F.lit(".5}")))
        .when(kind == 3, F.concat(F.lit('{"Year_Built":'), year, F.lit("}")))
        .otherwise(F.lit('{"year_built":true}'))
    )
    raw = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"), F.lit(None).cast("string").alias("geometry"), bag.alias("properties_raw")
    )
    return with_bag(raw)


@query
def year_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.year_coverage(_year_bags(spark, sf_dir))


def _overlap_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit(" "), text("l_partkey")).alias("id"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("ord"),
    )
    orders = table(spark, sf_dir, "orders").select(text("o_orderkey").alias("id"))
    return lines, orders


@query
def key_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.key_overlap(*_overlap_sides(spark, sf_dir))


@query
def key_overlap_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.key_overlap_sample(*_overlap_sides(spark, sf_dir))


# --- single functions ---------------------------------------------------------------------


def _variants() -> Column:
    """Texts of many shapes made from a part's columns."""
    key, kind = text("p_partkey"), F.col("p_partkey") % 9
    return (
        F.when(kind == 0, F.concat(key, F.lit(".0")))
        .when(kind == 1, F.concat(F.lit("  "), F.col("p_name"), F.lit("　\t")))
        .when(kind == 2, F.concat(key, F.lit(".0.0")))
        .when(kind == 3, F.concat(key, F.lit(" .0")))
        .when(kind == 4, F.lit(None))
        .when(kind == 5, F.lit(""))
        .when(kind == 6, F.concat(F.lit("00"), text("p_size"), F.lit("-"), key, F.lit(" "), F.col("p_type")))
        .when(kind == 7, F.concat(F.lit("c."), tables.raw_year(), F.lit(".5")))
        .otherwise(F.concat(F.lit("-"), text("p_size"), F.lit("a,"), key))
    )


@query
def normalize_id_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", normalize_id(_variants()).alias("id"))


@query
def street_number_(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = street_number(_variants())
    # Infinity is shown as -1 so that every engine prints the same.
    shown = F.when(number == float("inf"), F.lit(-1.0)).otherwise(number)
    return table(spark, sf_dir, "part").select("p_partkey", shown.alias("street_number"))


@query
def parse_year_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", parse_year(_variants()).alias("year"))


@query
def truthy_coalesce_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first present value; without one the last, be it empty or null."""
    part = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(F.col("p_size") % 4 == 0, F.lit("")).when(F.col("p_size") % 4 == 1, F.col("p_name")).alias("a"),
        F.when(F.col("p_partkey") % 3 == 0, F.lit("")).when(F.col("p_partkey") % 3 == 1, F.col("p_type")).alias("b"),
        F.when(F.col("p_size") % 5 > 1, F.col("p_size")).when(F.col("p_size") % 5 == 1, F.lit(0)).alias("m"),
        F.when(F.col("p_partkey") % 2 == 0, F.lit(0)).alias("n"),
    )
    return part.select(
        "p_partkey",
        truthy_coalesce(F.col("a"), F.col("b")).alias("text_value"),
        truthy_coalesce(F.col("m"), F.col("n"), kind="number").alias("number_value"),
    )


@query
def exact_case_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that differ only in case are different keys."""
    bag = (
        F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.struct(F.col("p_brand").alias("Zoning"))))
        .otherwise(F.to_json(F.named_struct(F.lit("zoning"), "p_type", F.lit("Zone"), F.lit(0))))
    )
    raw = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"), F.lit(None).cast("string").alias("geometry"), bag.alias("properties_raw")
    )
    rows, values = read_bag(with_bag(raw), ["Zone", "Zoning", "zoning"])
    return rows.select(
        F.col("ord").alias("p_partkey"),
        first_truthy(*values.values()).alias("zoning"),
        bag_has(key_list(F.col("properties_raw")), "Zoning").alias("has_upper"),
        bag_has(key_list(F.col("properties_raw")), "Zone").alias("has_zone"),
    )


# --- bands and views ----------------------------------------------------------------------


def _part_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = parse_year(tables.raw_year()).cast("int")
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", F.when(year.between(1600, AS_OF_YEAR), year).alias("year")
    )


def _part_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_years(spark, sf_dir).withColumn("age_band", band_ops.band_of_year(F.col("year")))


@query
def age_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_bands(spark, sf_dir).select("p_partkey", "year", "age_band")


@query
def age_band_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years beyond both ends of the valid range too."""
    years = tables.table(spark, sf_dir, "part").select("p_partkey", (1480 + F.col("p_partkey") % 670).cast("int").alias("year"))
    return band_ops.band_range_join(years, bands_frame(spark)).select("p_partkey", "year", "age_band")


@query
def band_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The legend, with how many parts fall in each band."""
    counts = _part_bands(spark, sf_dir).groupBy("age_band").agg(F.count(F.lit(1)).alias("n"))
    rows = band_ops.legend(bands_frame(spark))
    return rows.join(counts, F.col("id") == F.col("age_band"), "left").select(
        "band_ord", "id", "label", "color", F.coalesce("n", F.lit(0)).alias("n_parts")
    )


@query
def band_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by band colour; bands that are not in the list get the default colour."""
    other = F.when(F.col("p_partkey") % 11 == 0, F.col("p_name")).otherwise(F.col("age_band"))
    parts = _part_bands(spark, sf_dir).withColumn("age_band", other)
    return band_ops.with_color(parts, bands_frame(spark)).select("p_partkey", "age_band", "color")


@query
def band_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected = ["1820_1850", "1980-present", "no such band"]
    return band_ops.filter_bands(_part_bands(spark, sf_dir), selected).select("p_partkey", "age_band")


@query
def display_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("p_name"), F.lit(" & <'"), F.col("p_brand"), F.lit("'>"))
    kind = F.col("p_partkey") % 5
    bag = (
        F.when(kind == 0, F.to_json(F.struct(name.alias("address"), F.col("p_size").alias("age"))))
        .when(kind == 1, F.to_json(F.struct(name.alias("Address"), tables.raw_year().alias("year_built"))))
        .when(kind == 2, F.to_json(F.struct(F.lit(" ").alias("address"), F.lit(True).alias("age"))))
        .when(kind == 3, F.to_json(F.struct(F.struct("p_name").alias("address"), F.array("p_size").alias("age"))))
        .otherwise(
            F.concat(
                F.lit('{"address":null,"Address":"a\\"b","year_built":null,"Condition_YearBuilt":'),
                tables.raw_year(),
                F.lit(".0}"),
            )
        )
    )
    raw = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"), F.lit(None).cast("string").alias("geometry"), bag.alias("properties_raw")
    )
    return view.display_card(with_bag(raw), ["ord"])


# --- features -----------------------------------------------------------------------------


@query
def scan_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as features: their property bag parsed and one value read from it."""
    raw = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"), F.lit(None).cast("string").alias("geometry"), F.col("props").alias("properties_raw")
    )
    rows, values = read_bag(with_bag(raw), ["k"])
    return rows.select(
        F.col("ord").alias("event_id"),
        values["k"].text.cast("bigint").alias("k"),
        values["k"].kind.alias("k_type"),
        F.array_join(key_list(F.col("properties_raw")), ",").alias("keys"),
    )


@query
def linked_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job from feature collections on disk: checks, columns by the first bag, a list of bands, linking."""
    folder = new_folder(spark, "collections")
    for name, features in tables.collections(spark, sf_dir).items():
        features.write.text(f"{folder}/{name}")
    entries = [{"id": b.id, "label": b.label, "minYear": b.min_year, "maxYear": b.max_year, "color": b.color} for b in DEFAULT_BANDS]
    spark.createDataFrame([(json.dumps(entries),)], "value string").coalesce(1).write.text(f"{folder}/bands")
    paths = (f"{folder}/{name}" for name in ("properties", "points", "buildings"))
    linked = building_age_from_files(spark, *paths, AS_OF_YEAR, load_bands(spark, f"{folder}/bands"))
    key = F.get_json_object("geometry", "$.coordinates[0]").cast("bigint")
    return linked.withColumn("building_ord", key).drop("geometry")


@query
def written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified buildings written as features on lines and read back with their types."""
    places = tables.buildings(spark, sf_dir).withColumn(
        "geometry", F.format_string('{"type":"Point","coordinates":[%d,0.5]}', "building_ord")
    )
    folder = new_folder(spark, "features")
    write_features(_linked(spark, sf_dir, places), folder, "lines")
    key = F.get_json_object("geometry", "$.coordinates[0]").cast("double").cast("bigint")
    return read_output(spark, folder, "lines").withColumn("building_ord", key).drop("geometry")


@query
def round_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as lines of 32 coordinates."""
    e = F.col("embedding")
    line = F.transform(
        F.sequence(F.lit(0), F.lit(31)), lambda i: F.array(e[i * 2].cast("double"), e[i * 2 + 1].cast("double"))
    )
    rounded = table(spark, sf_dir, "embeddings").select("vec_id", round_nested(line, 2).alias("line"))
    return rounded.select("vec_id", F.posexplode("line").alias("pos", "p")).select(
        "vec_id", "pos", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat")
    )


@query
def feature_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output features as text, each with a point geometry."""
    places = tables.order_points(spark, sf_dir).select(
        F.col("point_id").alias("building_ord"),
        text("point_id").alias("bldg_id"),
        F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))).alias("geometry"),
    )
    return output_features(_linked(spark, sf_dir, places))


@query
def feature_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, changes = tables.order_features(spark, sf_dir), tables.feature_changes(spark, sf_dir)
    return apply_feature_diff(base, changes).select(
        "id", "geometry", *[F.try_element_at("properties", F.lit(k)).alias(k) for k in ("status", "priority", "line")]
    )


@query
def feature_diff_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same changes to open bags with numbers and booleans, under ids that are texts."""
    base, changes = tables.typed_features(spark, sf_dir), tables.typed_changes(spark, sf_dir)
    total = F.expr("try_variant_get(properties, '$.total', 'variant')")
    return apply_feature_diff(base, changes).select(
        "id",
        total.cast("double").alias("total"),
        F.schema_of_variant(total).alias("total_type"),
        F.try_variant_get("properties", "$.paid", "boolean").alias("paid"),
        F.try_variant_get("properties", "$.priority", "string").alias("priority"),
    )


# --- places -------------------------------------------------------------------------------


@query
def tile_rollup_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return point_tile_rollup(tables.order_points(spark, sf_dir), "lon", "lat", 14, "o_orderstatus")


@query
def tile_rollup_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    diamonds = tables.customer_diamonds(spark, sf_dir)
    return tile_rollup(diamonds, polygons_box(F.col("rings")), 15, "c_mktsegment", buffer=0.25)


@query
def points_within_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points_within(tables.order_points(spark, sf_dir), tables.customer_diamonds(spark, sf_dir))


@query
def within_any_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return within_any(tables.order_points(spark, sf_dir), tables.customer_diamonds(spark, sf_dir))


@query
def lines_within_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the orders inside polygons that are not convex, so that a path may leave between its corners."""
    return lines_within(tables.order_paths(spark, sf_dir), tables.customer_darts(spark, sf_dir))


@query
def hit_test_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hit_test(tables.order_points(spark, sf_dir), tables.customer_diamonds(spark, sf_dir))


@query
def nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(tables.order_points(spark, sf_dir), tables.customer_places(spark, sf_dir))
    return found.select("point_id", "target_id", F.round("metres", 3).alias("metres"))


@query
def nearest_polygon_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diamond nearest to every order; many lie inside several."""
    found = nearest_polygon(tables.order_points(spark, sf_dir), tables.customer_diamonds(spark, sf_dir))
    return found.select("point_id", "target_id", F.round("metres", 3).alias("metres"))


@query
def nearest_line_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer's path nearest to every order."""
    found = nearest_line(tables.order_points(spark, sf_dir), tables.customer_paths(spark, sf_dir))
    return found.select("point_id", "target_id", F.round("metres", 3).alias("metres"))


@query
def cluster_rollup_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of 0, 1, 1.5 and NULL, copies of rows, and clusters from three points on."""
    places = tables.order_points(spark, sf_dir)
    places = places.unionByName(places.filter("point_id % 10 = 0"))
    weight = F.expr("CASE point_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN 1.5 END")
    clusters = cluster_rollup(places.withColumn("w", weight), 16, weight="w", min_points=3)
    return clusters.select("is_cluster", "first_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "point_count")


@query
def cluster_rollup_(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = cluster_rollup(tables.order_points(spark, sf_dir), 16)
    return clusters.select(
        "is_cluster",
        "first_id",
        F.round("lon", 6).alias("lon"),
        F.round("lat", 6).alias("lat"),
        "point_count",
    )
