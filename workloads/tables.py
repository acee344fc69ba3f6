"""Driver tables in the shape of the library's inputs. Every table is used whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lotline.functions.text import normalize_id, year_of
from lotline.functions.values import truthy_text

AS_OF_YEAR = 2026


# Known schemas spare a job per table that would read file footers.
SCHEMAS = {
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "events": "event_id long, user_id long, event_type string, value double, props string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def text(column: str) -> Column:
    return F.col(column).cast("string")


def raw_lot_id() -> Column:
    """Part keys as ids the way spreadsheets leave them: some with a decimal tail, some padded."""
    key = text("p_partkey")
    return (
        F.when(F.col("p_partkey") % 3 == 0, F.concat(key, F.lit(".0")))
        .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" "), key))
        .otherwise(key)
    )


def raw_address() -> Column:
    return F.concat_ws(" ", text("p_size"), "p_name")


def raw_year() -> Column:
    """1580 to 2049: some too early, some too late."""
    return (1580 + F.col("p_partkey") % 470).cast("string")


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"),
        normalize_id(raw_lot_id()).alias("gis_id"),
        truthy_text(raw_address()).alias("address"),
        year_of(raw_year()).alias("year"),
        truthy_text(F.col("p_type")).alias("property_class"),
        truthy_text(F.col("p_brand")).alias("zoning"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item is an address point; two in a hundred do not know their building.

    A third of the map-lots has one building, a third has two, and a third as many as orders.
    """
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice"]
    own = F.col("l_partkey") * 5
    building = F.when(F.col("l_partkey") % 3 == 0, own).when(F.col("l_partkey") % 3 == 1, own + F.col("l_linenumber") % 2)
    building = F.when(F.col("l_quantity") > 1, building.otherwise(F.col("l_orderkey")).cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        F.struct(*order).alias("ord"),
        normalize_id(text("l_partkey")).alias("ml"),
        normalize_id(building).alias("bldg_id"),
    )


def collections(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The three inputs as features on lines, with the keys and loose values that such files have."""
    line = table(spark, sf_dir, "lineitem")
    own = F.col("l_partkey") * 5
    building = F.when(F.col("l_partkey") % 3 == 0, own).when(F.col("l_partkey") % 3 == 1, own + F.col("l_linenumber") % 2)
    building = F.when(F.col("l_quantity") > 1, building.otherwise(F.col("l_orderkey")))
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice"]

    def features(rows: DataFrame, bag: Column, *ord: str, geometry: Column | None = None) -> DataFrame:
        place = F.lit("null") if geometry is None else geometry
        text = F.concat(F.lit('{"type":"Feature","geometry":'), place, F.lit(',"properties":'), F.to_json(bag), F.lit("}"))
        # Lines in the order that counts, over several files.
        return rows.orderBy(*ord).select(text.alias("value"))

    part = table(spark, sf_dir, "part")
    lot = F.when(F.col("p_partkey") % 2 == 0, F.concat(text("p_partkey"), F.lit(".0"))).otherwise(text("p_partkey"))
    property_bag = F.struct(
        lot.alias("Map_Lot"),
        raw_address().alias("dedupe_selected"),
        F.lit("elsewhere").alias("Full_Addr"),
        raw_year().alias("Condition_YearBuilt"),
        F.col("p_type").alias("propertyclass"),
        F.col("p_brand").alias("Zoning"),
    )
    place = F.format_string('{"type":"Point","coordinates":[%d,0]}', "o_orderkey")
    return {
        "properties": features(part, property_bag, "p_partkey"),
        "points": features(line, F.struct(F.col("l_partkey").alias("ML"), building.alias("BldgID")), *order),
        "buildings": features(table(spark, sf_dir, "orders"), F.struct(text("o_orderkey").alias("BLDGID")), "o_orderkey", geometry=place),
    }


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("building_ord"), normalize_id(text("o_orderkey")).alias("bldg_id")
    )


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a place in a box of about 0.16 degrees."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("point_id"),
        "o_orderstatus",
        (F.lit(-71.19) + F.col("o_totalprice") * 0.000000312345679).alias("lon"),
        (F.lit(42.29) + ((F.col("o_custkey") * 104729 + F.col("o_orderkey") * 31) % 16001) * 0.00001).alias("lat"),
    )


def customer_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a place in the same box, with a reach in degrees."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("target_id"),
        "c_mktsegment",
        (F.lit(-71.185) + (F.col("c_acctbal") + 1000.0) * 0.0000129).alias("lon"),
        (F.lit(42.295) + ((F.col("c_custkey") * 7919) % 15013) * 0.00000973).alias("lat"),
        (F.lit(0.00035) + F.col("c_nationkey") * 0.0001).alias("reach"),
    )


def customer_diamonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diamond around every customer: a polygon list with one closed ring."""
    x, y, r = F.col("lon"), F.col("lat"), F.col("reach")
    corners = [(x - r, y), (x, y - r), (x + r, y), (x, y + r), (x - r, y)]
    ring = F.array(*[F.array(cx, cy) for cx, cy in corners])
    return customer_places(spark, sf_dir).select(
        F.col("target_id").alias("polygon_id"),
        F.col("target_id").alias("ord"),
        "c_mktsegment",
        F.array(F.array(ring)).alias("rings"),
    )


def customer_darts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An arrow head upwards around every customer, with a notch from below."""
    x, y, r = F.col("lon"), F.col("lat"), F.col("reach")
    corners = [(x - r, y - r), (x, y - r / 4), (x + r, y - r), (x, y + r), (x - r, y - r)]
    return customer_places(spark, sf_dir).select(
        F.col("target_id").alias("polygon_id"), F.array(F.array(F.array(*[F.array(cx, cy) for cx, cy in corners]))).alias("rings")
    )


def order_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path from every order to the right and back below it; its length goes by the key."""
    x, y, size = F.col("lon"), F.col("lat"), (F.col("point_id") % 7 + 1) * 0.0001
    corners = [(x, y), (x + size, y - size / 8), (x + size / 2, y - size)]
    return order_points(spark, sf_dir).select(
        F.col("point_id").alias("line_id"), F.array(F.array(*[F.array(cx, cy) for cx, cy in corners])).alias("paths")
    )


def customer_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path of two parts at every customer: eastward and up by its reach, then by as much as the key says."""
    x, y, r = F.col("lon"), F.col("lat"), F.col("reach")
    bend = (F.col("target_id") % 13) * 0.0001
    corners = [(x, y), (x + r, y + r / 4), (x + r + bend, y - bend)]
    return customer_places(spark, sf_dir).select(
        F.col("target_id").alias("line_id"), F.array(F.array(*[F.array(cx, cy) for cx, cy in corners])).alias("paths")
    )


def feature_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a change of its order, or of a new feature with a negative id."""
    line = table(spark, sf_dir, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice"]
    op = (
        F.when(F.col("l_returnflag") == "R", "remove").when(F.col("l_returnflag") == "A", "add").otherwise("update")
    )
    is_new = (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")
    return line.select(
        F.struct(*order).alias("ord"),
        op.alias("op"),
        F.when(is_new, -1 - F.col("l_orderkey")).otherwise(F.col("l_orderkey")).alias("id"),
        F.when((op == "add") | (F.col("l_tax") > 0.04), F.concat(F.lit("part "), text("l_partkey"))).alias("geometry"),
        F.when(op == "add", F.create_map(F.lit("status"), "l_linestatus", F.lit("line"), text("l_linenumber")))
        .otherwise(F.create_map(F.lit("status"), F.concat(F.lit("moved "), text("l_suppkey"))))
        .alias("properties"),
        F.when(F.col("l_linenumber") > 4, F.array(F.lit("priority"))).alias("remove_properties"),
        (F.col("l_linenumber") == 7).alias("remove_all_properties"),
    )


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("customer "), text("o_custkey")).alias("geometry"),
        F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority").alias("properties"),
    )


def typed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    bag = F.struct(F.col("o_totalprice").alias("total"), (F.col("o_custkey") % 2 == 0).alias("paid"), F.col("o_orderpriority").alias("priority"))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), text("o_orderkey")).alias("id"), F.lit(None).cast("string").alias("geometry"), F.to_variant_object(bag).alias("properties")
    )


def typed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = F.to_variant_object(F.struct(F.col("ord.l_quantity").alias("total"), F.lit(True).alias("paid")))
    updated = F.to_variant_object(F.struct(F.col("ord.l_suppkey").alias("total")))
    changes = feature_changes(spark, sf_dir).withColumn("properties", F.when(F.col("op") == "add", added).otherwise(updated))
    return changes.withColumn("id", F.concat(F.lit("o"), F.col("id").cast("string")))
