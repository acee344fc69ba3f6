"""Linking properties to buildings through address points.

Inputs are plain columns (see :mod:`lotline.plans.building_age` for where they come from):

properties  ``ord, gis_id, address, year, property_class, zoning``
points      ``ord, ml, bldg_id``
buildings   ``building_ord, bldg_id`` and anything else, e.g. ``geometry``

Ids are normalized and may be ``''``; the other values are NULL when falsy, and ``year`` is parsed.
``ord`` may have any orderable type. Every "first per group" is an aggregate, so a key that holds much of the data is
combined before it is shuffled and never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lotline.functions.text import is_valid_year, street_number
from lotline.functions.values import trim_all
from lotline.operators.bands import band_of_year
from lotline.operators.skew import join_lookup
from lotline.sources.bands import DEFAULT_BANDS, Band

PROPERTY_COLUMNS = ["gis_id", "address", "year", "property_class", "zoning"]


def drop_blank_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows whose normalized key can match something."""
    return df.filter(F.col(key) != "")


def _with_address_key(df: DataFrame, address: str, ord: str) -> DataFrame:
    """Add ``_key``, which sorts addresses by street number, locale order and input order."""
    text = F.col(address)
    key = F.struct(
        text.isNull().alias("missing"),
        street_number(text).alias("number"),
        F.collate(text, "UNICODE").alias("text"),
        F.col(ord).alias("ord"),
    )
    return df.withColumn("_key", key)


def lowest_address(df: DataFrame, keys: list[str], address: str = "address", ord: str = "ord") -> DataFrame:
    """Per group the address with the lowest street number; NULL when all are missing."""
    truthy = df.withColumn("_address", F.when(F.col(address) != "", F.col(address)))
    return _with_address_key(truthy, "_address", ord).groupBy(*keys).agg(
        F.min_by("_address", "_key").alias("lowest_address")
    )


def point_lookup(points: DataFrame) -> DataFrame:
    """One row per map-lot: its first building id, and whether there are several."""
    bldg = F.when(F.col("bldg_id") != "", F.col("bldg_id"))
    return (
        drop_blank_keys(points, "ml")
        .groupBy("ml")
        .agg(
            F.count(F.lit(1)).alias("n_points"),
            # Rows without a building id have no order and so cannot win.
            F.min_by(bldg, F.when(bldg.isNotNull(), F.col("ord"))).alias("bldg_id"),
            F.coalesce(F.min(bldg) != F.max(bldg), F.lit(False)).alias("ambiguous"),
        )
    )


def link_properties(properties: DataFrame, points: DataFrame) -> DataFrame:
    """Properties with the building they reach: ``bldg_id, ambiguous`` beside their own columns.

    The lookup has one row per map-lot, so this never fans out. Points without a building id
    cannot contribute and are dropped before the shuffle.
    """
    return link_to_lots(properties, point_lookup(drop_blank_keys(points, "bldg_id")))


def building_lookup(points: DataFrame) -> DataFrame:
    """One row per map-lot that has a building: :func:`point_lookup` of the points with a building id, less the count.

    Nothing is filtered below the aggregate, so that points just taken out of their bags are not taken out twice:
    a filter on a computed id moves below its computation and computes it once more. Blank ids are left out of
    what is aggregated, and the groups without a building after it.
    """
    bldg, lot = F.when(F.col("bldg_id") != "", F.col("bldg_id")), F.when(F.col("ml") != "", F.col("ml"))
    has_both = bldg.isNotNull() & lot.isNotNull()
    return (
        points.groupBy("ml")
        .agg(
            F.min_by(bldg, F.when(has_both, F.col("ord"))).alias("bldg_id"),
            F.min(F.when(has_both, bldg)).alias("_least"),
            F.max(F.when(has_both, bldg)).alias("_greatest"),
        )
        .filter("_least IS NOT NULL")
        .select("ml", "bldg_id", (F.col("_least") != F.col("_greatest")).alias("ambiguous"))
    )


def link_to_lots(properties: DataFrame, lots: DataFrame) -> DataFrame:
    """Properties with the building of their map-lot; ``lots`` has one row per lot, ``ml, bldg_id, ambiguous``."""
    lookup = lots.select(F.col("ml").alias("gis_id"), "bldg_id", "ambiguous")
    return join_lookup(drop_blank_keys(properties, "gis_id"), lookup, ["gis_id"])


def keep_existing(matches: DataFrame, buildings: DataFrame) -> DataFrame:
    """Matches whose building exists; repeated building ids do not repeat matches."""
    existing = drop_blank_keys(buildings, "bldg_id").select("bldg_id").distinct()
    return join_lookup(matches, existing, ["bldg_id"], "left_semi")


def representative_property(matches: DataFrame) -> DataFrame:
    """One row per building: the property that stands for it.

    The winner is the lowest address. The row is the first one whose trimmed address equals the
    winner's, which may be a row that differs in white space. So rows are combined per building
    and trimmed address first, and per building second: exact, and a building with very many
    properties is spread over its addresses.
    """
    first_row = F.struct("ord", *PROPERTY_COLUMNS)
    per_address = (
        _with_address_key(matches, "address", "ord")
        .withColumn("trimmed", trim_all(F.col("address")))
        .groupBy("bldg_id", "trimmed")
        .agg(
            F.min_by("address", "_key").alias("winner"),
            F.min("_key").alias("_key"),
            F.min_by(first_row, "ord").alias("first"),
            F.count(F.lit(1)).alias("n"),
            F.bool_or("ambiguous").alias("ambiguous"),
        )
    )
    return (
        per_address.groupBy("bldg_id")
        .agg(
            F.min_by(F.struct(F.col("winner").alias("address"), "first"), "_key").alias("chosen"),
            F.sum("n").alias("n_matches"),
            F.bool_or("ambiguous").alias("any_ambiguous"),
        )
        .select(
            "bldg_id",
            "n_matches",
            (F.col("any_ambiguous") | (F.col("n_matches") > 1)).alias("ambiguous"),
            "chosen.address",
            *[F.col(f"chosen.first.{c}").alias(c) for c in PROPERTY_COLUMNS if c != "address"],
        )
    )


def building_age(
    buildings: DataFrame,
    representatives: DataFrame,
    as_of_year: int,
    bands: list[Band] = DEFAULT_BANDS,
) -> DataFrame:
    """Every building once, with its property, age, band and match status."""
    # Blank ids match nothing. They get keys of their own, lower case so that no normalized id
    # equals them, and do not pile up in one partition.
    own_key = F.concat(F.lit("blank-"), F.xxhash64("building_ord").cast("string"))
    keyed = buildings.withColumn("_key", F.when(F.col("bldg_id") != "", F.col("bldg_id")).otherwise(own_key))
    joined = join_lookup(keyed.drop("bldg_id"), representatives.withColumnRenamed("bldg_id", "_key"), ["_key"], "left")

    valid = F.col("n_matches").isNotNull() & is_valid_year(F.col("year"), as_of_year)
    status = (
        F.when(F.col("n_matches").isNull(), "unmatched").when(F.col("_valid"), "matched").otherwise("invalid_year")
    )
    kept = [c for c in buildings.columns if c != "bldg_id"]
    return (
        joined.withColumn("_valid", valid)
        .withColumn("_year", F.when(F.col("_valid"), F.col("year").cast("int")))
        .select(
            *kept,
            F.col("gis_id").alias("GISID"),
            F.col("address").alias("Address"),
            F.col("_year").alias("Condition_YearBuilt"),
            F.col("property_class").alias("PropertyClass"),
            F.col("zoning").alias("Zoning"),
            (F.lit(as_of_year) - F.col("_year")).alias("age"),
            band_of_year(F.col("_year"), bands).alias("age_band"),
            status.alias("join_status"),
            F.coalesce("ambiguous", F.lit(False)).alias("join_ambiguous"),
        )
    )
