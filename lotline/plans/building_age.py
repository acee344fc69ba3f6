"""The linkage job: properties, address points and buildings in, classified buildings out.

    python -m lotline.plans.building_age PROPERTIES POINTS BUILDINGS OUT [--bands FILE] ...
"""

from __future__ import annotations

import argparse
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from lotline.functions.text import FIRST_VALID_YEAR, normalize_id, year_of
from lotline.operators.bags import first_truthy, first_truthy_or_last, read_bag
from lotline.operators.bands import bands_of_years
from lotline.operators.columns import resolve_property_keys
from lotline.operators.matching import building_age, building_lookup, link_properties, link_to_lots, representative_property
from lotline.operators.report import band_counts, quality_report
from lotline.session import session
from lotline.sources.bands import DEFAULT_BANDS, Band, bands_frame, load_bands, read_bands
from lotline.sources.geojson import has_bag, read_features, read_output, require_path, write_features
from lotline.storage import keep

# The names under which ids and attributes may be stored, by preference.
POINT_LOT_KEYS = ["ml", "ML"]
POINT_BUILDING_KEY = "BldgID"
BUILDING_KEYS = ["BldgID", "BLDGID", "bldgID"]
CLASS_KEYS = ["PropertyClass", "propertyclass"]
ZONING_KEYS = ["Zoning", "zoning"]


def properties_from(features: DataFrame, keys: dict[str, str]) -> DataFrame:
    wanted = [*keys.values(), *CLASS_KEYS, *ZONING_KEYS]
    rows, bag = read_bag(features.filter(has_bag()), wanted)
    return rows.select(
        "ord",
        normalize_id(bag[keys["lot"]].text).alias("gis_id"),
        first_truthy(bag[keys["address"]]).alias("address"),
        year_of(first_truthy(bag[keys["year"]])).alias("year"),
        first_truthy(*[bag[k] for k in CLASS_KEYS]).alias("property_class"),
        first_truthy(*[bag[k] for k in ZONING_KEYS]).alias("zoning"),
    )


def points_from(features: DataFrame) -> DataFrame:
    rows, bag = read_bag(features.filter(has_bag()), [*POINT_LOT_KEYS, POINT_BUILDING_KEY])
    return rows.select(
        "ord",
        normalize_id(first_truthy_or_last(*[bag[k] for k in POINT_LOT_KEYS])).alias("ml"),
        normalize_id(bag[POINT_BUILDING_KEY].text).alias("bldg_id"),
    )


def buildings_from(features: DataFrame) -> DataFrame:
    rows, bag = read_bag(features, BUILDING_KEYS)
    return rows.select(
        F.col("ord").alias("building_ord"),
        "geometry",
        normalize_id(first_truthy_or_last(*[bag[k] for k in BUILDING_KEYS])).alias("bldg_id"),
    )


def link_buildings(
    properties: DataFrame,
    points: DataFrame,
    buildings: DataFrame,
    as_of_year: int,
    bands: list[Band] = DEFAULT_BANDS,
) -> DataFrame:
    """Classified buildings from prepared inputs.

    Matches to buildings that do not exist drop out in the last join, so no semi-join is needed.
    """
    representatives = representative_property(link_properties(properties, points))
    return building_age(buildings, representatives, as_of_year, bands)


def building_age_from_files(
    spark: SparkSession,
    properties_path: str,
    points_path: str,
    buildings_path: str,
    as_of_year: int,
    bands: list[Band] = DEFAULT_BANDS,
    layout: str = "lines",
) -> DataFrame:
    """Read, check and link three feature collections. ``ValueError`` on unusable inputs.

    Properties are taken out of their bags once and kept as narrow rows, points are combined per map-lot as
    they are read, and the lots are kept. Otherwise the filters on their keys would move below the parsing and
    parse every bag again.
    """
    for path in (properties_path, points_path, buildings_path):
        require_path(spark, path)
    properties = read_features(spark, properties_path, layout)
    keys = resolve_property_keys(properties)
    buildings = buildings_from(read_features(spark, buildings_path, layout))
    if buildings.filter("bldg_id <> ''").isEmpty():
        raise ValueError(f"No buildings with an id found in {buildings_path}")
    lots = keep(building_lookup(points_from(read_features(spark, points_path, layout))))
    matches = link_to_lots(keep(properties_from(properties, keys)), lots)
    return building_age(buildings, representative_property(matches), as_of_year, bands)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Link properties to buildings by construction year.")
    parser.add_argument("properties")
    parser.add_argument("points")
    parser.add_argument("buildings")
    parser.add_argument("out")
    parser.add_argument("--bands", help="JSON array of bands (default: built in)")
    parser.add_argument("--layout", default="lines", choices=["document", "lines", "compact", "parquet"])
    parser.add_argument("--out-layout", default="parquet", choices=["parquet", "lines", "collection"])
    parser.add_argument("--as-of-year", type=int, default=date.today().year)
    args = parser.parse_args(argv)

    spark = session()
    if args.bands:
        require_path(spark, args.bands)
    every = read_bands(spark, args.bands) if args.bands else bands_frame(spark)
    bands = load_bands(spark, args.bands) if args.bands else DEFAULT_BANDS
    if bands is None:
        bands = bands_of_years(every, FIRST_VALID_YEAR, args.as_of_year)
    linked = building_age_from_files(
        spark, args.properties, args.points, args.buildings, args.as_of_year, bands, args.layout
    )
    write_features(linked, args.out, args.out_layout)
    # The report reads what was written, rather than linking again.
    result = read_output(spark, args.out, args.out_layout)
    quality_report(result).show(truncate=False)
    band_counts(result, every).orderBy("band_ord").show(truncate=False)


if __name__ == "__main__":
    main()
