"""How many property ids are building ids as they stand, without address points between.

    python -m lotline.plans.key_check PROPERTIES BUILDINGS [--layout lines]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame

from lotline.operators.bags import first_truthy, read_bag
from lotline.operators.report import key_overlap, key_overlap_sample
from lotline.session import session
from lotline.sources.geojson import read_features, require_path
from lotline.storage import keep

# The names under which each side may keep its id, by preference.
PROPERTY_ID_KEYS = ["gisid", "map_lot"]
BUILDING_ID_KEYS = ["BldgID", "BLDGID", "buildingid", "BLDG_ID"]


def _ids(features: DataFrame, keys: list[str]) -> DataFrame:
    rows, bag = read_bag(features, keys)
    # Kept: both reports use it, and a filter would otherwise move below the parsing.
    return keep(rows.select("ord", first_truthy(*[bag[k] for k in keys]).alias("id"))).filter("id is not null")


def key_check(properties: DataFrame, buildings: DataFrame, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """Counts and a sample of common ids from two feature tables."""
    left, right = _ids(properties, PROPERTY_ID_KEYS), _ids(buildings, BUILDING_ID_KEYS)
    return key_overlap(left, right), key_overlap_sample(left, right, n)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Compare property ids with building ids.")
    parser.add_argument("properties")
    parser.add_argument("buildings")
    parser.add_argument("--layout", default="lines", choices=["document", "lines", "compact", "parquet"])
    parser.add_argument("--sample", type=int, default=20)
    args = parser.parse_args(argv)

    spark = session()
    for path in (args.properties, args.buildings):
        require_path(spark, path)
    left, right = (read_features(spark, path, args.layout) for path in (args.properties, args.buildings))
    for table in key_check(left, right, args.sample):
        table.show(args.sample, truncate=False)


if __name__ == "__main__":
    main()
