"""Finding the columns of a loosely described property bag from its first row."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from lotline.sources.geojson import has_bag, key_list

# How the three logical columns are recognised, and preferred address columns.
YEAR_PATTERN = r"condition.*year|yearofbuilt|year[_ ]?built|condition_yearbuilt"
LOT_PATTERN = r"gisid|map[_ ]?lot|maplot|gis_id"
ADDRESS_PATTERN = r"address|addr"
ADDRESS_COLUMNS = ["dedupe_selected_address", "dedupe_selected", "address", "addr", "Full_Addr"]


def first_keys(features: DataFrame) -> list[str]:
    """Keys, in document order, of the first row that has properties. One row reaches the driver."""
    # Keys are listed for the one row that is left, not for every row.
    first = features.filter(has_bag()).agg(F.min_by("properties_raw", "ord").alias("raw"))
    return list(first.select(key_list(F.col("raw")).alias("keys")).first()["keys"] or [])


def resolve_key(keys: Iterable[str], pattern: str) -> str | None:
    """First key that contains the pattern, ignoring case."""
    test = re.compile(pattern, re.IGNORECASE)
    return next((k for k in keys if test.search(k)), None)


def resolve_address_key(keys: Iterable[str]) -> str | None:
    keys = list(keys)
    preferred = next((k for k in ADDRESS_COLUMNS if k in keys), None)
    return preferred or resolve_key(keys, ADDRESS_PATTERN)


def resolve_property_keys(features: DataFrame) -> dict[str, str]:
    """The ``year``, ``address`` and ``lot`` columns; ``ValueError`` when one is missing."""
    keys = first_keys(features)
    found = {
        "year": resolve_key(keys, YEAR_PATTERN),
        "address": resolve_address_key(keys),
        "lot": resolve_key(keys, LOT_PATTERN),
    }
    for role, key in found.items():
        if key is None:
            raise ValueError(f"Missing expected {role} column; the first row has {keys}")
    return found
