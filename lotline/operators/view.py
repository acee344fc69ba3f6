"""What a reader of the map sees of a building."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lotline.functions.text import display_value
from lotline.operators.bags import OBJECT, first_present, read_bag


# The names under which a shown value may be stored, by preference.
SHOWN = {
    "address": ["address", "Address"],
    "year_built": ["year_built", "Condition_YearBuilt"],
    "age": ["age"],
}


def display_card(df: DataFrame, keep: list[str], bag: str = "properties") -> DataFrame:
    """Popup texts out of a property bag, HTML-safe; missing and compound ones read ``Unknown``."""
    rows, values = read_bag(df, [k for keys in SHOWN.values() for k in keys], bag)
    found = {name: first_present(*[values[k] for k in keys]) for name, keys in SHOWN.items()}
    texts = rows.select(*keep, *[F.when(v.kind != OBJECT, v.text).alias(name) for name, v in found.items()])
    return texts.select(*keep, *[display_value(F.col(name)).alias(name) for name in SHOWN])


def display_card_columns(df: DataFrame, keep: list[str]) -> DataFrame:
    """The same from the typed output columns, without a property bag."""
    return df.select(
        *keep,
        display_value(F.col("Address")).alias("address"),
        display_value(F.col("Condition_YearBuilt"), "number").alias("year_built"),
        display_value(F.col("age"), "number").alias("age"),
    )
