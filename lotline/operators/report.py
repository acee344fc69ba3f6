"""Match quality, coverage and key-overlap reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lotline.functions.geo import to_fixed
from lotline.functions.values import trim_all
from lotline.operators.bags import NUMBER, first_present, read_bag
from lotline.sources.bands import UNKNOWN


def _percent(part: Column, whole: Column, digits: int) -> Column:
    share = F.when(whole == 0, F.lit(0.0)).otherwise(F.try_divide(part.cast("double"), whole.cast("double")) * 100)
    return to_fixed(share, digits)


def quality_report(df: DataFrame) -> DataFrame:
    """One row: buildings by match status, ambiguous ones, and percentages to two decimals."""
    status = F.col("join_status")
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "matched").alias("matched"),
        F.count_if(status == "unmatched").alias("unmatched"),
        F.count_if(status == "invalid_year").alias("invalid_year"),
        F.count_if("join_ambiguous").alias("ambiguous"),
    )
    percent = _percent(F.col("matched"), F.col("total"), 2)
    return counts.select("*", percent.alias("match_pct"), percent.alias("valid_year_coverage_pct"))


def band_counts(df: DataFrame, bands: DataFrame) -> DataFrame:
    """Matched buildings per band: configured bands in order, also empty ones, then any others."""
    key = F.coalesce(F.nullif("id", F.lit("")), F.nullif("label", F.lit("")), F.lit(UNKNOWN))
    configured = bands.select(key.alias("age_band"), "band_ord", F.lit(0).cast("bigint").alias("n"))
    matched = df.filter("join_status = 'matched'").select(
        "age_band", F.lit(None).cast("int").alias("band_ord"), F.lit(1).cast("bigint").alias("n")
    )
    # Configured bands are rows that count nothing: one aggregate, combined before it is shuffled.
    return configured.unionByName(matched).groupBy("age_band").agg(
        F.min("band_ord").alias("band_ord"), F.sum("n").alias("n_buildings")
    ).select("band_ord", "age_band", "n_buildings")


def year_coverage(df: DataFrame, bag: str = "properties") -> DataFrame:
    """Share of features whose year is a number; numeric text does not count."""

    rows, values = read_bag(df, ["year_built", "Condition_YearBuilt"], bag)
    # A null value gives way to the next key, just as an absent one does.
    is_number = first_present(*values.values()).kind == NUMBER
    counts = rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(is_number).alias("with_year"),
    )
    return counts.select("*", _percent(F.col("with_year"), F.col("total"), 1).alias("coverage_pct"))


def _key_sides(properties: DataFrame, buildings: DataFrame) -> DataFrame:
    """One row per id: on which sides it occurs and where it is first seen among properties.

    Both inputs are ``(ord, id)`` with raw truthy ids. Ids are only trimmed here. An id that is
    blank after that counts on the building side but not on the property side.
    """
    left = properties.select(trim_all(F.col("id")).alias("id"), "ord").filter("id <> ''")
    right = buildings.filter("id <> ''").select(trim_all(F.col("id")).alias("id"))
    ord_type = properties.schema["ord"].dataType.simpleString()
    tagged = left.select("id", "ord", F.lit(False).alias("is_building")).unionByName(
        right.selectExpr("id", f"cast(null as {ord_type}) as ord", "true as is_building")
    )
    return tagged.groupBy("id").agg(
        F.min("ord").alias("first_ord"),
        F.bool_or(~F.col("is_building")).alias("in_properties"),
        F.bool_or("is_building").alias("in_buildings"),
    )


def key_overlap(properties: DataFrame, buildings: DataFrame) -> DataFrame:
    """Distinct ids on both sides and of their intersection; one shuffle for all three."""
    return _key_sides(properties, buildings).agg(
        F.count_if("in_properties").alias("property_ids"),
        F.count_if("in_buildings").alias("building_ids"),
        F.count_if(F.col("in_properties") & F.col("in_buildings")).alias("common_ids"),
    )


def key_overlap_sample(properties: DataFrame, buildings: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` common ids in order of their first occurrence among properties."""
    return (
        _key_sides(properties, buildings)
        .filter("in_properties and in_buildings")
        .orderBy("first_ord")
        .limit(n)
        .select("id")
    )
