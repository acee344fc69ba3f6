"""Age bands: classifying years, colours and the legend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lotline.operators.skew import join_lookup
from lotline.sources.bands import DEFAULT_BANDS, MAX_INLINE_BANDS, UNKNOWN, Band

# Fixed value: the colour of rows whose band has none.
DEFAULT_COLOR = "#999999"


# A lookup table for bands reaches from the first to the last bound; a longer one is not built.
MAX_TABLE_YEARS = 10_000


def _band_of(year: int, bands: list[Band]) -> str:
    for band in bands:
        above = band.min_year is None or year >= band.min_year
        below = band.max_year is None or year <= band.max_year
        if above and below:
            return band.key
    return UNKNOWN


def band_of_year(year: Column, bands: list[Band] = DEFAULT_BANDS) -> Column:
    """Id of the first band that holds the year; ``unknown`` for NULL. No join.

    Bands only change at their bounds, so all years before the first and after the last bound
    behave alike. What lies between is a constant array with one entry per year, and the year
    expression occurs once, however costly it is.
    """
    bounds = [y for b in bands for y in (b.min_year, b.max_year) if y is not None]
    low, high = (min(bounds), max(bounds)) if bounds else (0, 0)
    years = high - low + 1
    if years > MAX_TABLE_YEARS:
        return _band_case(year, bands)
    # Position 0 is every earlier year, the last position every later one, NULL stays NULL.
    entries = F.expr("array(" + ", ".join(_sql_text(_band_of(y, bands)) for y in range(low - 1, high + 2)) + ")")
    position = F.width_bucket(year.cast("double"), F.lit(float(low)), F.lit(float(high + 1)), F.lit(years))
    return F.coalesce(F.get(entries, position.cast("int")), F.lit(UNKNOWN))


def _sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _band_case(year: Column, bands: list[Band]) -> Column:
    result = F.when(year.isNull(), UNKNOWN)
    for band in bands:
        test = F.lit(True)
        if band.min_year is not None:
            test = test & (year >= band.min_year)
        if band.max_year is not None:
            test = test & (year <= band.max_year)
        result = result.when(test, band.key)
    return result.otherwise(UNKNOWN)


def band_by_year(bands: DataFrame, low: Column, high: Column) -> DataFrame:
    """The years from ``low`` to ``high`` that a band holds, with the first such: ``(year, age_band)``."""
    key = F.coalesce(F.nullif("id", F.lit("")), F.nullif("label", F.lit("")), F.lit(UNKNOWN))
    return (
        bands.select("band_ord", key.alias("key"), F.coalesce("min_year", low).alias("low"), F.coalesce("max_year", high).alias("high"))
        .filter("low <= high")
        .select("band_ord", "key", F.explode(F.sequence("low", "high")).alias("year"))
        .groupBy("year")
        .agg(F.min_by("key", "band_ord").alias("age_band"))
    )


def bands_of_years(bands: DataFrame, first: int, last: int) -> list[Band]:
    """Bands of one year each that class the years from ``first`` to ``last`` as ``bands`` does, however many those are."""
    low, high = F.lit(first), F.lit(last)
    within = bands.withColumns({"min_year": F.greatest(F.coalesce("min_year", low), low), "max_year": F.least(F.coalesce("max_year", high), high)})
    # One row for each year at most.
    return [Band(r.age_band, None, r.year, r.year, None) for r in sorted(band_by_year(within, low, high).collect(), key=lambda r: r.year)]


def band_range_join(df: DataFrame, bands: DataFrame, year: str = "year") -> DataFrame:
    """``df`` with ``age_band`` by joining bands as a table of any length; the same as ``band_of_year``.

    Bands only change at their bounds, so all years before the first bound are looked up as one year,
    and so are all after the last. The range join becomes an equi-join with at most one row per year
    between the bounds. A year that holds much of ``df`` is split if the lookup is too long to broadcast.
    """
    bounds = bands.select(F.explode(F.array("min_year", "max_year").cast("array<bigint>")).alias("y")).where("y IS NOT NULL")
    low = F.coalesce(bounds.agg(F.min("y") - 1).scalar(), F.lit(0).cast("bigint"))
    high = F.coalesce(bounds.agg(F.max("y") + 1).scalar(), F.lit(0).cast("bigint"))
    wide = bands.withColumns({c: F.col(c).cast("bigint") for c in ("min_year", "max_year")})
    lookup = band_by_year(wide, low, high).withColumnRenamed("year", "_year")
    clamped = F.when(F.col(year).isNotNull(), F.least(F.greatest(F.col(year).cast("bigint"), low), high))
    joined = join_lookup(df.withColumn("_year", clamped), lookup, ["_year"], "left").drop("_year")
    return joined.withColumn("age_band", F.coalesce("age_band", F.lit(UNKNOWN)))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a dimension only after checking that it is short; else leave the join to AQE."""
    rows = df.limit(MAX_INLINE_BANDS + 1).count()
    return F.broadcast(df) if rows <= MAX_INLINE_BANDS else df


def with_color(df: DataFrame, bands: DataFrame, band: str = "age_band") -> DataFrame:
    """``df`` with the colour of its band; the last of equal ids counts."""
    lookup = (
        bands.filter("id is not null and color is not null")
        .groupBy(F.col("id").alias("_id"))
        .agg(F.max_by("color", "band_ord").alias("color"))
    )
    keyed = df.withColumn("_id", F.col(band))
    small = _small(lookup)
    joined = join_lookup(keyed, lookup, ["_id"], "left") if small is lookup else keyed.join(small, "_id", "left")
    joined = joined.drop("_id")
    return joined.withColumn("color", F.coalesce("color", F.lit(DEFAULT_COLOR)))


def filter_bands(df: DataFrame, selected: list[str] | None, band: str = "age_band") -> DataFrame:
    """Rows of the selected bands. ``None`` means no filter yet; ``[]`` selects nothing."""
    if selected is None:
        return df
    return df.filter(F.col(band).isin(*selected)) if selected else df.filter(F.lit(False))


def legend(bands: DataFrame) -> DataFrame:
    return bands.select("band_ord", "id", "label", "color").orderBy("band_ord")
