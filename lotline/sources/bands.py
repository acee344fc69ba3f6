"""The age-band dimension: a short ordered list of year ranges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Bands are configuration. Beyond this many they are treated as data: never collected.
MAX_INLINE_BANDS = 1000

UNKNOWN = "unknown"


@dataclass(frozen=True)
class Band:
    id: str | None
    label: str | None
    min_year: int | None
    max_year: int | None
    color: str | None
    is_unknown: bool = False

    @property
    def key(self) -> str:
        return self.id or self.label or UNKNOWN


# The default bands (inclusive years), in order.
DEFAULT_BANDS = [
    Band("pre-1780", "pre 1780", None, 1779, "#c32b1d"),
    Band("1780_1820", "1780-1820", 1780, 1819, "#f15027"),
    Band("1820_1850", "1820-1850", 1820, 1849, "#ff882d"),
    Band("1850_1880", "1850-1880", 1850, 1879, "#ffab58"),
    Band("1880-1900", "1880-1900", 1880, 1899, "#238b47"),
    Band("1900-1930", "1900-1930", 1900, 1929, "#6fda6d"),
    Band("1930-1980", "1930-1980", 1930, 1979, "#8564db"),
    Band("1980-present", "1980-present", 1980, None, "#5429b7"),
    Band("unknown", "Unknown", None, None, "#566071", True),
]

BAND_SCHEMA = T.StructType(
    [
        T.StructField("band_ord", T.IntegerType(), False),
        T.StructField("id", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("min_year", T.IntegerType()),
        T.StructField("max_year", T.IntegerType()),
        T.StructField("color", T.StringType()),
        T.StructField("is_unknown", T.BooleanType()),
    ]
)


def bands_frame(spark: SparkSession, bands: list[Band] = DEFAULT_BANDS) -> DataFrame:
    rows = [
        (i, b.id, b.label, b.min_year, b.max_year, b.color, b.is_unknown) for i, b in enumerate(bands)
    ]
    return spark.createDataFrame(rows, BAND_SCHEMA)


def read_bands(spark: SparkSession, path: str) -> DataFrame:
    """Bands from a JSON array, in file order."""
    entry = "struct<id:string,label:string,minYear:int,maxYear:int,color:string,isUnknown:boolean>"
    return (
        spark.read.text(path, wholetext=True)
        .select(F.posexplode(F.from_json("value", f"array<{entry}>")).alias("band_ord", "b"))
        .select(
            "band_ord",
            "b.id",
            "b.label",
            F.col("b.minYear").alias("min_year"),
            F.col("b.maxYear").alias("max_year"),
            "b.color",
            F.coalesce("b.isUnknown", F.lit(False)).alias("is_unknown"),
        )
    )


def load_bands(spark: SparkSession, path: str) -> list[Band] | None:
    """Bands as configuration; None for a longer list, which stays a DataFrame: see :func:`read_bands`."""
    rows = read_bands(spark, path).orderBy("band_ord").limit(MAX_INLINE_BANDS + 1).collect()
    if not rows:
        raise ValueError(f"Expected a JSON array of bands at {path}")
    if len(rows) > MAX_INLINE_BANDS:
        return None
    return [Band(r.id, r.label, r.min_year, r.max_year, r.color, r.is_unknown) for r in rows]
