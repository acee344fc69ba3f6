import json

import pytest
from pyspark.sql import functions as F

from lotline.operators import bands as ops
from lotline.sources.bands import DEFAULT_BANDS, MAX_INLINE_BANDS, Band, bands_frame, load_bands, read_bands

EDGES = {
    1: "pre-1780",
    1779: "pre-1780",
    1780: "1780_1820",
    1819: "1780_1820",
    1820: "1820_1850",
    1979: "1930-1980",
    1980: "1980-present",
    2026: "1980-present",
    9999: "1980-present",
    None: "unknown",
}
ODD_BANDS = [
    Band("", "old", None, 1700, "red"),
    Band("it's", None, 1650, 1800, None),
    Band(None, None, 1900, 1950, "blue"),
    Band("late", "x", 1940, None, "green"),
]


def years(spark, values):
    return spark.createDataFrame([(y,) for y in values], "year int")


def test_band_edges(spark):
    rows = years(spark, EDGES).select("year", ops.band_of_year(F.col("year")).alias("band")).collect()
    assert {r.year: r.band for r in rows} == EDGES


def expected(bands, year):
    fitting = [b for b in bands if (b.min_year or -9999) <= year <= (b.max_year or 9999)]
    return fitting[0].key if fitting else "unknown"


@pytest.mark.parametrize("bands", [DEFAULT_BANDS, ODD_BANDS, [], [Band("all", None, None, None, None)]])
def test_three_ways_to_find_a_band_agree(spark, bands, monkeypatch):
    df = years(spark, range(1400, 2200))
    by_table = {r.year: r.b for r in df.select("year", ops.band_of_year(F.col("year"), bands).alias("b")).collect()}
    joined = ops.band_range_join(df, bands_frame(spark, bands)).collect()
    monkeypatch.setattr(ops, "MAX_TABLE_YEARS", 0)
    by_case = {r.year: r.b for r in df.select("year", ops.band_of_year(F.col("year"), bands).alias("b")).collect()}
    want = {y: expected(bands, y) for y in range(1400, 2200)}
    assert by_table == want
    assert by_case == want
    assert {r.year: r.age_band for r in joined} == want


def test_every_valid_year_has_one_bounded_band():
    for year in range(1600, 2027):
        fitting = [
            b
            for b in DEFAULT_BANDS
            if not b.is_unknown and (b.min_year or -9999) <= year <= (b.max_year or 9999)
        ]
        assert len(fitting) == 1


def test_colors(spark):
    bands = bands_frame(spark, [Band("a", None, None, None, "red"), Band("b", None, None, None, None), Band("a", None, None, None, "blue")])
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "age_band string")
    got = {r.age_band: r.color for r in ops.with_color(df, bands).collect()}
    assert got == {"a": "blue", "b": "#999999", "c": "#999999", None: "#999999"}


def test_filter(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "age_band string")
    assert ops.filter_bands(df, None).count() == 3
    assert ops.filter_bands(df, []).count() == 0
    assert [r.age_band for r in ops.filter_bands(df, ["b", "z"]).collect()] == ["b"]


def test_read_bands(spark, tmp_path):
    entries = [
        {"id": b.id, "label": b.label, "minYear": b.min_year, "maxYear": b.max_year, "color": b.color}
        | ({"isUnknown": True} if b.is_unknown else {})
        for b in DEFAULT_BANDS
    ]
    path = tmp_path / "bands.json"
    path.write_text(json.dumps(entries, indent=2))
    assert load_bands(spark, str(path)) == DEFAULT_BANDS
    assert [r.id for r in ops.legend(read_bands(spark, str(path))).collect()] == [b.id for b in DEFAULT_BANDS]


def test_very_many_bands_stay_a_table_and_class_years_the_same(spark, tmp_path):
    path = tmp_path / "bands.json"
    entries = [{"id": str(i), "minYear": 1500 + i // 2, "maxYear": 1500 + i // 2 + i % 7} for i in range(MAX_INLINE_BANDS + 50)] + [{"id": "rest"}]
    path.write_text(json.dumps(entries))
    assert load_bands(spark, str(path)) is None
    every = read_bands(spark, str(path))
    assert every.count() == len(entries)
    folded = ops.bands_of_years(every, 1600, 2026)
    listed = [Band(e["id"], None, e.get("minYear"), e.get("maxYear"), None) for e in entries]
    years = spark.range(1600, 2027).select(F.col("id").alias("year"))
    rows = years.select("year", ops.band_of_year(F.col("year"), folded).alias("a"), ops.band_of_year(F.col("year"), listed).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and len({r.a for r in rows}) > 300
