from pyspark.sql import functions as F

from lotline.operators import report, view
from lotline.sources.bands import Band, bands_frame

LINKED = "age_band string, join_status string, join_ambiguous boolean"


def test_quality_report(spark):
    rows = [("a", "matched", True)] * 2 + [("unknown", "invalid_year", True)] + [("unknown", "unmatched", False)] * 4
    got = report.quality_report(spark.createDataFrame(rows, LINKED)).first().asDict()
    assert got == {
        "total": 7,
        "matched": 2,
        "unmatched": 4,
        "invalid_year": 1,
        "ambiguous": 3,
        "match_pct": 28.57,
        "valid_year_coverage_pct": 28.57,
    }
    assert got["matched"] + got["unmatched"] + got["invalid_year"] == got["total"]


def test_empty_report(spark):
    got = report.quality_report(spark.createDataFrame([], LINKED)).first()
    assert (got.total, got.match_pct) == (0, 0.0)


def test_band_counts(spark):
    bands = bands_frame(spark, [Band("a", None, None, None, None), Band(None, "b", None, None, None), Band("a", None, None, None, None)])
    rows = [("a", "matched", False), ("a", "matched", False), ("a", "invalid_year", False), ("other", "matched", False)]
    got = report.band_counts(spark.createDataFrame(rows, LINKED), bands).collect()
    assert sorted((r.age_band, r.band_ord, r.n_buildings) for r in got) == [("a", 0, 2), ("b", 1, 0), ("other", None, 1)]


def bags(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.parse_json("t").alias("properties"))


def test_year_coverage(spark):
    df = bags(
        spark,
        '{"year_built":1890}',
        '{"year_built":"1890"}',
        '{"year_built":null,"Condition_YearBuilt":1890.5}',
        '{"year_built":"x","Condition_YearBuilt":1890}',
        '{"Condition_YearBuilt":0}',
        "{}",
    ).unionByName(spark.createDataFrame([(9, None)], "i int, t string").select("i", F.parse_json("t").alias("properties")))
    assert report.year_coverage(df).first().asDict() == {"total": 7, "with_year": 3, "coverage_pct": 42.9}
    assert report.year_coverage(df.limit(0)).first().asDict() == {"total": 0, "with_year": 0, "coverage_pct": 0.0}


def test_display_card(spark):
    df = bags(
        spark,
        '{"address":"a&<b>\\"\'","year_built":1890.0,"age":0}',
        '{"address":null,"Address":"x","Condition_YearBuilt":"c. 1900","age":true}',
        '{"address":"","Address":"x","age":{"a":1},"year_built":[1]}',
        "{}",
    )
    got = {r.i: (r.address, r.year_built, r.age) for r in view.display_card(df, ["i"]).collect()}
    assert got == {
        0: ("a&amp;&lt;b&gt;&quot;&#39;", "1890", "0"),
        1: ("x", "c. 1900", "true"),
        2: ("Unknown", "Unknown", "Unknown"),
        3: ("Unknown", "Unknown", "Unknown"),
    }


def test_display_card_from_columns(spark):
    df = spark.createDataFrame([(1, "a<b", 1890, 136), (2, None, None, None)], "i int, Address string, Condition_YearBuilt int, age int")
    got = {r.i: (r.address, r.year_built, r.age) for r in view.display_card_columns(df, ["i"]).collect()}
    assert got == {1: ("a&lt;b", "1890", "136"), 2: ("Unknown", "Unknown", "Unknown")}
