import pytest
from pyspark.sql import functions as F

from lotline.functions.text import display_value, escape_html, is_valid_year, normalize_id, parse_year, street_number, year_of
from lotline.functions.values import number_text, trim_all, truthy_coalesce
from lotline.operators.bags import first_truthy, first_truthy_or_last, read_bag


def apply(spark, function, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


def cases(table):
    return [list(column) for column in zip(*table)]


def test_normalize_id(spark):
    given, expected = cases(
        [
            (None, ""),
            (" 1a.0 ", "1A"),
            ("1.0.0", "1.0"),
            (".0", ""),
            ("5 .0", "5 "),
            (" x　", "X"),
            ("straße", "STRASSE"),
            ("\t\n", ""),
            ("a.00", "A.00"),
        ]
    )
    assert apply(spark, normalize_id, given) == expected


def test_normalize_id_of_numbers(spark):
    got = apply(spark, lambda c: normalize_id(c, "number"), [17.0, 17.5, 12345678.5, 30000000.0, None], "double")
    assert got == ["17", "17.5", "12345678.5", "30000000", ""]


def test_trim_covers_unicode_space(spark):
    assert apply(spark, trim_all, ["﻿  a b ", "", None]) == ["a b", "", None]


def test_street_number(spark):
    inf = float("inf")
    given, expected = cases(
        [
            ("000", 0.0),
            ("007", 7.0),
            ("12A", 12.0),
            ("12-14", 12.0),
            (" 5 x", 5.0),
            ("-3", inf),
            ("A1", inf),
            ("", inf),
            (None, inf),
            ("99999999999999999999 x", 1e20),
        ]
    )
    assert apply(spark, street_number, given) == expected


def test_parse_year(spark):
    given, expected = cases(
        [
            ("1890.0", 1890),
            ("1890.00", 189000),
            ("1890.5", 18905),
            ("c.1890", 1890),
            ("1,890", 1890),
            ("1900-1910", 1900),
            ("19-00", 19),
            ("-1900", -1900),
            ("1e3", 13),
            ("--5", None),
            ("", None),
            (None, None),
            ("9" * 30, None),
        ]
    )
    assert apply(spark, parse_year, given) == expected


def test_valid_years(spark):
    got = apply(spark, lambda c: is_valid_year(c, 2026), [1599, 1600, 2026, 2027, None], "bigint")
    assert got == [False, True, True, False, False]


def test_falsy_values_have_no_year(spark):
    assert apply(spark, year_of, ["1900", "", None, "0"]) == [1900, None, None, 0]
    assert apply(spark, lambda c: year_of(c, "number"), [1900.0, 0.0], "double") == [1900, None]


def test_escape_and_display(spark):
    assert apply(spark, escape_html, ["a&<b>\"'&amp;"]) == ["a&amp;&lt;b&gt;&quot;&#39;&amp;amp;"]
    assert apply(spark, display_value, [None, "  ", "x<y"]) == ["Unknown", "Unknown", "x&lt;y"]
    numbers = apply(
        spark, lambda c: display_value(c, "number"), [None, 1890.0, 0.5, float("nan"), float("inf")], "double"
    )
    assert numbers == ["Unknown", "1890", "0.5", "Unknown", "Unknown"]


def test_number_text(spark):
    got = apply(spark, number_text, [0.0, -3.0, 1e14, 0.25, 12345678.125], "double")
    assert got == ["0", "-3", "100000000000000", "0.25", "12345678.125"]


@pytest.mark.parametrize(
    "kind, rows, expected",
    [
        ("string", [("", "x"), ("a", "b"), (None, ""), ("", None)], ["x", "a", "", None]),
        ("int", [(0, None), (None, 0), (0, 5), (3, 4)], [None, 0, 5, 3]),
        ("boolean", [(False, True), (None, False), (True, False)], [True, False, True]),
    ],
)
def test_truthy_coalesce(spark, kind, rows, expected):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, a {kind}, b {kind}")
    name = {"int": "number"}.get(kind, kind)
    out = df.select("i", truthy_coalesce(F.col("a"), F.col("b"), kind=name).alias("o")).orderBy("i").collect()
    assert [r.o for r in out] == expected


def test_truthy_variants(spark):
    bags = ['{"v":0}', '{"v":"0"}', '{"v":""}', '{"v":false}', '{"v":true}', '{"v":null}', "{}", '{"v":1e3}', '{"v":17.0}']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bags)], "i int, b string")
    rows, values = read_bag(df.select("i", F.parse_json("b").alias("properties")), ["v", "w"])
    chosen = rows.select(
        "i", first_truthy(values["v"]).alias("o"), first_truthy_or_last(values["w"], values["v"]).alias("last"), values["v"].kind.alias("kind")
    )
    out = chosen.orderBy("i").collect()
    assert [r.o for r in out] == [None, "0", None, None, "true", None, None, "1000", "17"]
    assert [r.last for r in out] == ["0", "0", "", "false", "true", None, None, "1000", "17"]
    kinds = ["number", "string", "string", "boolean", "boolean", None, None, "number", "number"]
    assert [r.kind for r in out] == kinds
