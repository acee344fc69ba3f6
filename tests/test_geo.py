import json
import math
import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from lotline.functions.geo import (
    mercator_x,
    mercator_y,
    metres_per_degree,
    round_geometry,
    round_nested,
    to_fixed,
    wrap_degrees,
)


def test_to_fixed_rounds_the_exact_value(spark):
    rng = random.Random(1)
    xs = [1.0000015, -71.1056005, -71.1056015, 0.0078125, -0.0078125, 0.0, 1e15 + 0.3, 42.0, -0.5]
    xs += [rng.uniform(-180, 180) for _ in range(300)]
    # Decimal ties, which are nearly never binary ties.
    xs += [round(rng.uniform(-180, 180), 6) + 5e-7 for _ in range(300)]
    want = [float(Decimal(x).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for x in xs]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = [r.y for r in df.select("i", to_fixed(F.col("x")).alias("y")).orderBy("i").collect()]
    assert got == want


def test_round_nested(spark):
    df = spark.createDataFrame([([[[1.23456789, 2.0, 3.00000049]], []],)], "c array<array<array<double>>>")
    assert df.select(round_nested(F.col("c"), 3)).first()[0] == [[[1.234568, 2.0, 3.0]], []]


def test_round_geometry(spark):
    hole = [[[0, 0], [4.00000051, 0], [4, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]]
    given = [
        {"type": "Polygon", "coordinates": hole},
        {"type": "MultiPolygon", "coordinates": [hole, hole]},
        {"type": "Point", "coordinates": [1.23456789, -2.5, 7.1234567], "bbox": [1, 2, 3, 4]},
        {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1.23456789, 2]}]},
        {"type": "Polygon"},
        None,
    ]
    texts = [None if g is None else json.dumps(g) for g in given]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, geometry string")
    got = [r.geometry and json.loads(r.geometry) for r in round_geometry(df).orderBy("i").collect()]
    hole[0][1][0] = 4.000001
    assert got[0] == {"type": "Polygon", "coordinates": hole}
    assert got[1] == {"type": "MultiPolygon", "coordinates": [hole, hole]}
    assert got[2] == {"type": "Point", "coordinates": [1.234568, -2.5, 7.123457], "bbox": [1, 2, 3, 4]}
    assert got[3:] == given[3:]


def test_mercator(spark):
    df = spark.createDataFrame(
        [(0, 0.0, 0.0), (1, 180.0, 90.0), (2, -180.0, -90.0), (3, 90.0, 85.0511287798066)], "i int, lon double, lat double"
    )
    rows = df.select("i", mercator_x(F.col("lon")).alias("x"), mercator_y(F.col("lat")).alias("y")).orderBy("i").collect()
    assert [(r.x, r.y) for r in rows[:3]] == [(0.5, 0.5), (1.0, 0.0), (0.0, 1.0)]
    assert rows[3].x == 0.75 and abs(rows[3].y) < 1e-12


def test_metres_per_degree(spark):
    df = spark.createDataFrame([(0.0,), (45.0,)], "lat double")
    kx, ky = metres_per_degree(F.col("lat"))
    equator, middle = df.select(kx.alias("kx"), ky.alias("ky")).collect()
    assert math.isclose(equator.kx, 111319.49, rel_tol=1e-6)
    # Length of one degree of latitude at 45 degrees on this ellipsoid.
    assert math.isclose(middle.ky, 111131.8, rel_tol=1e-5)
    assert math.isclose(middle.kx, 78846.8, rel_tol=1e-5)


def test_wrap(spark):
    df = spark.createDataFrame([(0, 10.0), (1, 200.0), (2, -350.0), (3, 180.0)], "i int, d double")
    assert [r.w for r in df.select("i", wrap_degrees(F.col("d")).alias("w")).orderBy("i").collect()] == [10, -160, 10, 180]
