import random

import pytest
from pyspark.sql import functions as F

from lotline.operators.matching import (
    building_lookup,
    drop_blank_keys,
    keep_existing,
    link_properties,
    lowest_address,
    point_lookup,
    representative_property,
)
from lotline.plans.building_age import link_buildings

PROPERTIES = "ord bigint, gis_id string, address string, year bigint, property_class string, zoning string"
POINTS = "ord bigint, ml string, bldg_id string"
BUILDINGS = "building_ord bigint, bldg_id string"
YEAR = 2026


def frames(spark, properties, points, buildings):
    return (
        spark.createDataFrame(properties, PROPERTIES),
        spark.createDataFrame(points, POINTS),
        spark.createDataFrame(buildings, BUILDINGS),
    )


def link(spark, properties, points, buildings):
    rows = link_buildings(*frames(spark, properties, points, buildings), YEAR).collect()
    return {r.building_ord: r for r in rows}


def test_first_known_building_wins_and_several_are_ambiguous(spark):
    points = [(0, "L", ""), (1, "L", "B2"), (2, "L", "B1"), (3, "M", "B1"), (4, "M", ""), (5, "", "B1"), (6, "N", "")]
    lookup = point_lookup(spark.createDataFrame(points, POINTS)).collect()
    assert {r.ml: (r.n_points, r.bldg_id, r.ambiguous) for r in lookup} == {
        "L": (3, "B2", True),
        "M": (2, "B1", False),
        "N": (1, None, False),
    }


def test_lots_with_a_building_are_those_of_the_points_with_one(spark):
    odd = [(0, "", "B9"), (1, "", ""), (2, None, "B1"), (3, "L", None), (4, "L", ""), (5, "L", "B2"), (6, "L", "B1"), (6, "L", "B1")]
    odd += [(7, "M", "B3"), (8, "M", "B3"), (9, "N", ""), (10, "O", None), (None, "P", "B4"), (11, "P", "B5"), (None, "Q", "B6")]
    random.seed(3)
    many = [(i, random.choice(["", "a", "b", "c", "d"]), random.choice(["", "x", "y", None])) for i in range(60)]
    points = spark.createDataFrame(odd + many, POINTS).repartition(3)
    want = point_lookup(drop_blank_keys(points, "bldg_id")).drop("n_points")
    got = building_lookup(points)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    # Ids that are computed are computed once: no filter moves below the aggregate.
    below = building_lookup(points.withColumn("ml", F.concat("ml", F.lit("!"))))._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in below[below.index("Aggregate") :]


def test_address_that_differs_in_white_space(spark):
    properties = [(0, "L", "9 z", 1900, "a", None), (1, "L", "12 main ", 1910, "b", None), (2, "L", "12 main", 1920, "c", None)]
    properties[0] = (0, "L", "99 z", 1900, "a", None)
    got = link(spark, properties, [(0, "L", "B")], [(0, "B")])[0]
    # "12 main" sorts first, but the first row with that address up to white space is the other.
    assert (got.Address, got.PropertyClass, got.Condition_YearBuilt) == ("12 main", "b", 1910)
    assert got.join_ambiguous and got.join_status == "matched"


def test_missing_addresses_fall_back_to_the_first_match(spark):
    properties = [(5, "L", None, 1900, "late", None), (3, "L", None, 1890, "early", None)]
    got = link(spark, properties, [(0, "L", "B")], [(0, "B")])[0]
    assert (got.Address, got.PropertyClass, got.age) == (None, "early", YEAR - 1890)


def test_any_address_beats_a_missing_one(spark):
    properties = [(0, "L", None, 1900, "x", None), (1, "L", "  ", 1890, "y", None)]
    assert link(spark, properties, [(0, "L", "B")], [(0, "B")])[0].PropertyClass == "y"


def test_repeated_and_blank_building_ids(spark):
    got = link(
        spark,
        [(0, "L", "1 a", 1900, "c", "z")],
        [(0, "L", "B")],
        [(0, "B"), (1, "B"), (2, ""), (3, None), (4, "OTHER")],
    )
    assert len(got) == 5
    assert [got[i].join_status for i in range(5)] == ["matched", "matched", "unmatched", "unmatched", "unmatched"]
    assert got[0].GISID == got[1].GISID == "L"


@pytest.mark.parametrize("year", [None, 1599, 2027])
def test_invalid_year_keeps_the_other_values(spark, year):
    got = link(spark, [(0, "L", "1 a", year, "c", "z")], [(0, "L", "B")], [(0, "B")])[0]
    assert (got.join_status, got.age, got.Condition_YearBuilt, got.age_band) == ("invalid_year", None, None, "unknown")
    assert (got.GISID, got.Address, got.PropertyClass, got.Zoning) == ("L", "1 a", "c", "z")


def test_lowest_address(spark):
    groups = {
        "a": (["10 b", "9 z"], "9 z"),
        "b": (["9 B", "9 a"], "9 a"),
        "c": (["x", "1 y"], "1 y"),
        "d": ([None, ""], None),
        "e": (["b", "A"], "A"),
        "f": (["1_x", "1 O'Neil", "1 Main St", "1 main st"], "1 main st"),
        "g": (["Z", "é", "f", "e"], "e"),
    }
    rows = [(k, a, i) for k, (addresses, _) in groups.items() for i, a in enumerate(addresses)]
    df = spark.createDataFrame(rows, "k string, address string, ord int")
    got = {r.k: r.lowest_address for r in lowest_address(df, ["k"]).collect()}
    assert got == {k: want for k, (_, want) in groups.items()}


def test_locale_order(spark):
    ordered = ["1 main st", "1 Main St", "1 O'Neil", "1 ONeil", "1_x", "1-3 Main", "1A Main", "a", "B", "e", "é", "f", "Z"]
    # Each with its successor: the earlier one must win, whichever comes first.
    rows = [(f"{i}{flip}", a, flip ^ j) for i in range(len(ordered) - 1) for flip in (0, 1) for j, a in enumerate(ordered[i : i + 2])]
    df = spark.createDataFrame(rows, "k string, address string, ord int")
    got = {r.k: r.lowest_address for r in lowest_address(df, ["k"]).collect()}
    assert got == {f"{i}{flip}": ordered[i] for i in range(len(ordered) - 1) for flip in (0, 1)}


def test_semi_join_keeps_matches_single(spark):
    properties, points, buildings = frames(
        spark,
        [(0, "L", "1", 1900, None, None), (1, "M", "2", 1900, None, None)],
        [(0, "L", "B"), (1, "M", "GONE")],
        [(0, "B"), (1, "B")],
    )
    kept = keep_existing(link_properties(properties, points), buildings).collect()
    assert [r.gis_id for r in kept] == ["L"]


# --- against a plain loop over random data --------------------------------------------------


def random_input(seed, n=300):
    rng = random.Random(seed)
    lots = [f"L{i}" for i in range(40)]
    ids = [f"B{i}" for i in range(30)]
    addresses = ["1 oak", "1 oak ", " 1 oak", "2 elm", "10 ash", "elm", None, "002 fir"]

    # A third of everything has the same key.
    def skewed(values):
        return values[0] if rng.random() < 0.34 else rng.choice(values)

    properties = [
        (i, rng.choice(["", skewed(lots), skewed(lots)]), rng.choice(addresses), rng.choice([None, 1500, 1700, 1900, 2030]), f"c{i}", None)
        for i in range(n)
    ]
    points = [(i, rng.choice(["", skewed(lots), skewed(lots)]), rng.choice(["", skewed(ids)])) for i in range(n)]
    buildings = [(i, rng.choice(["", skewed(ids), skewed(ids)])) for i in range(n)]
    return properties, points, buildings


def number_of(address):
    digits = ""
    for c in address.strip():
        if not c.isdigit():
            break
        digits += c
    return int(digits) if digits else float("inf")


def by_hand(properties, points, buildings):
    known = {}
    for _, lot, building in sorted(points):
        if lot and building:
            known.setdefault(lot, []).append(building)
    arrivals = {}
    for row in sorted(properties, key=lambda r: r[0]):
        if row[1] in known:
            arrivals.setdefault(known[row[1]][0], []).append(row)
    result = {}
    for ord, building in buildings:
        rows = arrivals.get(building, []) if building else []
        unclear = len(rows) > 1 or any(len(set(known[r[1]])) > 1 for r in rows)
        if not rows:
            result[ord] = ("unmatched", None, None, None, False)
            continue
        named = [r for r in rows if r[2]]
        if named:
            # Here locale order is: blanks first, then digits, then letters, as in plain order.
            winner = min((number_of(r[2]), r[2], r[0]) for r in named)[1]
            row = next(r for r in rows if r[2] and r[2].strip() == winner.strip())
        else:
            winner, row = None, rows[0]
        good = row[3] is not None and 1600 <= row[3] <= YEAR
        result[ord] = ("matched" if good else "invalid_year", winner, row[4], row[3] if good else None, unclear)
    return result


@pytest.mark.parametrize("seed, partitions", [(0, 1), (0, 7), (1, 3)])
def test_random_links(spark, seed, partitions):
    properties, points, buildings = random_input(seed)
    shuffled = [random.Random(seed + 1).sample(x, len(x)) for x in (properties, points, buildings)]
    dfs = [df.repartition(partitions) for df in frames(spark, *shuffled)]
    rows = link_buildings(*dfs, YEAR).collect()
    got = {
        r.building_ord: (r.join_status, r.Address, r.PropertyClass, r.Condition_YearBuilt, r.join_ambiguous) for r in rows
    }
    assert len(rows) == len(buildings)
    assert got == by_hand(properties, points, buildings)


def test_order_may_be_a_struct(spark):
    properties, points, buildings = frames(spark, *random_input(9))
    struct = [df.withColumn("ord", F.struct(F.lit("file").alias("f"), "ord")) for df in (properties, points)]
    plain = representative_property(link_properties(properties, points)).collect()
    same = representative_property(link_properties(*struct)).collect()
    assert sorted(plain) == sorted(same)
