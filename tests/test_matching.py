"""Names of local data against names of tracts; agencies that cover each other; time to arrest with open cases."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from civicspan.operators import matching
from civicspan.plans import community
from civicspan.sources.datasets import Tables
from micro import declared


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def matched(spark, asked, known, **options):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(asked)], "id int, place string")
    others = spark.createDataFrame(known, "name string, tract string")
    made = matching.match_names(rows, others, "place", "name", "tract", **options)
    return [(r.tract, r.match, r.edits) for r in made.orderBy("id").collect()]


def test_crowded_numbers_are_matched_by_keys_that_are_not_broadcast(spark):
    draw = random.Random(5)
    letters = ["".join(draw.choices("abcdef", k=12)) for _ in range(matching.SMALL_BLOCK + 20)]
    known = [(f"7 {name}", str(i)) for i, name in enumerate(letters)]
    asked = [f"7 {name[:3]}x{name[4:]}" for name in letters[:30]] + [f"7 {name[1:8]}{name[9:]}" for name in letters[30:]]
    rows = spark.createDataFrame([(n,) for n in asked], "place string")
    made = matching.match_names(rows, spark.createDataFrame(known, "name string, tract string"), "place", "name", "tract")
    found = {r.place: (r.tract, r.edits) for r in made.collect()}
    for place in asked:
        away = [plain_edits(place[2:], name) for name in letters]
        best = min(away)
        assert found[place] == ((str(away.index(best)), best) if best <= 2 and away.count(best) == 1 else (None, best if best <= 2 else None))
    joins = re.findall(r"(\w+Join) \[[^\]]*mark", made._jdf.queryExecution().executedPlan().toString())
    assert joins and set(joins) == {"SortMergeJoin"}


def test_kinds_of_matches(spark):
    known = [
        ("Census Tract 7001, Montgomery County", "7001.00"),
        ("Census Tract 7001.01, Montgomery County", "7001.01"),
        ("Silver Spring", "a"),
        ("Silver Sprung", "b"),
        ("Olney", "c"),
        ("Olney", "d"),
        ("Poolesville", "e"),
        ("POOLESVILLE!", "e"),
    ]
    asked = [
        "census tract 7001.00 - Montgomery County",
        "Census Trct 7001.01 Montgomary County",
        "Census Tract 7002, Montgomery County",
        "Silver Spring",
        "Silver Sprong",
        "Olney",
        "Pooleville",
        "Olny",
        "",
        None,
    ]
    assert matched(spark, asked, known) == [
        ("7001.00", "exact", 0),
        ("7001.01", "near", 2),
        (None, "none", None),
        ("a", "exact", 0),
        (None, "ambiguous", 1),
        (None, "ambiguous", 0),
        ("e", "near", 1),
        (None, "none", None),
        (None, "none", None),
        (None, "none", None),
    ]


def test_no_near_name_is_missed(spark):
    rng = random.Random(4)
    letters = "abcde"
    known = [("".join(rng.choices(letters, k=rng.randint(4, 14))) + f" {rng.randint(1, 2)}", str(i)) for i in range(120)]
    asked = []
    for name, _ in known[:80]:
        text = list(name)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(text) - 2)
            text[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "e"])
        asked.append("".join(text))
    found = matched(spark, asked, known)

    def split(name):
        return name.split()[-1], " ".join(name.split()[:-1])

    for name, (tract, kind, edits) in zip(asked, found, strict=True):
        number, words = split(name)
        near = []
        for other, key in known:
            n, w = split(other)
            d = plain_edits(words, w)
            if n == number and d <= min(2, len(words) // 5):
                near.append((d, key))
        least = min((d for d, _ in near), default=None)
        keys = {key for d, key in near if d == least}
        assert edits == least
        assert tract == (keys.pop() if len(keys) == 1 else None)
        assert kind == ("none" if least is None else "ambiguous" if tract is None else "near" if least else "exact")


def test_matches_within_a_county_keep_repeated_rows(spark):
    rows = spark.createDataFrame([("Olney", "x", 1), ("Olney", "y", 2), ("Olney", "x", 1), ("Olney", None, 3)], "place string, county string, edits int")
    known = spark.createDataFrame([("Olney", "x", "k")], "name string, county string, tract string")
    made = matching.match_names(rows, known, "place", "name", "tract", within=("county",)).collect()
    assert sorted((str(r.county), r.tract, r.match) for r in made) == [
        ("None", None, "none"), ("x", "k", "exact"), ("x", "k", "exact"), ("y", None, "none")
    ]
    told = {r.match: r.rows for r in matching.match_report(matching.match_names(rows, known, "place", "name", "tract")).collect()}
    assert told == {"exact": 4}


def covered(spark, covers, taking):
    yearly = spark.createDataFrame(
        [(i, 2020, f"O{i}", None if c is None else f"O{c}") for i, c in covers],
        "agency_id int, data_year int, legacy_ori string, covered_by_legacy_ori string",
    )
    direct = spark.createDataFrame([(f"O{i}", 2020) for i in taking], "legacy_ori string, data_year int")
    return sorted(r.agency_id for r in community.covered_agencies(yearly, direct).collect())


def test_chains_and_circles_of_covering_agencies(spark):
    chain = [(1, 2), (2, 3), (3, 4), (4, None)]
    circle = [(10, 11), (11, 12), (12, 10)]
    assert covered(spark, chain + circle, [4]) == [1, 2, 3]
    assert covered(spark, chain + circle, []) == []
    assert covered(spark, circle, [11]) == [10, 11, 12]
    assert covered(spark, [(20, 20), (21, 22), (22, 21), (23, 21)], [20]) == [20]
    assert covered(spark, [(30, 31), (30, 32), (31, None), (32, None)], [32]) == [30]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_graph_of_covering_agencies(spark, seed):
    rng = random.Random(seed)
    covers = [(i, rng.choice([None, *range(30)])) for i in range(30)]
    taking = rng.sample(range(30), 4)
    by = dict(covers)
    expected = []
    for i in range(30):
        seen, at = set(), by[i]
        while at is not None and at not in seen and at not in taking:
            seen.add(at)
            at = by[at]
        if at in taking:
            expected.append(i)
    assert covered(spark, covers, taking) == expected


def test_open_cases_lengthen_the_time_to_arrest(spark):
    day = [(i, f"2020-01-01 00:00:00") for i in range(1, 9)]
    t = Tables(
        {
            "nibrs_incident": declared(spark, "nibrs_incident", ["incident_id"], [(i,) for i, _ in day]).withColumn(
                "incident_date", F.when(F.col("incident_id") == 8, F.date_add(F.lit("2020-01-01").cast("date"), 60)).otherwise(F.lit("2020-01-01").cast("date"))
            ),
            "nibrs_offense": declared(
                spark, "nibrs_offense", ["offense_id", "incident_id", "offense_code"], [(i, i, "13A") for i, _ in day]
            ),
            "nibrs_offense_type": declared(spark, "nibrs_offense_type", ["offense_code", "offense_name"], [("13A", "Assault")]),
            "nibrs_arrestee": spark.createDataFrame(
                [(1, "13A", "2020-01-03"), (1, "13A", "2020-01-09"), (2, "13A", "2020-01-03"), (3, "13A", "2020-01-06"), (4, "13A", "2019-12-30"), (5, "13A", "2021-01-01"), (6, "90Z", "2020-01-02")],
                "incident_id long, offense_code string, arrest_date string",
            ),
        }
    )
    rows = [tuple(r) for r in community.arrest_survival(t, "2020-01-31").orderBy("days").collect()]
    # Seven offenses of January: one arrest before the incident, two on day 2, one on day 5, three open at day 30.
    assert rows == [
        ("Assault", 0, 7, 1, 0, round(6 / 7, 6)),
        ("Assault", 2, 6, 2, 0, round(4 / 7, 6)),
        ("Assault", 5, 4, 1, 0, round(3 / 7, 6)),
        ("Assault", 30, 3, 0, 3, round(3 / 7, 6)),
    ]
    assert [tuple(r) for r in community.median_time_to_arrest(t, "2020-01-31").collect()] == [("Assault", 7, 4, 5)]
    few = [tuple(r) for r in community.arrest_survival(t, "2020-01-02").collect()]
    assert sorted(few) == [("Assault", 0, 7, 1, 0, round(6 / 7, 6)), ("Assault", 1, 6, 0, 6, round(6 / 7, 6))]


def test_nobody_is_left_when_all_are_arrested(spark):
    t = Tables(
        {
            "nibrs_incident": spark.createDataFrame([(1, "2020-01-01")], "incident_id long, incident_date string"),
            "nibrs_offense": spark.createDataFrame([(1, "13A")], "incident_id long, offense_code string"),
            "nibrs_offense_type": spark.createDataFrame([("13A", "Assault")], "offense_code string, offense_name string"),
            "nibrs_arrestee": spark.createDataFrame([(1, "13A", "2020-01-03")], "incident_id long, offense_code string, arrest_date string"),
        }
    )
    assert [tuple(r) for r in community.arrest_survival(t, "2020-02-01").collect()] == [("Assault", 2, 1, 1, 0, 0.0)]
