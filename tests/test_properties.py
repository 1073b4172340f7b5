"""The one-pass plan against the views and against plain Python, on awkward random data."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from civicspan.functions.numbers import percent
from civicspan.plans import clearance, incidents, reconcile
from micro import CLEARED, clearance_tables

TYPES = [("A", "one", "x"), ("B", "two", "x"), ("C", "two", "x"), ("D", "three", "x"), ("E", None, "x")]


def random_data(seed, hot=False):
    """Unknown codes, nameless counties and offenses, names that two codes share, missing
    parents; with ``hot`` a third of all rows belong to one incident and one agency."""
    rng = random.Random(seed)
    agencies = [(i, f"agency {i % 4}", "t", rng.choice(["north", "south", None])) for i in range(6)]
    incidents_ = [
        (i, 0 if hot and i % 3 == 0 else rng.randrange(8), rng.choice([6, 6, 6, 1, 2, 3, 4, 5, 7])) for i in range(60)
    ]

    def incident():
        return 0 if hot and rng.random() < 0.34 else rng.randrange(70)

    offenses = [(i, incident(), rng.choice("ABCDEZ")) for i in range(300)]
    arrests = [(i, incident(), rng.choice("ABCDEZ")) for i in range(150)]
    cleared = [c for c in CLEARED if c[0] != 3]
    return agencies, TYPES, incidents_, offenses, arrests, cleared


def expected_clearances(agencies, types, incidents_, offenses, arrests, cleared):
    county = {a: c for a, _, _, c in agencies}
    name = {code: n for code, n, _ in types}
    placed = {i: (a, c) for i, a, c in incidents_ if a in county}
    arrested = Counter((i, code) for _, i, code in arrests)
    listed = {c for c, _ in cleared}
    counts, normal = defaultdict(Counter), defaultdict(Counter)
    for _, i, code in offenses:
        if i not in placed or code not in name:
            continue
        agency, c = placed[i]
        key = (county[agency], name[code])
        counts[key]["offense_count"] += 1
        if None in key:
            continue
        if c == 6 and arrested[i, code]:
            normal[key][i] += arrested[i, code]
        if c in clearance.EXCEPTIONS and c in listed:
            counts[key][clearance.EXCEPTIONS[c]] += 1
            counts[key][clearance.TOTAL] += 1
    return {
        (*key, *(
            len(normal[key]) if column == "clearances_normal"
            else sum(normal[key].values()) if column == "arrests"
            else row[column]
            for column in clearance.COUNTS
        ))
        for key, row in counts.items()
    }


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_one_pass_equals_views_and_plain_python(spark, seed, hot):
    data = random_data(seed, hot)
    t = clearance_tables(spark, *data[:5], cleared=data[5])
    columns = ["county_name", "offense_name", *clearance.COUNTS]
    expected = expected_clearances(*data)
    assert {tuple(r) for r in clearance.county_clearances(t).select(columns).collect()} == expected
    assert {tuple(r) for r in clearance.county_clearances_by_view(t).select(columns).collect()} == expected


@pytest.mark.parametrize("broad", [False, True])
def test_unmatched_arrests_equal_plain_python(spark, broad):
    data = random_data(3, hot=True)
    agencies, types, incidents_, offenses, arrests, _ = data
    t = clearance_tables(spark, *data[:5], cleared=data[5])
    agency_ids = {a[0] for a in agencies}
    codes = {code for code, _, _ in types}
    placed = {i: c for i, a, c in incidents_ if a in agency_ids}
    committed = {(i, code) for _, i, code in offenses}
    matched = {
        i
        for _, i, code in arrests
        if (i, code) in committed and code in codes and i in placed and (not broad or placed[i] == 6)
    }
    expected = Counter((i, code) for _, i, code in arrests if i not in matched)
    found = {(r.incident_id, r.offense_code): r.arrests for r in reconcile.unmatched_arrests(t, broad).collect()}
    assert found == dict(expected)


def test_counts_add_up(spark):
    data = random_data(4)
    t = clearance_tables(spark, *data[:5], cleared=data[5])
    offenses = incidents.incident_offenses(t).count()
    assert clearance.county_offenses(t).agg(F.sum("offense_count")).first()[0] == offenses
    assert incidents.offense_totals(t).agg(F.sum("offensecount")).first()[0] == offenses
    sizes = incidents.offense_count_distribution(t).collect()
    assert sum(r.offensecount * r.thecount for r in sizes) == offenses
    assert sum(r.percentage_records for r in sizes) == pytest.approx(1.0)
    rows = clearance.county_clearances(t)
    assert rows.filter("clearances_normal > offense_count").count() == 0


def test_percentages_are_exact(spark):
    pairs = spark.range(1, 161).selectExpr("id AS n", "explode(sequence(1, 300)) AS d")
    for r in pairs.select("n", "d", percent("n", "d").alias("p")).collect():
        exact = (Decimal(r.n) * 100 / Decimal(r.d)).quantize(Decimal("0.01"), ROUND_HALF_UP)
        assert r.p == exact, (r.n, r.d)


def test_percentage_of_nothing_is_null(spark):
    assert spark.range(1).select(percent("1", "0").alias("p")).first().p is None
