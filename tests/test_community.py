"""Years, taxonomies, population, participation and demographic groups on small tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from civicspan.plans import clearance, community, incidents, reconcile, samples, views
from civicspan.sources.datasets import Tables
from micro import CLEARED, OFFENSES, declared, in_2021


def test_views_answer_sql(spark, micro):
    views.create_views(micro)
    report = spark.sql(
        """SELECT county_name, offense_name, round(clearances_normal * 100 / offense_count, 2) AS normal
           FROM county_incident_clearances_all_aggregated WHERE offense_name ILIKE '%prost%'"""
    )
    assert sorted(tuple(r) for r in report.collect()) == [
        ("MONTGOMERY", "Assisting or Promoting Prostitution", 0.0),
        ("MONTGOMERY", "Prostitution", 100.0),
        ("NOT SPECIFIED", "Prostitution", 100.0),
    ]
    for name in views.VIEWS:
        assert spark.sql(f"SELECT count(*) FROM {name}").first()[0] > 0
    joined = spark.sql(
        """SELECT count(*) FROM incident_offenses o JOIN nibrs_arrestee a
           ON a.incident_id = o.incident_id AND a.offense_code = o.offense_code"""
    )
    assert joined.first()[0] == 7


def yearly_tables(spark):
    """Agency 1 moves from county A to county B between the years."""
    return Tables(
        {
            "agencies": declared(
                spark,
                "agencies",
                ["agency_id", "data_year", "county_name", "state_abbr", "population"],
                [(1, 2020, "A", "MD", 100), (1, 2021, "B", "MD", 120), (2, 2021, "B", "MD", 80), (3, 2021, "B", "VA", 0)],
            ),
            "nibrs_incident": declared(
                spark,
                "nibrs_incident",
                ["incident_id", "agency_id", "data_year", "cleared_except_id"],
                [(1, 1, 2020, 1), (2, 1, 2020, 6), (3, 1, 2021, 6), (4, 2, 2021, 2), (5, 2, 2021, 3), (6, 3, 2021, 6)],
            ),
            "nibrs_offense": declared(
                spark,
                "nibrs_offense",
                ["offense_id", "incident_id", "offense_code", "data_year"],
                [(i, i, "X", 2020 if i < 3 else 2021) for i in range(1, 7)],
            ),
            "nibrs_arrestee": declared(
                spark,
                "nibrs_arrestee",
                ["arrestee_id", "incident_id", "offense_code", "data_year"],
                [(1, 3, "X", 2021), (2, 3, "X", 2021)],
            ),
            "nibrs_offense_type": declared(spark, "nibrs_offense_type", ["offense_code", "offense_name"], [("X", "x")]),
            "nibrs_cleared_except": declared(
                spark, "nibrs_cleared_except", ["cleared_except_id", "cleared_except_code"], CLEARED
            ),
        }
    )


def test_rates_by_year_follow_the_agency_of_that_year(spark):
    rates = clearance.with_rates(clearance.county_clearances(yearly_tables(spark), by_year=True))
    found = rates.select("county_name", "data_year", "offense_count", "clearances_total", "arrests").collect()
    assert sorted(tuple(r) for r in found) == [("A", 2020, 2, 1, 0), ("B", 2021, 4, 3, 2)]


def test_several_years_count_each_offense_once(spark):
    t = yearly_tables(spark)
    assert incidents.incident_offenses(t).count() == 6
    assert incidents.incident_offenses_aggregated(t).count() == 6
    rates = clearance.county_clearance_rates(t).collect()
    assert sorted((r.county_name, r.offense_count, r.clearances_normal, r.arrests) for r in rates) == [
        ("A", 2, 0, 0),
        ("B", 4, 1, 2),
    ]
    by_view = clearance.county_clearances_by_view(t).collect()
    assert sorted((r.county_name, r.offense_count, r.arrests) for r in by_view) == [("A", 2, 0), ("B", 4, 2)]
    per_year = sorted((r.county_name, r.data_year, r.incidents) for r in community.incidents_per_capita(t).collect())
    assert per_year == [("A", 2020, 2), ("B", 2021, 4)]
    assert clearance.county_incident_arrests(t).count() == 1
    assert [tuple(r) for r in reconcile.matched_incidents(t).collect()] == [(3,)]


def test_one_year_of_all_tables(spark):
    year = yearly_tables(spark).one_year(2021)
    rates = clearance.state_county_clearance_rates(year).collect()
    assert sorted((r.state_abbr, r.county_name, r.offense_count, r.clearances_total) for r in rates) == [
        ("MD", "B", 3, 3),
        ("VA", "B", 1, 0),
    ]


def test_trend_compares_with_the_year_before(spark):
    t = yearly_tables(spark)
    stay = t["agencies"].withColumn("county_name", F.lit("B"))
    trend = clearance.clearance_trend(t.replace(agencies=stay)).orderBy("data_year").collect()
    assert [(r.data_year, float(r.clearance_ratio_total_percent)) for r in trend] == [(2020, 50.0), (2021, 75.0)]
    assert [r.percent_change and float(r.percent_change) for r in trend] == [None, 25.0]


def test_incidents_per_capita(spark):
    kept = yearly_tables(spark).keep("nibrs_incident")
    assert kept["nibrs_incident"].storageLevel.useMemory
    rates = community.incidents_per_capita(yearly_tables(spark).one_year(2021), per=100).collect()
    assert [(r.county_name, r.data_year, r.incidents, r.population, r.incidents_per_capita) for r in rates] == [
        ("B", 2021, 4, 200, 2.0)
    ]


def test_taxonomy_sums_offenses_of_a_category(spark, micro):
    taxonomy = spark.createDataFrame(
        [("Prostitution", "vice"), ("Assisting or Promoting Prostitution", "vice"), ("Simple Assault", "harm")],
        "offense_name string, category string",
    )
    found = clearance.taxonomy_clearance_rates(micro, taxonomy).collect()
    assert sorted((r.county_name, r.category, r.offense_count, float(r.clearance_ratio_total_percent)) for r in found) == [
        ("ALPHA", "harm", 4, 75.0),
        ("MONTGOMERY", "vice", 2, 50.0),
        ("NOT SPECIFIED", "vice", 1, 100.0),
    ]


def test_participation_counts_zero_reports_and_covering_agencies(spark):
    t = Tables(
        {
            "agencies": in_2021(
                declared(
                    spark,
                    "agencies",
                    ["agency_id", "legacy_ori", "covered_by_legacy_ori"],
                    [(1, "ORI1", None), (2, "ORI2", "ORI1"), (3, "ORI3", "ORI2")],
                )
            ),
            "nibrs_month": declared(
                spark,
                "nibrs_month",
                ["nibrs_month_id", "agency_id", "data_year", "month_num", "reported_status"],
                [(m, 1, 2021, m, "I" if m % 2 else "Z") for m in range(1, 13)]
                + [(20 + m, 3, 2021, m, "U" if m == 12 else "I") for m in range(1, 13)]
                + [(40, 3, 2021, 1, "I")],
            ),
        }
    )
    found = sorted(tuple(r) for r in community.agency_participation(t).collect())
    assert found == [(1, 2021, 12, 0), (2, 2021, 0, 1)]
    assert (3, 2021, 11, 0) in [tuple(r) for r in community.agency_participation(t, months=11).collect()]


def test_time_to_arrest_keeps_negative_gaps(spark, micro):
    day = datetime.datetime(2021, 1, 10)
    incidents = declared(spark, "nibrs_incident", ["incident_id", "incident_date"], [(1, day), (2, day)])
    arrests = declared(
        spark,
        "nibrs_arrestee",
        ["arrestee_id", "incident_id", "offense_code", "arrest_date"],
        [(i, 1 + i % 2, "13A", day + datetime.timedelta(days=d)) for i, d in enumerate([0, 3, 10, -1])]
        + [(9, 1, "13A", None)],
    )
    row = community.time_to_arrest(micro.replace(nibrs_incident=incidents, nibrs_arrestee=arrests)).first()
    assert tuple(row) == ("Aggravated Assault", 5, 1, 3.0, 1.5)


def test_clearance_by_group_of_victims_and_offenders(spark, micro):
    links = [(1, 1), (1, 2), (2, 4), (3, 6), (3, 14)]  # 14 is not cleared by arrest
    t = Tables(
        {
            **micro,
            "nibrs_victim": declared(spark, "nibrs_victim", ["victim_id", "race_id"], [(1, 1), (2, 2), (3, 1)]),
            "nibrs_victim_offense": declared(spark, "nibrs_victim_offense", ["victim_id", "offense_id"], links),
            "nibrs_offender": declared(
                spark, "nibrs_offender", ["offender_id", "incident_id", "race_id"], [(1, 102, 1), (2, 102, 1), (3, 103, 2)]
            ),
            "ref_race": declared(spark, "ref_race", ["race_id", "race_code"], [(1, "W"), (2, "B")]),
        }
    )
    assert len(OFFENSES) == 14
    victims = community.clearance_by_demographic(t, "ref_race", "race_id", "race_code").collect()
    assert sorted((r.offense_name, r.race_code, r.people, r.cleared) for r in victims) == [
        ("Assisting or Promoting Prostitution", "W", 1, 0),
        ("Drug/Narcotic Violations", "W", 1, 0),
        ("Simple Assault", "B", 1, 1),
        ("Simple Assault", "W", 2, 1),
    ]
    offenders = community.clearance_by_demographic(t, "ref_race", "race_id", "race_code", person="offender").collect()
    assert sorted((r.offense_name, r.race_code, r.people, r.cleared) for r in offenders) == [
        ("All Other Larceny", "W", 2, 2),
        ("Simple Assault", "B", 1, 1),
        ("Simple Assault", "W", 2, 0),
    ]


def test_month_ids_that_repeat_repeat_their_incidents(spark):
    t = yearly_tables(spark)
    months = declared(
        spark,
        "nibrs_month",
        ["did", "nibrs_month_id", "agency_id", "data_year"],
        [(1, 7, 1, 2021), (2, 7, 1, 2021), (3, 8, 3, 2021), (4, 9, 1, 2020)],
    )
    incidents = declared(
        spark, "nibrs_incident", ["incident_id", "nibrs_month_id"], [(1, 7), (2, 8), (3, 9), (4, 10)]
    )
    found = samples.state_year_incidents(t.replace(nibrs_month=months, nibrs_incident=incidents), "MD", 2021)
    assert [r.incident_id for r in found.collect()] == [1, 1]
