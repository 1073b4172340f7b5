"""Every view and report on the ten-incident fixture, against results worked out by hand."""

from __future__ import annotations

from civicspan.plans import clearance, incidents, lookups, reconcile
from micro import declared


def rows(result, *columns):
    picked = result.select(*columns) if columns else result
    return [tuple(row) for row in picked.collect()]


def test_incident_offenses_has_one_row_per_offense(micro):
    result = incidents.incident_offenses(micro)
    assert result.columns == [
        "incident_id", "offense_id", "incident_date", "submission_date", "cleared_except_id",
        "offense_code", "offense_name", "attempt_complete_flag", "agency_id", "pub_agency_name",
        "agency_type_name", "submitting_agency_name", "county_name", "population_group_desc",
        "parent_pop_group_desc", "population",
    ]
    assert sorted(rows(result, "offense_id")) == [(i,) for i in range(1, 15)]


def test_aggregated_offense_names_are_ordered(micro):
    result = dict(
        (i, (n, text))
        for i, n, text in rows(
            incidents.incident_offenses_aggregated(micro), "incident_id", "offenses_count", "offenses"
        )
    )
    assert result[102] == (2, "All Other Larceny,,,,, Simple Assault")
    assert result[106] == (3, "Aggravated Assault,,,,, All Other Larceny,,,,, Drug/Narcotic Violations")
    assert result[110] == (2, "Assisting or Promoting Prostitution,,,,, Prostitution")
    assert sum(n == 1 for n, _ in result.values()) == 7


def test_single_and_multiple_split_the_incidents(micro):
    whole = rows(incidents.incident_offenses_aggregated(micro), "incident_id")
    single = rows(incidents.incident_offenses_single(micro), "incident_id")
    multiple = rows(incidents.incident_offenses_multiple(micro), "incident_id")
    assert (len(single), len(multiple)) == (7, 3)
    assert sorted(single + multiple) == sorted(whole)


def test_repeated_offense_codes_are_repeated_in_the_text(spark, micro):
    twice = micro["nibrs_offense"].filter("incident_id = 102").unionByName(micro["nibrs_offense"])
    result = incidents.incident_offenses_aggregated(micro.replace(nibrs_offense=twice))
    assert rows(result.filter("incident_id = 102"), "offenses_count", "offenses") == [
        (4, "All Other Larceny,,,,, All Other Larceny,,,,, Simple Assault,,,,, Simple Assault")
    ]


def test_offenses_without_a_name_are_counted_but_not_listed(spark, micro):
    named = micro["nibrs_offense_type"].filter("offense_code <> '13B'")
    unnamed = declared(spark, "nibrs_offense_type", ["offense_code", "offense_name"], [("13B", None)])
    result = incidents.incident_offenses_aggregated(micro.replace(nibrs_offense_type=named.unionByName(unnamed)))
    found = rows(result.filter("incident_id IN (101, 102)"), "incident_id", "offenses_count", "offenses")
    assert sorted(found) == [(101, 1, None), (102, 2, "All Other Larceny")]


def test_county_incident_arrests(micro):
    assert sorted(rows(clearance.county_incident_arrests(micro))) == [
        (101, "ALPHA", "Simple Assault", 2),
        (102, "ALPHA", "All Other Larceny", 1),
        (107, "NOT SPECIFIED", "Prostitution", 1),
        (110, "MONTGOMERY", "Prostitution", 2),
    ]


def test_unmatched_arrests_narrow_and_broad(micro):
    assert rows(reconcile.unmatched_arrests_by_code(micro)) == [("90Z", 1)]
    assert sorted(rows(reconcile.unmatched_arrests_by_agency(micro))) == [
        ("Alpha City", "13B", "Simple Assault", 1),
        ("Montgomery PD", "90Z", "All Other Offenses", 1),
    ]
    assert rows(reconcile.unmatched_arrests_by_agency(micro, broad=False)) == [
        ("Montgomery PD", "90Z", "All Other Offenses", 1)
    ]
    assert rows(reconcile.unmatched_arrests_by_code(micro, offense_code="13A")) == []


def test_county_offense_arrests(micro):
    assert rows(reconcile.county_offense_arrests(micro, "MONTGOMERY", "%prost%")) == [(110, 2)]
    assert rows(reconcile.county_offense_arrests(micro, "MONTGOMERY", "%prost%", incident_id=107)) == []


def test_exceptional_with_arrest(micro):
    assert rows(reconcile.exceptional_with_arrest(micro)) == [(104, "ALPHA", "Simple Assault", 1)]


def test_exceptional_by_code_keeps_codes_apart(micro):
    assert sorted(rows(clearance.exceptional_by_code(micro))) == [
        ("ALPHA", "Simple Assault", 0, 0, 0, 1, 0),
        ("ALPHA", "Simple Assault", 0, 1, 0, 0, 0),
        ("MONTGOMERY", "Aggravated Assault", 1, 0, 0, 0, 0),
        ("MONTGOMERY", "All Other Larceny", 0, 0, 0, 0, 1),
    ]


def test_offense_count_distribution(micro):
    assert rows(incidents.offense_count_distribution(micro)) == [(1, 7, 0.7), (2, 2, 0.2), (3, 1, 0.1)]


def test_offense_totals(micro):
    assert rows(incidents.offense_totals(micro)) == [
        ("Simple Assault", 4),
        ("All Other Larceny", 3),
        ("Aggravated Assault", 2),
        ("Drug/Narcotic Violations", 2),
        ("Prostitution", 2),
        ("Assisting or Promoting Prostitution", 1),
    ]


def test_cleared_without_arrest(micro):
    assert sorted(rows(reconcile.cleared_without_arrest(micro), "incident_id", "offense_name")) == [
        (102, "Simple Assault"),
        (110, "Assisting or Promoting Prostitution"),
    ]


RATES = [
    # county, offense, offenses, total, total %, normal %, exceptional %, normal, exceptional, arrests, reasons
    ("ALPHA", "All Other Larceny", 1, 1, 100.0, 100.0, 0.0, 1, 0, 1, 0, 0, 0, 0, 0),
    ("ALPHA", "Simple Assault", 4, 3, 75.0, 25.0, 50.0, 1, 2, 2, 0, 1, 0, 1, 0),
    ("MONTGOMERY", "Prostitution", 1, 1, 100.0, 100.0, 0.0, 1, 0, 2, 0, 0, 0, 0, 0),
    ("MONTGOMERY", "Aggravated Assault", 2, 1, 50.0, 0.0, 50.0, 0, 1, 0, 1, 0, 0, 0, 0),
    ("MONTGOMERY", "All Other Larceny", 2, 1, 50.0, 0.0, 50.0, 0, 1, 0, 0, 0, 0, 0, 1),
    ("MONTGOMERY", "Assisting or Promoting Prostitution", 1, 0, 0.0, 0.0, 0.0, 0, 0, 0, 0, 0, 0, 0, 0),
    ("MONTGOMERY", "Drug/Narcotic Violations", 2, 0, 0.0, 0.0, 0.0, 0, 0, 0, 0, 0, 0, 0, 0),
    ("NOT SPECIFIED", "Prostitution", 1, 1, 100.0, 100.0, 0.0, 1, 0, 1, 0, 0, 0, 0, 0),
]


def test_county_clearance_rates_in_report_order(micro):
    assert rows(clearance.county_clearance_rates(micro)) == RATES


def test_counts_by_view_give_the_same_rates(micro):
    by_view = clearance.with_rates(clearance.county_clearances_by_view(micro))
    assert sorted(rows(by_view)) == sorted(RATES)


def test_normal_report_counts_arrests_only(micro):
    report = {(r.county_name, r.offense_name): r for r in clearance.normal_clearance_report(micro).collect()}
    assert float(report["ALPHA", "Simple Assault"].solved_crime_ratio) == 25.0
    assert float(report["MONTGOMERY", "Aggravated Assault"].solved_crime_ratio) == 0.0
    assert rows(clearance.total_arrests(micro)) == [(6,)]


def test_lookups(micro):
    assert rows(lookups.rows_where(micro, "nibrs_offense_type", "offense_code", "40A"), "offense_name") == [
        ("Prostitution",)
    ]
    assert lookups.code_table(micro, "nibrs_cleared_except").count() == 6
    assert rows(lookups.first_clearance_code(micro)) == [(1,)]


def test_top_offense_of_incidents_with_several(spark, micro):
    ranks = spark.createDataFrame(
        [("23H", 2), ("13B", 1), ("35A", 3), ("13A", 1), ("40A", 5), ("40B", 4)], "offense_code string, rank int"
    )
    result = reconcile.arrest_top_offense(micro, ranks)
    # Incident 102 is led by 13B and has arrests for 23H and 90Z; 110 by 40B with two for 40A.
    assert sorted(rows(result)) == [("13B", 2, 0), ("40B", 2, 0)]
