"""Checks find planted defects, and cascades remove what depends on a row."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspan.operators import quality
from civicspan.operators.cascade import cascade_delete
from civicspan.operators.joins import decode
from civicspan.sources.datasets import Tables
from micro import declared


def found(report):
    return {(r.table_name, r.check_name, r.detail): r.violations for r in report.collect() if r.violations}


def test_clean_fixture_only_lacks_undeclared_values(micro):
    kinds = {(table, check) for table, check, _ in found(quality.validation_report(micro))}
    # The fixture leaves required ids out and names a code table that it does not fill.
    assert {check for _, check in kinds} == {"not_null"}


def test_planted_defects_are_counted(spark, micro):
    columns = ["offense_id", "incident_id", "offense_code", "location_id", "attempt_complete_flag"]
    offenses = declared(
        spark,
        "nibrs_offense",
        columns,
        [(1, 101, "13B", 1, "A"), (1, 101, "13B", 1, "X"), (2, 999, "ZZZZZZ", 1, "C "), (3, 999, "13A", None, None)]
        + [(10 + i, 102, "13A", 1, "C") for i in range(11)],
    )
    report = found(quality.validation_report(micro.replace(nibrs_offense=offenses)))
    mine = {key[1:]: n for key, n in report.items() if key[0] == "nibrs_offense"}
    assert mine == {
        ("primary_key", "offense_id"): 1,
        ("not_null", "location_id"): 1,
        ("length", "offense_code"): 1,
        ("domain", "attempt_complete_flag"): 2,
        ("row_limit", "incident_id"): 1,
        ("foreign_key", "incident_id->nibrs_incident"): 2,
        ("foreign_key", "offense_code->nibrs_offense_type"): 1,
    }


def test_types(spark):
    text = spark.createDataFrame([("1",), ("NS",), (None,), ("70000",)], "age string")
    assert [tuple(r) for r in quality.type_violations(text, {"age": "smallint"}).collect()] == [("age", 2)]


def test_composite_keys(spark):
    links = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 2)], "victim_id int, offense_id int")
    assert [tuple(r) for r in quality.key_violations(links, ["victim_id", "offense_id"]).collect()] == [(1, 2, 2)]


def test_cascade_removes_dependents_and_leaves_the_rest(spark):
    tables = Tables(
        {
            "nibrs_month": declared(spark, "nibrs_month", ["did", "data_year"], [(1, 2020), (2, 2021), (3, None)]),
            "nibrs_incident": declared(
                spark, "nibrs_incident", ["incident_id", "did"], [(10, 1), (20, 2), (30, None), (40, 9), (50, 3)]
            ),
            "nibrs_victim": declared(
                spark, "nibrs_victim", ["victim_id", "incident_id"], [(100, 10), (200, 20), (300, 30)]
            ),
            "nibrs_offense": declared(
                spark, "nibrs_offense", ["offense_id", "incident_id"], [(1, 10), (2, 20), (3, 40)]
            ),
            "nibrs_victim_offense": declared(
                spark,
                "nibrs_victim_offense",
                ["victim_id", "offense_id"],
                [(100, 1), (200, 2), (200, 1), (100, 2), (300, 3)],
            ),
        }
    )
    kept = cascade_delete(tables, "nibrs_month", F.col("data_year") == 2020)
    keys = {
        "nibrs_month": "did",
        "nibrs_incident": "incident_id",
        "nibrs_victim": "victim_id",
        "nibrs_offense": "offense_id",
    }
    ids = {name: sorted(r[0] for r in kept[name].select(key).collect()) for name, key in keys.items()}
    assert ids == {
        "nibrs_month": [2, 3],
        "nibrs_incident": [20, 30, 40, 50],
        "nibrs_victim": [200, 300],
        "nibrs_offense": [2, 3],
    }
    assert sorted((r.victim_id, r.offense_id) for r in kept["nibrs_victim_offense"].collect()) == [(200, 2), (300, 3)]
    assert kept["nibrs_incident"].columns == tables["nibrs_incident"].columns


def test_decode_keeps_or_drops_unknown_codes(spark):
    people = spark.createDataFrame([(1, 1), (2, 9)], "victim_id int, race_id int")
    races = spark.createDataFrame([(1, "W")], "race_id int, race_code string")
    assert decode(people, races, "race_id", ["race_code"]).count() == 2
    assert decode(people, races, "race_id", ["race_code"], "inner").count() == 1
