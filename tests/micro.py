"""Ten incidents that cover the awkward cases, as declared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspan.sources.datasets import Tables
from civicspan.sources.schema import REGISTRY

AGENCIES = [
    (1, "Alpha County PD", "County", "ALPHA"),
    (2, "Alpha City", "City", "ALPHA"),
    (3, "Montgomery PD", "County", "MONTGOMERY"),
    (4, "State Police", "Other State Agency", "NOT SPECIFIED"),
]
TYPES = [
    ("13A", "Aggravated Assault", "Person"),
    ("13B", "Simple Assault", "Person"),
    ("23H", "All Other Larceny", "Property"),
    ("35A", "Drug/Narcotic Violations", "Society"),
    ("40A", "Prostitution", "Society"),
    ("40B", "Assisting or Promoting Prostitution", "Society"),
    ("90Z", "All Other Offenses", "Society"),
]
CLEARED = [(i, code) for i, code in enumerate("ABCDEN", start=1)]
INCIDENTS = [
    (101, 1, 6),
    (102, 1, 6),
    (103, 2, 2),
    (104, 2, 4),
    (105, 3, 6),
    (106, 3, 6),
    (107, 4, 6),
    (108, 3, 1),
    (109, 3, 5),
    (110, 3, 6),
]
OFFENSES = [
    (1, 101, "13B"),
    (2, 102, "13B"),
    (3, 102, "23H"),
    (4, 103, "13B"),
    (5, 104, "13B"),
    (6, 105, "35A"),
    (7, 106, "35A"),
    (8, 106, "23H"),
    (9, 106, "13A"),
    (10, 107, "40A"),
    (11, 108, "13A"),
    (12, 109, "23H"),
    (13, 110, "40A"),
    (14, 110, "40B"),
]
ARRESTS = [
    (1, 101, "13B"),
    (2, 101, "13B"),
    (3, 102, "23H"),
    (4, 104, "13B"),
    (5, 105, "90Z"),
    (6, 107, "40A"),
    (7, 110, "40A"),
    (8, 110, "40A"),
    (9, 102, "90Z"),
]


def declared(spark: SparkSession, name: str, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A declared table from a few of its columns; the others are NULL."""
    schema = REGISTRY[name].schema
    given = spark.createDataFrame(rows, ", ".join(f"{c} {schema[c].dataType.simpleString()}" for c in columns))
    return given.select(
        [(F.col(f.name) if f.name in columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]
    )


def in_2021(rows: DataFrame) -> DataFrame:
    return rows.withColumn("data_year", F.lit(2021))


def clearance_tables(spark: SparkSession, agencies, types, incidents, offenses, arrests, cleared=CLEARED) -> Tables:
    return Tables(
        {
            "agencies": in_2021(
                declared(spark, "agencies", ["agency_id", "pub_agency_name", "agency_type_name", "county_name"], agencies)
            ),
            "nibrs_offense_type": declared(
                spark, "nibrs_offense_type", ["offense_code", "offense_name", "crime_against"], types
            ),
            "nibrs_cleared_except": declared(
                spark, "nibrs_cleared_except", ["cleared_except_id", "cleared_except_code"], cleared
            ),
            "nibrs_incident": in_2021(
                declared(spark, "nibrs_incident", ["incident_id", "agency_id", "cleared_except_id"], incidents)
            ),
            "nibrs_offense": declared(spark, "nibrs_offense", ["offense_id", "incident_id", "offense_code"], offenses),
            "nibrs_arrestee": declared(
                spark, "nibrs_arrestee", ["arrestee_id", "incident_id", "offense_code"], arrests
            ),
        }
    )


def micro_tables(spark: SparkSession) -> Tables:
    return clearance_tables(spark, AGENCIES, TYPES, INCIDENTS, OFFENSES, ARRESTS)
