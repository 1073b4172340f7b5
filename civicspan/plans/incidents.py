"""Offenses joined with their incidents and agencies, per offense and per incident."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspan.operators.joins import joined_text, share_of_total
from civicspan.sources.datasets import Tables

OFFENSE_SEPARATOR = ",,,,, "
MATCH = ["incident_id", "offense_code"]
#: An agency has a row for each year; an incident belongs to that of its own year.
AGENCY_KEY = ["agency_id", "data_year"]
INCIDENT_COLUMNS = ["incident_id", "incident_date", "submission_date", "cleared_except_id"]
AGENCY_COLUMNS = [
    "pub_agency_name",
    "agency_type_name",
    "submitting_agency_name",
    "county_name",
    "population_group_desc",
    "parent_pop_group_desc",
    "population",
]


def offense_names(t: Tables) -> DataFrame:
    return t["nibrs_offense_type"].select("offense_code", "offense_name")


def agencies(t: Tables, *columns: str) -> DataFrame:
    """The yearly agencies' keys and the named columns, to be joined on ``AGENCY_KEY``."""
    return t["agencies"].select(*AGENCY_KEY, *columns)


def offense_groups(t: Tables) -> DataFrame:
    """Offense rows per incident and code. Counting first keeps every later join small."""
    return t["nibrs_offense"].groupBy(*MATCH).agg(F.count("*").alias("offenses"))


def incident_offenses(t: Tables) -> DataFrame:
    """One row per offense, with incident, offense type and agency."""
    incidents = t["nibrs_incident"].select(*INCIDENT_COLUMNS, *AGENCY_KEY)
    offenses = t["nibrs_offense"].select("offense_id", *MATCH, "attempt_complete_flag")
    # Agencies join the incidents, which are fewer than the offenses.
    placed = incidents.join(agencies(t, *AGENCY_COLUMNS), AGENCY_KEY)
    return (
        offenses.join(offense_names(t), "offense_code")
        .join(placed, "incident_id")
        .select(
            "incident_id",
            "offense_id",
            "incident_date",
            "submission_date",
            "cleared_except_id",
            "offense_code",
            "offense_name",
            "attempt_complete_flag",
            "agency_id",
            *AGENCY_COLUMNS,
        )
    )


def incident_offenses_aggregated(t: Tables) -> DataFrame:
    """One row per incident: its agency, the number of offenses and their names in order."""
    per_incident = (
        offense_groups(t)
        .join(offense_names(t), "offense_code")
        .groupBy("incident_id")
        .agg(
            F.sum("offenses").alias("offenses_count"),
            joined_text("offense_name", "offenses", "offense_name", OFFENSE_SEPARATOR).alias("offenses"),
        )
    )
    incidents = t["nibrs_incident"].select(*INCIDENT_COLUMNS, *AGENCY_KEY)
    placed = incidents.join(agencies(t, *AGENCY_COLUMNS), AGENCY_KEY)
    return per_incident.join(placed, "incident_id").select(
        *INCIDENT_COLUMNS, *AGENCY_COLUMNS, "offenses_count", "offenses"
    )


def incident_offenses_single(t: Tables) -> DataFrame:
    return incident_offenses_aggregated(t).filter(F.col("offenses_count") == 1)


def incident_offenses_multiple(t: Tables) -> DataFrame:
    return incident_offenses_aggregated(t).filter(F.col("offenses_count") > 1)


def agency_offense_counts(t: Tables) -> DataFrame:
    """Offense rows per agency and year, clearance code and offense code.

    A busy agency arrives at the agency join as a few rows per code instead of one row for
    each of its offenses.
    """
    incidents = t["nibrs_incident"].select("incident_id", *AGENCY_KEY, "cleared_except_id")
    return (
        offense_groups(t)
        .join(incidents, "incident_id")
        .groupBy(*AGENCY_KEY, "cleared_except_id", "offense_code")
        .agg(F.sum("offenses").alias("offenses"))
    )


def offense_totals(t: Tables) -> DataFrame:
    """Offenses by type over all places, most frequent first."""
    return (
        agency_offense_counts(t)
        .join(agencies(t), AGENCY_KEY)
        .groupBy("offense_code")
        .agg(F.sum("offenses").alias("offenses"))
        .join(offense_names(t), "offense_code")
        .groupBy("offense_name")
        .agg(F.sum("offenses").alias("offensecount"))
        .orderBy(F.desc("offensecount"), "offense_name")
    )


def offense_count_distribution(t: Tables) -> DataFrame:
    """How many incidents have one, two, … offenses, and their share of all incidents."""
    sizes = (
        offense_groups(t)
        .join(offense_names(t).select("offense_code"), "offense_code")
        .groupBy("incident_id")
        .agg(F.sum("offenses").alias("offensecount"))
    )
    by_agency = (
        sizes.join(t["nibrs_incident"].select("incident_id", *AGENCY_KEY), "incident_id")
        .groupBy(*AGENCY_KEY, "offensecount")
        .agg(F.count("*").alias("incidents"))
    )
    counts = (
        by_agency.join(agencies(t), AGENCY_KEY)
        .groupBy("offensecount")
        .agg(F.sum("incidents").alias("thecount"))
    )
    return share_of_total(counts, "thecount", "percentage_records").orderBy("offensecount")
