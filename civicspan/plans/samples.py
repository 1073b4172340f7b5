"""Incidents, offenses, victims and locations of one state and year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspan.plans.incidents import AGENCY_KEY, agencies
from civicspan.sources.datasets import Tables


def _months(t: Tables, state: str, year: int) -> DataFrame:
    """Reporting months of a state's agencies. A month id that repeats repeats its incidents."""
    months = t["nibrs_month"].filter(F.col("data_year") == year).select("nibrs_month_id", *AGENCY_KEY)
    in_state = agencies(t, "state_abbr").filter(F.col("state_abbr") == state)
    return months.join(in_state, AGENCY_KEY).select("nibrs_month_id")


def state_year_incidents(t: Tables, state: str, year: int) -> DataFrame:
    """All columns of the incidents of one state and year."""
    incidents = t["nibrs_incident"]
    return incidents.join(_months(t, state, year), "nibrs_month_id").select(incidents.columns)


def _offenses_of(t: Tables, offense_code: str) -> DataFrame:
    code = t["nibrs_offense_type"].filter(F.col("offense_code") == offense_code).select("offense_code")
    return t["nibrs_offense"].filter(F.col("offense_code") == offense_code).join(code, "offense_code")


def state_year_offense(t: Tables, state: str, year: int, offense_code: str) -> DataFrame:
    """All columns of the offenses with one code, in one state and year."""
    incidents = state_year_incidents(t, state, year).select("incident_id")
    columns = t["nibrs_offense"].columns
    return _offenses_of(t, offense_code).join(incidents, "incident_id").select(columns)


def victim_demographics(t: Tables, state: str, year: int, offense_code: str) -> DataFrame:
    """Race, age and ethnicity of the victims of one offense, in one state and year.

    Victims are tied to offenses by the link table, never by the incident they share.
    """
    incidents = state_year_incidents(t, state, year).select("incident_id")
    victim_ids = (
        t["nibrs_victim_offense"]
        .join(_offenses_of(t, offense_code).select("offense_id"), "offense_id")
        .select("victim_id")
    )
    victims = t["nibrs_victim"].select(
        "victim_id", "incident_id", "race_id", "age_id", "age_num", "ethnicity_id"
    )
    return (
        victims.join(victim_ids, "victim_id")
        .join(incidents, "incident_id")
        .join(t["ref_race"].select("race_id", "race_code"), "race_id")
        .join(t["nibrs_age"].select("age_id", "age_code"), "age_id")
        .join(t["nibrs_ethnicity"].select("ethnicity_id", "ethnicity_code"), "ethnicity_id")
        .select("race_code", "age_code", "age_num", "ethnicity_code")
    )


def offense_locations(t: Tables, state: str, year: int, offense_code: str) -> DataFrame:
    """Where the offenses of one code took place, in one state and year."""
    counts = (
        state_year_offense(t, state, year, offense_code)
        .groupBy("location_id")
        .agg(F.count("*").alias("offenses"))
    )
    return (
        counts.join(t["nibrs_location_type"].select("location_id", "location_code", "location_name"), "location_id")
        .groupBy("location_code", "location_name")
        .agg(F.sum("offenses").alias("offenses"))
        .orderBy("location_code", "location_name")
    )
