"""Reconciliation of arrests with offenses: what does not match, and what counts twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspan.operators.joins import absent_from
from civicspan.plans.clearance import (
    NOT_EXCEPTIONAL,
    arrest_groups,
    county_incident_arrests,
    matched_arrests,
)
from civicspan.plans.incidents import AGENCY_KEY, MATCH, agencies, offense_groups, offense_names
from civicspan.sources.datasets import Tables


def matched_incidents(t: Tables, clearance: Column | None = None) -> DataFrame:
    """Ids of placed incidents in which an arrest names a known offense of the incident.

    The incidents of ``matched_arrests``; semi joins carry only ids and end hashed by incident.
    """
    incidents = t["nibrs_incident"]
    if clearance is not None:
        incidents = incidents.filter(clearance)
    placed = incidents.select("incident_id", *AGENCY_KEY).join(agencies(t), AGENCY_KEY, "left_semi")
    return (
        offense_groups(t)
        .select(*MATCH)
        .join(t["nibrs_arrestee"].select(*MATCH), MATCH, "left_semi")
        .join(offense_names(t), "offense_code", "left_semi")
        .join(placed, "incident_id", "left_semi")
        .select("incident_id")
    )


def unmatched_arrests(t: Tables, broad: bool = False, **arrest_filters) -> DataFrame:
    """Arrests, counted per incident and code, in incidents without any matching arrest.

    The narrow form leaves out every incident with a match. The broad form leaves out only
    those not cleared by exception, so arrests in exceptionally cleared incidents are listed
    too. Both judge whole incidents: an arrest that matches nothing is not listed when another
    arrest of its incident does.
    """
    matched = matched_incidents(t, F.col("cleared_except_id") == NOT_EXCEPTIONAL if broad else None)
    return absent_from(arrest_groups(t, **arrest_filters), matched, "incident_id")


def unmatched_arrests_by_code(t: Tables, **arrest_filters) -> DataFrame:
    """Unmatched arrests, narrow form, per offense code."""
    return (
        unmatched_arrests(t, **arrest_filters)
        .groupBy("offense_code")
        .agg(F.sum("arrests").alias("arrests"))
        .orderBy(F.desc("arrests"), "offense_code")
    )


def unmatched_arrests_by_agency(t: Tables, broad: bool = True, **arrest_filters) -> DataFrame:
    """Unmatched arrests per agency and offense code. Agencies that share a name stay apart, and so do
    the names that one agency had in different years."""
    per_agency = (
        unmatched_arrests(t, broad, **arrest_filters)
        .join(t["nibrs_incident"].select("incident_id", *AGENCY_KEY), "incident_id")
        .groupBy(*AGENCY_KEY, "offense_code")
        .agg(F.sum("arrests").alias("arrests"))
    )
    return (
        per_agency.join(agencies(t, "pub_agency_name"), AGENCY_KEY)
        .join(offense_names(t), "offense_code")
        .groupBy("agency_id", "pub_agency_name", "offense_code")
        .agg(F.max("offense_name").alias("offense_name"), F.sum("arrests").alias("arrests"))
        .orderBy(F.desc("arrests"), "pub_agency_name", "offense_code")
        .select("pub_agency_name", "offense_code", "offense_name", "arrests")
    )


def county_offense_arrests(t: Tables, county: str, offense_like: str, **arrest_filters) -> DataFrame:
    """Arrests per incident for one county and the offenses whose name fits the pattern."""
    return matched_arrests(t, county=county, offense_like=offense_like, **arrest_filters).select(
        "incident_id", F.col("count_arrests").alias("arrests")
    )


def exceptional_with_arrest(t: Tables, **arrest_filters) -> DataFrame:
    """Arrests in incidents that are marked as cleared by exception."""
    return matched_arrests(t, F.col("cleared_except_id") != NOT_EXCEPTIONAL, **arrest_filters)


def cleared_without_arrest(t: Tables) -> DataFrame:
    """Offenses without an arrest in incidents that another offense's arrest cleared."""
    offenses = t["nibrs_offense"].select("offense_id", *MATCH)
    cleared = county_incident_arrests(t).select("incident_id", "county_name").distinct()
    return (
        offenses.join(arrest_groups(t).select(*MATCH), MATCH, "left_anti")
        .join(cleared, "incident_id")
        .join(offense_names(t), "offense_code")
        .select("incident_id", "offense_id", "county_name", "offense_name")
    )


def arrest_top_offense(t: Tables, ranks: DataFrame) -> DataFrame:
    """Per offense code that ranks highest in its multi-offense incident: arrests in those
    incidents, and how many of them name that code. ``ranks`` maps offense_code to rank, 1 highest."""
    top = (
        offense_groups(t)
        .join(ranks.select("offense_code", "rank"), "offense_code")
        .groupBy("incident_id")
        .agg(
            F.min(F.struct("rank", "offense_code")).getField("offense_code").alias("top_code"),
            F.sum("offenses").alias("offenses"),
        )
        .filter(F.col("offenses") > 1)
    )
    hit = F.when(F.col("offense_code") == F.col("top_code"), F.col("arrests")).otherwise(F.lit(0))
    return (
        arrest_groups(t)
        .join(top, "incident_id")
        .groupBy("top_code")
        .agg(F.sum("arrests").alias("arrests"), F.sum(hit).alias("arrests_for_top"))
    )
