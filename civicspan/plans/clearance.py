"""Clearances per county and offense, by arrest and by exceptional means.

An arrest names an incident and an offense code, never an offense row, so arrests meet
offenses on both. Clearance code 6 marks incidents that were not cleared by exception.

``county_clearances`` computes everything in one pass. The functions before it build the
same numbers view by view and are the ones to use when a single view is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspan.functions.numbers import count_where, percent
from civicspan.plans.incidents import (
    AGENCY_KEY,
    MATCH,
    agencies,
    agency_offense_counts,
    offense_groups,
    offense_names,
)
from civicspan.sources.datasets import Tables

NOT_EXCEPTIONAL = 6

# Exceptional clearance codes and the columns that count them.
EXCEPTIONS = {
    1: "clearances_exceptional_death_offender",
    2: "clearances_exceptional_prosecution_declined",
    3: "clearances_exceptional_custody_elsewhere",
    4: "clearances_exceptional_victim_uncooperative",
    5: "clearances_exceptional_juvenile_release",
}
REASONS = list(EXCEPTIONS.values())
TOTAL = "clearances_exceptional_total"
SUM_OF_REASONS = " + ".join(REASONS)
COUNTS = ["offense_count", "clearances_normal", TOTAL, "arrests", *REASONS]


def arrest_groups(
    t: Tables,
    incident_id: int | None = None,
    multiple_indicator: str | None = None,
    offense_code: str | None = None,
) -> DataFrame:
    """Arrests per incident and offense code, optionally of some arrests only."""
    arrests = t["nibrs_arrestee"]
    wanted = {"incident_id": incident_id, "multiple_indicator": multiple_indicator, "offense_code": offense_code}
    for column, value in wanted.items():
        if value is not None:
            arrests = arrests.filter(F.col(column) == value)
    return arrests.groupBy(*MATCH).agg(F.count("*").alias("arrests"))


def county_offenses(t: Tables) -> DataFrame:
    """Offenses per county and offense."""
    return (
        agency_offense_counts(t)
        .groupBy(*AGENCY_KEY, "offense_code")
        .agg(F.sum("offenses").alias("offenses"))
        .join(agencies(t, "county_name"), AGENCY_KEY)
        .join(offense_names(t), "offense_code")
        .groupBy("offense_name", "county_name")
        .agg(F.sum("offenses").alias("offense_count"))
    )


def matched_arrests(
    t: Tables,
    clearance: Column | None = None,
    county: str | None = None,
    offense_like: str | None = None,
    **arrest_filters,
) -> DataFrame:
    """Arrests per incident, county and offense, where the arrest names one of its offenses."""
    names, counties = offense_names(t), agencies(t, "county_name")
    incidents = t["nibrs_incident"].select("incident_id", *AGENCY_KEY, "cleared_except_id")
    if offense_like is not None:
        names = names.filter(F.col("offense_name").ilike(offense_like))
    if county is not None:
        counties = counties.filter(F.col("county_name") == county)
    if clearance is not None:
        incidents = incidents.filter(clearance)
    return (
        offense_groups(t)
        .join(arrest_groups(t, **arrest_filters), MATCH)
        .join(names, "offense_code")
        .join(incidents, "incident_id")
        .groupBy("incident_id", *AGENCY_KEY, "offense_name")
        .agg(F.sum(F.col("offenses") * F.col("arrests")).alias("count_arrests"))
        .join(counties, AGENCY_KEY)
        .select("incident_id", "county_name", "offense_name", "count_arrests")
    )


def county_incident_arrests(t: Tables, **arrest_filters) -> DataFrame:
    """Incidents cleared by arrest: one row per incident, county and offense."""
    return matched_arrests(t, F.col("cleared_except_id") == NOT_EXCEPTIONAL, **arrest_filters)


def county_incident_arrests_aggregated(t: Tables) -> DataFrame:
    """Incidents cleared by arrest and their arrests, per county and offense."""
    return (
        county_incident_arrests(t)
        .groupBy("county_name", "offense_name")
        .agg(F.count("offense_name").alias("clearances_normal"), F.sum("count_arrests").alias("arrests"))
    )


def _exceptional_counts(t: Tables, *keys: str) -> DataFrame:
    exceptional = F.col("cleared_except_id") != NOT_EXCEPTIONAL
    reasons = [
        count_where(f"cleared_except_id = {code}", "offenses").alias(name) for code, name in EXCEPTIONS.items()
    ]
    return (
        agency_offense_counts(t)
        .filter(exceptional)
        .join(t["nibrs_cleared_except"].select("cleared_except_id", "cleared_except_code"), "cleared_except_id")
        .join(agencies(t, "county_name"), AGENCY_KEY)
        .join(offense_names(t), "offense_code")
        .groupBy("county_name", "offense_name", *keys)
        .agg(*reasons)
    )


def county_exceptional_clearances(t: Tables) -> DataFrame:
    """Offenses cleared by exception per county and offense, by reason and in total."""
    return _exceptional_counts(t).withColumn(TOTAL, F.expr(SUM_OF_REASONS))


def exceptional_by_code(t: Tables) -> DataFrame:
    """The reason counts with one row for each code that occurs."""
    return _exceptional_counts(t, "cleared_except_code").drop("cleared_except_code")


def county_clearances_by_view(t: Tables) -> DataFrame:
    """Offense, clearance and arrest counts per county and offense, joined from the views."""
    keys = ["offense_name", "county_name"]
    joined = (
        county_offenses(t)
        .join(county_incident_arrests_aggregated(t), keys, "left")
        .join(county_exceptional_clearances(t), keys, "left")
    )
    zero_filled = [F.coalesce(F.col(name), F.lit(0)).alias(name) for name in COUNTS[1:]]
    return joined.select("county_name", "offense_name", "offense_count", *zero_filled)


def incident_clearances(t: Tables, *also: str) -> DataFrame:
    """Offense rows and matching arrests per incident and offense name; ``also`` names further incident columns."""
    incidents = t["nibrs_incident"].select("incident_id", *AGENCY_KEY, "cleared_except_id", *also)
    matched = F.col("offenses") * F.coalesce(F.col("arrests"), F.lit(0))
    return (
        offense_groups(t)
        .join(arrest_groups(t), MATCH, "left")
        .join(offense_names(t), "offense_code")
        .join(incidents, "incident_id")
        .groupBy("incident_id", *AGENCY_KEY, "cleared_except_id", *also, "offense_name")
        .agg(F.sum("offenses").alias("offenses"), F.sum(matched).alias("arrests"))
    )


def agency_clearances(t: Tables, *also: str) -> DataFrame:
    """The counts per agency, year and offense name, before agencies are known.

    Incidents are counted before agencies are joined: what reaches that join are sums per
    agency and offense, however busy one agency is.
    """
    plain = f"cleared_except_id = {NOT_EXCEPTIONAL}"
    listed = t["nibrs_cleared_except"].select("cleared_except_id", F.lit(True).alias("listed"))
    sums = [
        F.sum("offenses").alias("offense_count"),
        count_where(f"{plain} AND arrests > 0").alias("clearances_normal"),
        count_where(plain, "arrests").alias("arrests"),
        *[
            count_where(f"cleared_except_id = {code} AND listed", "offenses").alias(name)
            for code, name in EXCEPTIONS.items()
        ],
    ]
    return (
        incident_clearances(t, *also)
        .join(listed, "cleared_except_id", "left")
        .groupBy(*also, *AGENCY_KEY, "offense_name")
        .agg(*sums)
    )


def placed_clearances(
    totals: DataFrame, t: Tables, place: tuple[str, ...] = ("county_name",), by_year: bool = False
) -> DataFrame:
    """The counts of ``agency_clearances``, wherever they come from, per place and offense.

    Groups whose place or offense has no name keep their offenses but show no clearances, because the views match
    them by name.
    """
    keys = [*place, *(["data_year"] if by_year else []), "offense_name"]
    named = " AND ".join(f"{key} IS NOT NULL" for key in keys)
    summed = ["offense_count", "clearances_normal", "arrests", *REASONS]
    placed = (
        totals.join(agencies(t, *place), AGENCY_KEY)
        .groupBy(*keys)
        .agg(*[F.sum(name).alias(name) for name in summed])
        .withColumn(TOTAL, F.expr(SUM_OF_REASONS))
    )
    shown = [f"if({named}, {name}, 0L) AS {name}" for name in COUNTS[1:]]
    return placed.selectExpr(*keys, "offense_count", *shown)


def county_clearances(
    t: Tables,
    place: tuple[str, ...] = ("county_name",),
    by_year: bool = False,
) -> DataFrame:
    """The counts of ``county_clearances_by_view`` in one pass over offenses and arrests.

    ``place`` names the agency columns to group by and ``by_year`` adds the year. Incidents meet the agency
    of their year.
    """
    return placed_clearances(agency_clearances(t), t, place, by_year)


def with_rates(counts: DataFrame) -> DataFrame:
    """Total clearances and the three percentages of the offenses."""
    total = f"clearances_normal + {TOTAL}"
    keys = [c for c in counts.columns if c not in COUNTS]
    return counts.select(
        *keys,
        "offense_count",
        F.expr(total).alias("clearances_total"),
        percent(total, "offense_count").alias("clearance_ratio_total_percent"),
        percent("clearances_normal", "offense_count").alias("clearance_ratio_normal_percent"),
        percent(TOTAL, "offense_count").alias("clearance_ratio_exceptional_percent"),
        "clearances_normal",
        TOTAL,
        "arrests",
        *REASONS,
    )


def county_clearance_rates(t: Tables) -> DataFrame:
    """The headline report: clearance rates per county and offense."""
    return with_rates(county_clearances(t)).orderBy(
        F.asc_nulls_last("county_name"), F.desc("clearance_ratio_total_percent"), "offense_name"
    )


def state_county_clearance_rates(t: Tables) -> DataFrame:
    """The headline report over several states, whose county names repeat."""
    return with_rates(county_clearances(t, ("state_abbr", "county_name")))


def clearance_trend(t: Tables) -> DataFrame:
    """Yearly clearance rates per county and offense and their change from the year before, null if that year is missing."""
    rate = F.col("clearance_ratio_total_percent")
    years = Window.partitionBy("county_name", "offense_name").orderBy("data_year")
    follows = F.lag("data_year").over(years) == F.col("data_year") - 1
    earlier = F.when(follows, F.lag("clearance_ratio_total_percent").over(years))
    return (
        with_rates(county_clearances(t, by_year=True))
        .select("county_name", "offense_name", "data_year", "offense_count", "clearances_total", rate)
        .withColumn("percent_change", rate - earlier)
    )


def taxonomy_clearance_rates(t: Tables, taxonomy: DataFrame) -> DataFrame:
    """Clearance rates for own categories; ``taxonomy`` maps offense_name to category."""
    rolled = (
        county_clearances(t)
        .join(taxonomy.select("offense_name", "category"), "offense_name")
        .groupBy("county_name", "category")
        .agg(*[F.sum(name).alias(name) for name in COUNTS])
    )
    return with_rates(rolled)


def normal_clearance_report(t: Tables) -> DataFrame:
    """Clearances by arrest only, best ratio first."""
    return (
        county_clearances(t)
        .select(
            "offense_name",
            "county_name",
            "offense_count",
            F.col("clearances_normal").alias("cleared_normally_count"),
            "arrests",
            F.coalesce(percent("clearances_normal", "offense_count"), F.lit(0)).alias("solved_crime_ratio"),
        )
        .orderBy(F.desc_nulls_first("solved_crime_ratio"), "county_name", "offense_name")
    )


def total_arrests(t: Tables) -> DataFrame:
    """Arrests over the whole normal clearance report."""
    return county_clearances(t).agg(F.sum("arrests").alias("total_arrests"))
