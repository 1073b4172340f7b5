"""The stacked views under their SQL names, so that reports can also be written in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from civicspan.plans import clearance, incidents
from civicspan.sources.datasets import Tables

VIEWS: dict[str, Callable[[Tables], DataFrame]] = {
    "incident_offenses": incidents.incident_offenses,
    "incident_offenses_aggregated": incidents.incident_offenses_aggregated,
    "incident_offenses_single": incidents.incident_offenses_single,
    "incident_offenses_multiple": incidents.incident_offenses_multiple,
    "county_offenses": clearance.county_offenses,
    "county_incident_arrests": clearance.county_incident_arrests,
    "county_incident_arrests_aggregated": clearance.county_incident_arrests_aggregated,
    "county_incident_clearances_exceptional_aggregated": clearance.county_exceptional_clearances,
    "county_incident_clearances_all_aggregated": clearance.county_clearances,
}


def create_views(t: Tables) -> None:
    """Name every table and every view for ``spark.sql``. Nothing runs before a query does."""
    t.create_views()
    for name, view in VIEWS.items():
        view(t).createOrReplaceTempView(name)
