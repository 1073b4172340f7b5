"""Single-table lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspan.sources.datasets import Tables


def rows_where(t: Tables, table: str, column: str, value) -> DataFrame:
    """All columns of the rows whose column has the value."""
    return t[table].filter(F.col(column) == value)


def code_table(t: Tables, table: str) -> DataFrame:
    return t[table]


def first_clearance_code(t: Tables) -> DataFrame:
    """The first of the distinct clearance codes in use."""
    return t["nibrs_incident"].select("cleared_except_id").distinct().orderBy("cleared_except_id").limit(1)
