"""Joins and groupings that several jobs share.

No side carries a broadcast hint. Spark broadcasts a code table by itself when its size, as
estimated or as measured at run time, is under ``spark.sql.autoBroadcastJoinThreshold``, and
falls back to a sort-merge join with skew splitting when it is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decode(fact: DataFrame, codes: DataFrame, key: str, columns: list[str], how: str = "left") -> DataFrame:
    """Attach the named columns of a code table; ``how="inner"`` drops unknown codes."""
    return fact.join(codes.select(key, *columns), key, how)


def absent_from(rows: DataFrame, others: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys do not occur in ``others``. The keys must be filled on both sides."""
    return rows.join(others.select(*keys).distinct(), list(keys), "left_anti")


def joined_text(text: str, times: str, order: str, separator: str) -> Column:
    """Ordered text aggregate over pre-counted values: each value appears ``times`` times.

    Missing values are left out, as they are from any text aggregate.
    """
    repeated = f"array_join(array_repeat({text}, cast({times} as int)), '{separator}')"
    return F.expr(
        f"listagg(CASE WHEN {text} IS NOT NULL THEN {repeated} END, '{separator}') within group (order by {order})"
    )


def share_of_total(counts: DataFrame, count: str, share: str) -> DataFrame:
    """Each row's part of the column total. Meant for grouped results of few rows."""
    total = F.sum(count).over(Window.partitionBy())
    return counts.withColumn(share, F.col(count).cast("double") / total)
