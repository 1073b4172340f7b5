"""Census income by tract, joined with tract features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspan.functions.text import tract_key
from civicspan.operators.matching import match_names

# Census variables and the names they get.
INCOME_COLUMNS = {
    "DP03_0062E": "Median Income",
    "DP03_0063E": "Mean Income",
    "DP03_0066E": "10th Percentile Income",
    "DP03_0067E": "90th Percentile Income",
}
WHOLE_NUMBERS = ["Median Income", "10th Percentile Income", "90th Percentile Income"]
COUNTY = "24031"


def _whole_number(name: str) -> Column:
    """The text as a number; a missing value stops the job, as text that is no number does."""
    missing = F.raise_error(F.lit(f"{name} is missing")).cast("bigint")
    return F.coalesce(F.col(name).cast("bigint"), missing)


def acs_income(rows: DataFrame, names: dict[str, str] = INCOME_COLUMNS) -> DataFrame:
    """Income columns under their names, whole numbers cast, with the tract number as key."""
    renamed = rows.withColumn("TRACT", tract_key(F.col("NAME"))).withColumnsRenamed({"NAME": "Census Tract", **names})
    return renamed.withColumns({name: _whole_number(name) for name in WHOLE_NUMBERS})


def county_tracts(features: DataFrame, county: str = COUNTY) -> DataFrame:
    """Features of one county, keyed by tract number."""
    return features.filter(F.col("CNTY2010") == county).withColumn("TRACT", F.col("GEODESC"))


def tract_income(tracts: DataFrame, income: DataFrame) -> DataFrame:
    """Tract features with their income; tracts without income drop out."""
    return tracts.drop("TRACT").join(income, F.col("GEODESC") == income["TRACT"])


def tract_values(tracts: DataFrame, income: DataFrame, value: str = "Median Income") -> DataFrame:
    """Every tract of the map layer with its value, or NULL where there is none."""
    return tracts.select("TRACT", "geometry").join(income.select("TRACT", value), "TRACT", "left")


def local_tracts(local: DataFrame, tracts: DataFrame, place: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Local rows with the tract that their place name means, as far as one can be told from the others.

    ``tracts`` has ``Census Tract`` and ``TRACT``, such as the result of ``acs_income``; ``within`` names columns that must agree too.
    """
    return match_names(local, tracts, place, "Census Tract", "TRACT", within)


def feature_lines(joined: DataFrame, properties: list[str]) -> DataFrame:
    """One JSON feature per row, ready for ``write.text``. The geometry is placed as it is."""
    named = F.to_json(F.struct(*[F.col(name) for name in properties]), {"ignoreNullFields": "false"})
    return joined.select(
        F.concat(
            F.lit('{"type":"Feature","properties":'),
            named,
            F.lit(',"geometry":'),
            F.coalesce(F.col("geometry"), F.lit("null")),
            F.lit("}"),
        ).alias("feature")
    )
