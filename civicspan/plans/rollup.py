"""Clearance counts that are kept per state, year, agency and offense, so that a new drop is all that has to be read.

The counts add up: any report over places and years comes from them and the agencies alone. ``refresh`` compares the files of each
state and year with those that its counts were made from, and computes the ones that differ. Counts are written before
their mark, so a run that was cut short is made up for by the next.

References stay within a drop: an incident's offenses and arrests are loaded with it.
"""

from __future__ import annotations

import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from civicspan.plans.clearance import agency_clearances
from civicspan.sources.datasets import Tables, read_laid_out
from civicspan.sources.delimited import STATE_FOLDER
from civicspan.sources.fingerprints import input_files, mark_of
from civicspan.sources.schema import REGISTRY

FACTS = ["nibrs_incident", "nibrs_offense", "nibrs_arrestee"]
CODES = ["nibrs_offense_type", "nibrs_cleared_except"]
DROP = [STATE_FOLDER, "data_year"]
MARKS = f"{STATE_FOLDER} string, data_year int, mark string, at timestamp"


def drop_files(spark: SparkSession, root: str) -> DataFrame:
    """``table, drop_state, data_year`` and the files of each folder of the facts below ``root``."""
    files = input_files(spark, [f"{root}/{name}" for name in FACTS], "*.parquet")
    part = rf"/([^/]+)/{STATE_FOLDER}=([^/]+)/data_year=([^/]+)/[^/]+$"
    names = [F.regexp_extract("file", part, i) for i in (1, 2, 3)]
    return files.select(
        names[0].alias("table"), names[1].alias(STATE_FOLDER), F.try_to_number(names[2], F.lit("9999")).cast("int").alias("data_year"),
        "file", "length", "modified",
    )


def _marks(spark: SparkSession, store: str) -> DataFrame:
    """The last mark of each drop; null for one that has gone."""
    try:
        marks = spark.read.schema(MARKS).parquet(f"{store}/marks")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        marks = spark.createDataFrame([], MARKS)
    return marks.groupBy(*DROP).agg(F.max_by("mark", "at").alias("mark"))


def changed_drops(spark: SparkSession, root: str, store: str) -> DataFrame:
    """``drop_state, data_year, mark`` of drops whose files, or whose code tables, are not those of their counts."""
    codes = input_files(spark, [f"{root}/{name}" for name in CODES], "*.parquet").agg(mark_of("file", "length", "modified")).first()[0]
    now = drop_files(spark, root).groupBy(*DROP).agg(mark_of("file", "length", "modified").alias("files"))
    now = now.select(*DROP, F.concat_ws("+", "files", F.lit(codes)).alias("now"))
    both = now.join(_marks(spark, store), DROP, "full")
    return both.filter(~F.col("now").eqNullSafe(F.col("mark"))).select(*DROP, F.col("now").alias("mark"))


def drop_tables(spark: SparkSession, root: str, drops: list[tuple[str, int]]) -> Tables:
    """The facts of these drops only, and the code tables. Only the drops' folders are listed and read."""
    there = {(r["table"], r[STATE_FOLDER], r["data_year"]) for r in drop_files(spark, root).select("table", *DROP).distinct().collect()}

    def facts(name: str) -> DataFrame:
        schema = StructType([*REGISTRY[name].schema.fields]).add(STATE_FOLDER, StringType())
        folders = [f"{root}/{name}/{STATE_FOLDER}={s}/data_year={y}" for s, y in drops if (name, s, y) in there]
        if not folders:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", f"{root}/{name}").parquet(*folders)

    codes = {name: (lambda name=name: spark.read.schema(REGISTRY[name].schema).parquet(f"{root}/{name}")) for name in CODES}
    return Tables({**{name: (lambda name=name: facts(name)) for name in FACTS}, **codes})


def drop_counts(spark: SparkSession, root: str, drops: list[tuple[str, int]]) -> DataFrame:
    return agency_clearances(drop_tables(spark, root, drops), STATE_FOLDER)


def refresh(spark: SparkSession, root: str, store: str) -> list[tuple[str, int]]:
    """Bring the counts in ``store`` up to date with the tables below ``root``; returns the drops that were read.

    A drop is a state and year, of which there are some hundreds."""
    changed = [tuple(r) for r in changed_drops(spark, root, store).collect()]
    drops = sorted((state, year) for state, year, mark in changed if mark is not None)
    if drops:
        counts = drop_counts(spark, root, drops)
        writer = counts.hint("rebalance", *DROP).write.partitionBy(*DROP).mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").parquet(f"{store}/counts")
    if changed:
        now = datetime.datetime.now()
        marks = spark.createDataFrame([(*row, now) for row in changed], MARKS)
        marks.coalesce(1).write.mode("append").parquet(f"{store}/marks")
    return drops


def stored_counts(spark: SparkSession, store: str) -> DataFrame:
    """The counts per state, agency, year and offense name of all drops that are still there."""
    live = _marks(spark, store).filter("mark IS NOT NULL").select(*DROP)
    counts = read_laid_out(spark, f"{store}/counts", {STATE_FOLDER: StringType(), "data_year": IntegerType()})
    return counts.join(live, DROP, "left_semi")
