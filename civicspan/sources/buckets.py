"""Loaded tables laid out by incident, so that jobs that bring an incident's rows together need no shuffle.

Every table with an ``incident_id`` is written in the same number of buckets of it. A grouping or join on the incident, alone
or with other columns, then reads bucket by bucket. Tables with a year are laid out by state and year first; each
bucket is one file there. The layout is recorded next to the tables, no metastore is needed: tables are registered
for the moment in which a job's plan is made.

An incident has a documented number of rows at most, so no bucket is hot.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from civicspan.sources.datasets import Tables

BUCKET_COLUMN = "incident_id"
LAYOUT = "layout"
#: Lets tables that are bucketed by one column meet on several columns without a shuffle.
CO_PARTITION_SETTING = "spark.sql.requireAllClusterKeysForCoPartition"


def _layout(spark: SparkSession, root: str) -> dict | None:
    try:
        rows = spark.read.schema("table string, ddl string, folders array<string>, buckets int").json(f"{root}/{LAYOUT}").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return {row["table"]: row for row in rows}


def is_bucketed(spark: SparkSession, root: str) -> bool:
    return _layout(spark, root) is not None


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def _registered(spark: SparkSession, path: str, ddl: str, folders: list[str], buckets: int) -> Iterator[str]:
    """The folder as a bucketed table under a name of its own; dropping the name leaves the files.

    Folders are found by listing them, so that plans made meanwhile need the name no more."""
    name = f"bucketed_{uuid.uuid4().hex}"
    placed = f"PARTITIONED BY ({', '.join(f'`{c}`' for c in folders)})" if folders else ""
    with _setting(spark, "spark.sql.hive.manageFilesourcePartitions", "false"):
        spark.sql(
            f"CREATE TABLE {name} ({ddl}) USING parquet {placed} "
            f"CLUSTERED BY ({BUCKET_COLUMN}) SORTED BY ({BUCKET_COLUMN}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        try:
            yield name
        finally:
            spark.sql(f"DROP TABLE {name}")


def _ddl(rows: DataFrame, folders: list[str]) -> str:
    fields = [f for f in rows.schema if f.name not in folders] + [rows.schema[c] for c in folders]
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)


def replace_bucketed(rows: DataFrame, path: str, buckets: int, folders: tuple[str, ...] = ()) -> None:
    """Write the rows in place of the folders that they cover, one file for each folder and bucket."""
    spark, last = rows.sparkSession, list(folders)
    ddl = _ddl(rows, last)
    placed = rows.select([c for c in rows.columns if c not in last] + last).repartition(buckets, BUCKET_COLUMN)
    with _registered(spark, path, ddl, last, buckets) as name, _setting(spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
        placed.write.insertInto(name, overwrite=True)


def save_bucketed(
    tables: Mapping[str, DataFrame], root: str, buckets: int, folders: tuple[str, ...] = ()
) -> None:
    """Write tables below ``root``: those with an incident in buckets, others as they are.

    Tables that have all columns ``folders`` are laid out by them, and only the folders that the
    rows cover are replaced; others are replaced whole. Tables that are there already must have the same number of buckets.
    """
    spark = next(iter(tables.values())).sparkSession
    known = _layout(spark, root) or {}
    if any(row["buckets"] != buckets for row in known.values() if row["buckets"]):
        raise ValueError("the tables there have another number of buckets")
    made = {}
    for name, rows in tables.items():
        own = folders if set(folders) <= set(rows.columns) else ()
        made[name] = (name, _ddl(rows, list(own)), list(own), buckets if BUCKET_COLUMN in rows.columns else None)
        if name in known and (known[name]["ddl"], known[name]["folders"]) != made[name][1:3]:
            raise ValueError(f"{name} is there with other columns or folders")
    for name, rows in tables.items():
        own = made[name][2]
        if made[name][3]:
            replace_bucketed(rows, f"{root}/{name}", buckets, tuple(own))
        else:
            writer = rows.write.partitionBy(*own).mode("overwrite")
            writer.option("partitionOverwriteMode", "dynamic" if own else "static").parquet(f"{root}/{name}")
    new = [row for name, row in made.items() if name not in known]
    if new:
        schema = "table string, ddl string, folders array<string>, buckets int"
        spark.createDataFrame(new, schema).coalesce(1).write.mode("append").json(f"{root}/{LAYOUT}")


def bucketed_tables(spark: SparkSession, root: str) -> Tables:
    """The tables that ``save_bucketed`` wrote below ``root``.

    Sets ``spark.sql.requireAllClusterKeysForCoPartition`` to false in this session, without which Spark would
    shuffle bucketed tables to join them on the incident and a further column.
    """
    layout = _layout(spark, root)
    if layout is None:
        raise ValueError(f"no bucketed tables in {root}")
    spark.conf.set(CO_PARTITION_SETTING, "false")

    def reader(row):
        path = f"{root}/{row['table']}"

        def read() -> DataFrame:
            if row["buckets"] is None:
                return spark.read.schema(StructType.fromDDL(row["ddl"])).parquet(path)
            with _registered(spark, path, row["ddl"], row["folders"], row["buckets"]) as name:
                return spark.table(name)

        return read

    return Tables({name: reader(row) for name, row in layout.items()})
