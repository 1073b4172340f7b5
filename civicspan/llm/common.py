"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from civicspan.session import fresh_path


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def let_workers_import(spark: SparkSession) -> None:
    """Python workers look for this package where the driver found it, unless the job ships it otherwise."""
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, ROOT]))


def extended(schema: StructType, columns: str) -> StructType:
    """The schema with more columns, given as in SQL."""
    return StructType([*schema.fields, *StructType.fromDDL(columns).fields])


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with blanks behind them as long as a column is called so."""
    taken = {c.lower() for c in columns}

    def free(name: str) -> str:
        while name.lower() in taken:
            name += " "
        return name

    return [free(name) for name in names]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(frame: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and still there if an executor is lost."""
    path = fresh_path(frame.sparkSession, name)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def bucketed(frame: DataFrame, name: str, column: str) -> DataFrame:
    """The rows as a table in the shared folder, bucketed so that joins on ``column`` shuffle the other side only."""
    spark = frame.sparkSession
    path = fresh_path(spark, name)
    listed = "_".join(path.rsplit("/", 1)[1].split("-"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frame.write.bucketBy(buckets, column).option("compression", "zstd").option("path", path).saveAsTable(listed)
    made = spark.table(listed)
    spark.sql(f"DROP TABLE {listed}")  # only the name: the files stay, and the plan has found them
    return made


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def text_key(text: Column) -> Column:
    """Stands for a whole text in joins; equal exactly for equal texts."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)



def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what a task makes of one stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
