"""Yearly drops as a file stream: each file is loaded once, however often the job runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

from civicspan.sources.delimited import clean, csv_options, file_schema
from civicspan.sources.schema import REGISTRY


def load_new_drops(
    spark: SparkSession,
    table: str,
    drops: str,
    destination: str,
    checkpoint: str,
    by: tuple[str, ...] = ("data_year",),
    encoding: str = "UTF-8",
) -> None:
    """Append all files under ``drops`` that no earlier run has loaded, then stop.

    The checkpoint remembers the files and the sink commits each batch once, so a run that
    was cut short or repeated neither loses nor doubles rows.
    """
    declared = REGISTRY[table]
    arriving = spark.readStream.schema(file_schema(declared)).csv(drops, **csv_options(encoding))
    query = (
        clean(arriving, declared)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .partitionBy(*by)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(destination)
    )
    query.awaitTermination()
