"""Write summaries for readers, by year and with their provenance."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def with_provenance(summary: DataFrame, source: str, retrieved: str) -> DataFrame:
    return summary.withColumns({"source": F.lit(source), "retrieved": F.lit(retrieved)})


def publish(
    summary: DataFrame,
    destination: str,
    source: str,
    retrieved: str,
    by: tuple[str, ...] = ("data_year",),
    file_format: str = "parquet",
) -> None:
    """Replace the published years that the summary covers; other years stay as they are.

    The destination may be a local folder or a bucket. ``rebalance`` sizes the files by their
    content instead of by the number of years.
    """
    (
        with_provenance(summary, source, retrieved)
        .hint("rebalance", *by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .format(file_format)
        .save(destination)
    )


POINTER = """version int, source string, retrieved string, inputs string, schema string, folders array<string>, replaced boolean,
parts array<struct<data: string, folder: string, rows: bigint, mark: string>>"""


def publications(spark: SparkSession, destination: str) -> DataFrame:
    """All versions with their provenance and parts: the folder of each year, its rows and a mark of their contents."""
    try:
        return spark.read.schema(POINTER).json(f"{destination}/versions/*")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], POINTER)


def _pointer(spark: SparkSession, destination: str, version: int | None = None):
    versions = publications(spark, destination)
    if version is not None:
        versions = versions.filter(F.col("version") == version)
    return versions.orderBy(F.desc("version")).limit(1).first()


def _write_pointer(pointer: DataFrame, destination: str, version: int) -> None:
    pointer.coalesce(1).write.mode("errorifexists").json(f"{destination}/versions/{version:08d}")


def publish_version(
    summary: DataFrame,
    destination: str,
    source: str,
    retrieved: str,
    inputs: str = "",
    by: tuple[str, ...] = ("data_year",),
    replace: bool = False,
) -> int:
    """Publish as one step that readers see whole or not at all; returns the version.

    Rows go to a folder that nobody reads yet. Then one small file, the version's pointer, names the folders of
    this version: the new ones, and the earlier version's for years that the summary does not cover (none with
    ``replace``). Before that file is there, readers stay with the earlier version, so a run that is cut short
    leaves them alone and can be repeated. Earlier versions stay readable. ``inputs`` is a mark of what the summary was made from.
    One job publishes to a destination at a time; a second one that finishes later fails on the version's name.
    """
    spark, data = summary.sparkSession, uuid.uuid4().hex
    path = f"{destination}/data/{data}"
    rows = with_provenance(summary, source, retrieved)
    rows.hint("rebalance", *by).write.partitionBy(*by).parquet(path)
    schema = StructType([*(f for f in rows.schema if f.name not in by), *(rows.schema[c] for c in by)])
    stored = spark.read.schema(schema).parquet(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), f"/{data}/(.*)/[^/]+$", 1)
    folder = F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))
    of_folder = stored.groupBy(folder.alias("folder")).agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*schema.names)).alias("mark"))
    parts = [(data, r["folder"], r["rows"], f"{r['mark'] & (1 << 64) - 1:016x}") for r in of_folder.collect()]
    last = _pointer(spark, destination)
    if last is not None and not replace:
        if last["folders"] != list(by) or set(StructType.fromDDL(last["schema"]).names) != set(schema.names):
            raise ValueError("the earlier version has other columns: publish with replace")
        covered = {p[1] for p in parts}
        parts += [tuple(p) for p in last["parts"] if p["folder"] not in covered]
    version = 1 + (last["version"] if last is not None else 0)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    made = spark.createDataFrame([(version, source, retrieved, inputs, ddl, list(by), replace, sorted(parts))], POINTER)
    _write_pointer(made, destination, version)
    return version


def read_published(spark: SparkSession, destination: str, version: int | None = None) -> DataFrame:
    """The rows of a version, by default the last one. Only its folders are listed."""
    pointer = _pointer(spark, destination, version)
    if pointer is None:
        raise ValueError(f"nothing is published in {destination}")
    schema = StructType.fromDDL(pointer["schema"])
    folders: dict[str, list[str]] = {}
    for part in pointer["parts"]:
        folders.setdefault(part["data"], []).append(part["folder"])
    rows = spark.createDataFrame([], schema)
    for data, names in folders.items():
        path = f"{destination}/data/{data}"
        one = spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/{name}" for name in names])
        rows = rows.unionByName(one.select(schema.names))
    return rows
