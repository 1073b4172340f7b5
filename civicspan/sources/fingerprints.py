"""Marks of input files, by which a job knows what has changed since it last ran."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def input_files(spark: SparkSession, paths: list[str], pattern: str = "*") -> DataFrame:
    """``file, length, modified`` of all files below the paths; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(paths)
    return files.select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified"))


def mark_of(*columns: str):
    """An aggregate that changes with any file's name, length or time, whatever their order is."""
    return F.concat_ws("-", F.count("*"), F.hex(F.bit_xor(F.xxhash64(*columns))))


def fingerprint(spark: SparkSession, paths: list[str], pattern: str = "*") -> str:
    return input_files(spark, paths, pattern).agg(mark_of("file", "length", "modified")).first()[0]
