"""Remove rows together with everything that depends on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from civicspan.sources.datasets import Tables, read_laid_out
from civicspan.sources.delimited import STATE_FOLDER
from civicspan.sources.schema import REFERENCES, Reference


def _parents_first(root: str, references: list[Reference]) -> list[str]:
    """Tables below the root, each after all of its parents that are below the root."""
    below = {root}
    while grown := {r.child for r in references if r.parent in below} - below:
        below |= grown
    ordered = [root]
    while len(ordered) < len(below):
        ordered += sorted(
            name
            for name in below - set(ordered)
            if all(r.parent in ordered for r in references if r.child == name and r.parent in below)
        )
    return ordered


def _links(tables: Mapping[str, DataFrame], references: list[Reference]) -> list[Reference]:
    """The cascading references between the tables."""
    return [
        r
        for r in references
        if r.cascade
        and r.child in tables
        and r.parent in tables
        and r.column in tables[r.child].columns
        and r.parent_column in tables[r.parent].columns
    ]


def _split(
    tables: Mapping[str, DataFrame], root: str, condition: Column, references: list[Reference]
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The kept and the removed rows of the root and of every table below it, parents first."""
    links = _links(tables, references)
    doomed = F.coalesce(condition, F.lit(False))
    kept = {root: tables[root].filter(~doomed)}
    removed = {root: tables[root].filter(doomed)}
    for name in _parents_first(root, links)[1:]:
        rest, gone = tables[name], []
        for link in links:
            if link.child == name and link.parent in removed:
                keys = (
                    removed[link.parent]
                    .select(F.col(link.parent_column).alias(link.column))
                    .filter(F.col(link.column).isNotNull())
                    .distinct()
                )
                gone.append(rest.join(keys, link.column, "left_semi"))
                rest = rest.join(keys, link.column, "left_anti")
        kept[name] = rest.select(tables[name].columns)
        lost = gone[0]
        for more in gone[1:]:
            lost = lost.unionByName(more)
        removed[name] = lost
    return kept, removed


def cascade_delete(
    tables: Mapping[str, DataFrame],
    root: str,
    condition: Column,
    references: list[Reference] = REFERENCES,
) -> Tables:
    """The tables without the root rows that meet the condition and without their dependents.

    Rows whose reference is NULL or already had no parent depend on nothing and stay, as a
    cascading delete leaves them.
    """
    kept, _ = _split(tables, root, condition, references)
    return Tables({**{name: tables[name] for name in tables}, **kept})


FOLDERS = {STATE_FOLDER: StringType(), "data_year": IntegerType()}
STEP = f"table string, {STATE_FOLDER} string, data_year int, rows bigint"


def _staged(spark: SparkSession, journal: str) -> list:
    """The folders that a prepared removal replaces, or nothing."""
    try:
        return spark.read.schema(STEP).json(f"{journal}/steps").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def _lost_keys(
    tables: Mapping[str, DataFrame], root: str, condition: Column, references: list[Reference], journal: str
) -> Iterator[tuple[str, DataFrame, Callable[[DataFrame], DataFrame]]]:
    """Of the root and every table below it, parents first: its name, folders and keys of the rows that it loses, and a function that
    leaves these out of some of its rows.

    What a table loses is written down in the journal once; of other rows only the references are read for it."""
    links = _links(tables, references)
    doomed = F.coalesce(condition, F.lit(False))
    keys: dict[tuple[str, str], DataFrame] = {}
    for name in _parents_first(root, links):
        gone = [(r.column, keys[r.parent, r.parent_column].withColumnRenamed(r.parent_column, r.column)) for r in links if r.child == name and name != root]
        needed = sorted({r.parent_column for r in links if r.parent == name})
        rest, parts = tables[name], [] if gone else [tables[name].filter(doomed)]
        for column, lost_parents in gone:
            parts.append(rest.join(lost_parents, column, "left_semi"))
            rest = rest.join(lost_parents, column, "left_anti")
        lost = reduce(DataFrame.unionByName, [part.select(*dict.fromkeys([*FOLDERS, *needed])) for part in parts])
        path = f"{journal}/lost/{name}"
        lost.write.mode("overwrite").parquet(path)
        lost = lost.sparkSession.read.schema(lost.schema).parquet(path)
        for column in needed:
            keys[name, column] = lost.select(column).filter(F.col(column).isNotNull()).distinct()

        def kept(rows: DataFrame, gone=gone) -> DataFrame:
            for column, lost_parents in gone:
                rows = rows.join(lost_parents, column, "left_anti")
            return rows if gone else rows.filter(~doomed)

        yield name, lost, lambda rows, kept=kept: kept(rows).select(rows.columns)


def prepare_stored_delete(
    spark: SparkSession,
    tables_at: str,
    names: list[str],
    root: str,
    condition: Column,
    journal: str,
    references: list[Reference] = REFERENCES,
) -> None:
    """Work out a cascading removal from tables laid out by state and year, and write it down in the folder ``journal``.

    Staged are the rows that stay of every folder that loses some, and last the list of these folders. The tables
    themselves are not touched yet. A journal that is complete is left as it is.
    """
    if _staged(spark, journal):
        return
    tables = {name: read_laid_out(spark, f"{tables_at}/{name}", FOLDERS) for name in names}
    steps = []
    for name, lost, without in _lost_keys(tables, root, condition, references, journal):
        touched = lost.groupBy(*FOLDERS).agg(F.count("*").alias("removed"))
        touched = touched.collect()  # folders: a state and year each
        if not touched:
            continue
        here = [(F.col(STATE_FOLDER) == F.lit(r[STATE_FOLDER])) & (F.col("data_year") == F.lit(r["data_year"])) for r in touched]
        rest = without(tables[name].filter(reduce(Column.__or__, here)))  # Spark reads these folders only
        rest.write.mode("overwrite").partitionBy(*FOLDERS).parquet(f"{journal}/rows/{name}")
        left = {}
        if any(rest.take(1)):
            staged = read_laid_out(spark, f"{journal}/rows/{name}", FOLDERS)
            left = {(r[STATE_FOLDER], r["data_year"]): r["n"] for r in staged.groupBy(*FOLDERS).agg(F.count("*").alias("n")).collect()}
        steps += [(name, r[STATE_FOLDER], r["data_year"], left.get((r[STATE_FOLDER], r["data_year"]), 0)) for r in touched]
    if steps:
        spark.createDataFrame(steps, STEP).coalesce(1).write.mode("overwrite").json(f"{journal}/steps")


def finish_stored_delete(spark: SparkSession, tables_at: str, journal: str) -> list[tuple[str, str, int, int]]:
    """Put the staged rows in place of the folders of a prepared removal; returns these with the rows that stay.

    Each folder is replaced from the journal alone, so that a run that was cut short is finished by another one. The
    folders that lose nothing are not written."""
    steps = [tuple(r) for r in _staged(spark, journal)]
    for name in dict.fromkeys(step[0] for step in steps):
        own = [step for step in steps if step[0] == name]
        if any(rows for *_, rows in own):
            staged = read_laid_out(spark, f"{journal}/rows/{name}", FOLDERS)
            writer = staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy(*FOLDERS).parquet(f"{tables_at}/{name}")
        for _, state, year, rows in own:
            if not rows:
                folder = f"{tables_at}/{name}/{STATE_FOLDER}={state}/data_year={year}"
                empty = read_laid_out(spark, f"{tables_at}/{name}", FOLDERS).drop(*FOLDERS)
                spark.createDataFrame([], empty.schema).write.mode("overwrite").parquet(folder)
    return steps
