"""A set of named tables, each built only when a job asks for it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from civicspan.sources.schema import REGISTRY


class Tables(Mapping[str, DataFrame]):
    """Table name to DataFrame. Values may be DataFrames or functions that return one."""

    def __init__(self, entries: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        self._entries = dict(entries)

    def __getitem__(self, name: str) -> DataFrame:
        entry = self._entries[name]
        if callable(entry):
            entry = self._entries[name] = entry()
        return entry

    def __iter__(self) -> Iterator[str]:
        return iter(self._entries)

    def __len__(self) -> int:
        return len(self._entries)

    def replace(self, **tables: DataFrame) -> "Tables":
        """The same set with some tables exchanged, e.g. for a filtered or a cleaned one."""
        return Tables({**self._entries, **tables})

    def one_year(self, year: int) -> "Tables":
        """Only the rows of one year in every table that has a year; Spark skips other folders."""

        def restricted(name: str) -> Callable[[], DataFrame]:
            def build() -> DataFrame:
                rows = self[name]
                return rows.filter(F.col("data_year") == year) if "data_year" in rows.columns else rows

            return build

        return Tables({name: restricted(name) for name in self})

    def keep(self, *names: str) -> "Tables":
        """The same set with some tables held for reuse by several jobs; lost parts are read again."""
        return self.replace(**{name: self[name].persist() for name in names})

    def create_views(self) -> None:
        """Name every table for ``spark.sql``."""
        for name in self:
            self[name].createOrReplaceTempView(name)


def parquet_tables(spark: SparkSession, root: str, names: list[str] | None = None) -> Tables:
    """The declared tables as Parquet folders ``root/<table>``, read with the declared schema."""

    def reader(name: str) -> Callable[[], DataFrame]:
        # The year is a folder name, which Spark would put last.
        schema = REGISTRY[name].schema
        return lambda: spark.read.schema(schema).parquet(f"{root}/{name}").select(schema.fieldNames())

    return Tables({name: reader(name) for name in names or REGISTRY})


def read_laid_out(spark: SparkSession, path: str, folders: Mapping[str, DataType]) -> DataFrame:
    """A Parquet table whose subfolders are named by columns, which get these types and not those that Spark would guess."""
    found = spark.read.parquet(path).schema
    fields = [f for f in found if f.name not in folders] + [StructField(name, kind) for name, kind in folders.items()]
    return spark.read.schema(StructType(fields)).parquet(path)
