"""Comma-separated drops of the declared tables: read, write, compare headers, append by year."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from civicspan.functions.text import drop_padding, recode_age, try_recode_age
from civicspan.sources.buckets import save_bucketed
from civicspan.sources.datasets import Tables
from civicspan.sources.schema import REGISTRY, Table

# Columns whose files carry codes in place of numbers. Other tables keep the codes as text.
RECODED = {("nibrs_victim", "age_num")}


def csv_options(encoding: str = "UTF-8", multi_line: bool = False) -> dict:
    """Columns bind by position, an unquoted empty field is NULL and a quoted one is empty text.

    A row that does not fit its types stops the job. Encodings outside Spark's own list need
    ``spark.sql.legacy.javaCharsets``. Files with line breaks inside quotes need
    ``multi_line``, at the price that Spark cannot split them.
    """
    return {
        "header": True,
        "enforceSchema": True,
        "mode": "FAILFAST",
        "escape": '"',
        "nullValue": "\\N",
        "emptyValue": "",
        "encoding": encoding,
        "multiLine": multi_line,
    }


#: Names the folders of a state's rows in loaded tables; it is no column of theirs.
STATE_FOLDER = "drop_state"


def file_schema(table: Table) -> StructType:
    """The declared schema, with the recoded columns still as text."""
    return StructType(
        [
            StructField(f.name, StringType() if (table.name, f.name) in RECODED else f.dataType)
            for f in table.schema
        ]
    )


def clean(rows: DataFrame, table: Table) -> DataFrame:
    """Recode ages, drop blank padding and attach the declared comments and lengths."""
    padded = set(table.padded())

    def column(field: StructField) -> F.Column:
        value = F.col(field.name)
        if (table.name, field.name) in RECODED:
            value = recode_age(value)
        elif field.name in padded:
            value = drop_padding(value)
        return value.alias(field.name, metadata=field.metadata)

    return rows.select([column(field) for field in table.schema])


def any_case(file_name: str) -> str:
    """A glob for the name in any mix of cases; drops are not consistent about it."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in file_name)


def read_table(
    spark: SparkSession, name: str, path: str, encoding: str = "UTF-8", multi_line: bool = False
) -> DataFrame:
    """One declared table from its file, folder of part files, or glob."""
    table = REGISTRY[name]
    rows = spark.read.schema(file_schema(table)).csv(path, **csv_options(encoding, multi_line))
    return clean(rows, table)


def read_table_with_rejects(
    spark: SparkSession, name: str, path: str, encoding: str = "UTF-8", multi_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The table's rows, and as ``file, line, reason`` the lines that are none.

    A line is rejected if a value doesn't fit its type or if it has another number of fields, and then all of it is. Of rows with an
    age that is neither a number nor a known code the line is written anew from its fields. Every line is in one of the two results.
    """
    table = REGISTRY[name]
    raw = "rejected line"
    options = {**csv_options(encoding, multi_line), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": raw}
    rows = spark.read.schema(file_schema(table).add(raw, StringType())).options(**options).csv(path)
    rows = rows.withColumn("file", F.col("_metadata.file_path"))
    bad_age = F.lit(False)
    for column in table.columns:
        if (name, column) in RECODED:
            bad_age = bad_age | (F.col(column).isNotNull() & try_recode_age(F.col(column)).isNull())
    fields = F.to_csv(F.struct(*table.columns), {"emptyValue": '""', "nullValue": ""})
    reason = F.when(F.col(raw).isNotNull(), "type or number of fields").when(bad_age, "age")
    # Always true, but Spark doesn't know: so every field is parsed, and found wrong, whichever columns a job uses.
    whole = F.pmod(F.xxhash64(*table.columns), F.lit(1)) == 0
    judged = rows.filter(whole).withColumn("reason", reason)
    good = clean(judged.filter("reason IS NULL"), table)
    bad = judged.filter("reason IS NOT NULL").select("file", F.coalesce(F.col(raw), fields).alias("line"), "reason")
    return good, bad


def read_drop(spark: SparkSession, folder: str, encodings: dict[str, str] | None = None) -> Tables:
    """All declared tables of one download folder; a glob such as ``drops/*`` reads them all."""
    encodings = encodings or {}

    def reader(name: str):
        path = f"{folder}/{any_case(name + '.csv')}"
        return lambda: read_table(spark, name, path, encodings.get(name, "UTF-8"))

    return Tables({name: reader(name) for name in REGISTRY})


def write_table(rows: DataFrame, path: str, folders: tuple[str, ...] = (), encoding: str = "UTF-8") -> None:
    """Write in the form that ``read_table`` reads, telling NULL and empty text apart.

    ``folders`` names columns that become subfolders instead of file columns.
    """
    placed = rows.hint("rebalance", *folders) if folders else rows
    placed.write.partitionBy(*folders).csv(
        path,
        header=True,
        encoding=encoding,
        escape='"',
        nullValue="",
        emptyValue='""',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def _headers(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """The header of each file, as an array of names."""
    # A separator that no header holds keeps the line whole.
    lines = spark.read.schema("line string").csv(path, sep="\u0001", quote="", encoding=encoding, maxCharsPerColumn=-1)
    at_start = lines.filter("_metadata.file_block_start = 0").select(
        F.col("_metadata.file_path").alias("file"), "line", F.monotonically_increasing_id().alias("at")
    )
    first = at_start.groupBy("file").agg(F.min_by("line", "at").alias("line"))
    names = F.transform(F.split("line", ","), lambda name: F.regexp_replace(name, r'^\s*"?|"?\s*$', ""))
    return first.select("file", names.alias("header"))


def header_drift(
    spark: SparkSession, name: str, path: str, encoding: str = "UTF-8", multi_line: bool = False
) -> DataFrame:
    """Positions at which a file's header differs from the declaration, with the file's rows that carry a value there.

    Each file is compared by itself, over the longer of the two: a surplus column has no declared name,
    a missing one no header name. Loading ignores header names, so this is a report and no error.
    """
    declared = REGISTRY[name].columns
    headers = _headers(spark, path, encoding)
    width = max(len(declared), headers.agg(F.max(F.size("header"))).first()[0] or 0)
    columns = [f"c{i}" for i in range(width)]
    options = {**csv_options(encoding, multi_line), "mode": "PERMISSIVE"}
    rows = spark.read.schema(", ".join(f"{c} string" for c in columns)).csv(path, **options)
    filled = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.array(*[F.count(c) for c in columns]).alias("filled")
    )
    index = F.col("position") - 1
    names = F.array(*[F.lit(column) for column in declared])
    return (
        headers.join(filled, "file", "left")
        .withColumn("position", F.explode(F.sequence(F.lit(1), F.lit(width))))
        .select(
            "file",
            "position",
            F.get(names, index).alias("declared_name"),
            F.get("header", index).alias("header_name"),
            F.coalesce(F.get("filled", index), F.lit(0)).cast("bigint").alias("filled_rows"),
        )
        .filter(~F.col("declared_name").eqNullSafe(F.col("header_name")))
    )


def _laid_out(rows: DataFrame, by: tuple[str, ...], several_years: bool) -> DataFrameWriter:
    """One download holds one year, so its tasks can write side by side without a shuffle.

    Rows of several years would leave a file per task and year; ``rebalance`` gathers small
    years in few files and lets Spark split a large one over several tasks.
    """
    return (rows.hint("rebalance", *by) if several_years else rows).write.partitionBy(*by)


def append_drop(
    rows: DataFrame, path: str, by: tuple[str, ...] = ("data_year",), several_years: bool = False
) -> None:
    """Add one drop to a Parquet table laid out by year."""
    _laid_out(rows, by, several_years).mode("append").parquet(path)


def replace_drop(
    rows: DataFrame, path: str, by: tuple[str, ...] = ("data_year",), several_years: bool = False
) -> None:
    """As ``append_drop``, but a year that is loaded again takes the place of its old rows."""
    writer = _laid_out(rows, by, several_years).mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def drop_state(drop: Tables) -> str:
    """The state whose agencies the drop holds; ``unknown`` if it has no agencies file."""
    try:
        agencies = drop["agencies"]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return "unknown"
    states = [state for (state,) in agencies.select("state_abbr").distinct().limit(2).collect()]
    if len(states) != 1 or not states[0]:
        raise ValueError("the drop's agencies are not of one state: name the state")
    return states[0]


def write_rejects(bad: DataFrame, rejects: str, name: str, drop: str) -> None:
    """Keep a drop's rejected lines of one table; loading the drop again takes their place."""
    bad.write.mode("overwrite").parquet(f"{rejects}/table_name={name}/drop={drop}")


def read_rejects(spark: SparkSession, rejects: str) -> DataFrame:
    """``file, line, reason, table_name, drop`` of all rejected lines."""
    return spark.read.schema("file string, line string, reason string, table_name string, drop string").parquet(rejects)


def load_drop(
    spark: SparkSession,
    folder: str,
    root: str,
    names: list[str] | None = None,
    encodings: dict[str, str] | None = None,
    several_years: bool = False,
    state: str | None = None,
    rejects: str | None = None,
    drop: str | None = None,
    buckets: int | None = None,
) -> None:
    """Load the tables of one download folder into Parquet folders ``root/<table>``.

    A download is of one state, by default that of its agencies. Tables with a year replace the rows of
    this state and year and keep all others; code tables are replaced whole. All files are looked for
    before anything is written. References are not checked here: run ``validation_report`` on the loaded tables.

    A value that does not fit its type stops the load, unless ``rejects`` names a folder: then lines with such values go there,
    under the table and the name of the drop (``drop``, by default the last part of ``folder``), and all others are loaded.
    With ``buckets``, tables with an incident are laid out in so many buckets of it (see ``buckets.py``).
    """
    encodings = encodings or {}
    names = list(names or REGISTRY)
    whole = read_drop(spark, folder, encodings)
    bad: dict[str, DataFrame] = {}
    if rejects:
        paths = {name: f"{folder}/{any_case(name + '.csv')}" for name in names}
        both = {name: read_table_with_rejects(spark, name, paths[name], encodings.get(name, "UTF-8")) for name in names}
        tables = {name: rows for name, (rows, _) in both.items()}
        bad = {name: lines for name, (_, lines) in both.items()}
    else:
        tables = {name: whole[name] for name in names}
    state = state or drop_state(whole)
    for name, lines in bad.items():
        write_rejects(lines, rejects, name, drop or folder.rstrip("/").rsplit("/", 1)[-1])
    placed = {
        name: rows.withColumn(STATE_FOLDER, F.lit(state)) if "data_year" in REGISTRY[name].columns else rows
        for name, rows in tables.items()
    }
    if buckets:
        save_bucketed(placed, root, buckets, (STATE_FOLDER, "data_year"))
        return
    for name, rows in placed.items():
        if STATE_FOLDER in rows.columns:
            replace_drop(rows, f"{root}/{name}", (STATE_FOLDER, "data_year"), several_years)
        else:
            rows.write.mode("overwrite").parquet(f"{root}/{name}")
