"""JSON inputs: the source manifest, census income responses and tract features.

Each reader takes either files that hold one document each (as they are downloaded) or,
with ``per_line=True``, files with one document per line, which Spark can split. Census responses and feature
collections are read in splits in both forms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST_SCHEMA = """
data_manifests ARRAY<STRUCT<name STRING, type STRING, source STRING, date_added STRING,
  last_fetched STRING, path STRING, ttl STRING, key_column STRING, description STRING,
  tags ARRAY<STRUCT<key STRING, value STRING>>>>
"""
FEATURE_SCHEMA = """
type STRING,
features ARRAY<STRUCT<type STRING, properties MAP<STRING, STRING>, geometry STRING>>
"""
TTL_MONTHS = {"annual": 12, "quarterly": 3, "monthly": 1}


def read_manifest(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """One row per data source."""
    documents = spark.read.schema(MANIFEST_SCHEMA).json(path, multiLine=not per_line, mode="FAILFAST")
    return documents.select(F.inline("data_manifests"))


def manifest_tags(manifest: DataFrame) -> DataFrame:
    """One row per source and tag; a source without tags keeps one row."""
    tags = manifest.select("*", F.explode_outer("tags").alias("tag")).drop("tags")
    return tags.withColumns({"tag_key": F.col("tag.key"), "tag_value": F.col("tag.value")}).drop("tag")


def sources_due(manifest: DataFrame, as_of: str) -> DataFrame:
    """Sources whose last fetch lies further back than their time to live allows."""
    months = F.coalesce(*[F.when(F.col("ttl") == ttl, F.lit(n)) for ttl, n in TTL_MONTHS.items()])
    due = manifest.withColumn("next_fetch", F.add_months(F.to_date("last_fetched"), months))
    return due.filter(F.col("next_fetch") < F.to_date(F.lit(as_of)))


def _count(text: F.Column, character: str) -> F.Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(character), F.lit("")))


def _outside_strings(text: F.Column, inside: bool) -> F.Column:
    """What of a text without escapes is outside its strings, if it begins ``inside`` one or not."""
    begun = F.regexp_replace(text, '(?s)^[^"]*("|$)', "") if inside else text
    return F.regexp_replace(begun, '(?s)"[^"]*("|$)', "")


@dataclass(frozen=True)
class Members:
    """What the members of an array open and close with, and how many of the other brackets are open around them."""

    opening: str
    closing: str
    other_opening: str
    other_closing: str
    others_open: int


#: The objects of an array that is itself in an object, and the rows of an array of arrays.
OBJECTS = Members("{", "}", "[", "]", 1)
ROWS = Members("[", "]", "{", "}", 0)


def _array_members(spark: SparkSession, path: str, kind: Members) -> DataFrame:
    """``file, number, text``: the JSON text of every member of the files' arrays, whole files of any size.

    A file is read in splits, cut at closing brackets; no task holds more of it than a member. Which brackets are within strings and how
    deep they are follows from what comes before, so it is added up twice: within each split, for both cases of
    whether the split begins within a string, and over the splits of each file, a row each. A piece after which one bracket
    of the members' kind is open ends a member.
    """
    pieces = spark.read.text(path, lineSep=kind.closing).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("piece"),
    )
    bare = F.regexp_replace("piece", r"(?s)\\.", "")
    # Within a split, in the order of the file.
    order = Window.partitionBy("file", "block").orderBy("at")
    before, up_to = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    counted = pieces.withColumn("bare", bare).withColumn("quotes", _count(F.col("bare"), '"'))
    counted = counted.withColumn("quotes_before", F.coalesce(F.sum("quotes").over(before), F.lit(0)))
    for start in (0, 1):
        inside = (F.col("quotes_before") + start) % 2 == 1
        outside = F.when(inside, _outside_strings(F.col("bare"), True)).otherwise(_outside_strings(F.col("bare"), False))
        closes = F.when((F.col("quotes_before") + start + F.col("quotes")) % 2 == 0, 1).otherwise(0)
        counted = counted.withColumn(f"outside{start}", outside).withColumns(
            {
                f"own{start}": _count(F.col(f"outside{start}"), kind.opening) - closes,
                f"others{start}": _count(F.col(f"outside{start}"), kind.other_opening)
                - _count(F.col(f"outside{start}"), kind.other_closing),
                f"closes{start}": closes,
            }
        )
    depths = [f"{what}{start}" for what in ("own", "others") for start in (0, 1)]
    running = counted.select(
        "file", "block", "at", "piece", "quotes", "quotes_before", "closes0", "closes1", *depths, *[F.sum(c).over(up_to).alias(f"{c}_here") for c in depths]
    )
    # Over the splits of a file.
    splits = running.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), *[F.sum(c).alias(c) for c in depths])
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("start", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    for what in ("own", "others"):
        own = F.when(F.col("start") == 1, F.col(f"{what}1")).otherwise(F.col(f"{what}0"))
        splits = splits.withColumn(f"{what}_first", F.coalesce(F.sum(own).over(earlier), F.lit(0)))
    placed = running.join(splits.select("file", "block", "start", "own_first", "others_first"), ["file", "block"])
    chosen = lambda c: F.when(F.col("start") == 1, F.col(f"{c[0]}1{c[1]}")).otherwise(F.col(f"{c[0]}0{c[1]}"))
    own = chosen(("own", "_here")) + F.col("own_first")
    others = chosen(("others", "_here")) + F.col("others_first")
    ends = (own == 1) & (others == kind.others_open) & (chosen(("closes", "")) == 1)
    placed = placed.select(
        "file",
        "block",
        "at",
        "piece",
        F.when(ends, 1).otherwise(0).alias("ends"),
        (own - chosen(("own", ""))).alias("open_before"),
        ((F.col("start") + F.col("quotes_before")) % 2 == 1).alias("inside"),
    )
    # The number of members that end before a piece, first within its split.
    placed = placed.withColumn("number", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    ended = placed.groupBy("file", "block").agg(F.sum("ends").alias("ends"))
    ended = ended.select("file", "block", F.coalesce(F.sum("ends").over(earlier), F.lit(0)).alias("number_first"))
    place = F.struct("block", "at")
    members = (
        placed.join(ended, ["file", "block"])
        .groupBy("file", (F.col("number") + F.col("number_first")).alias("number"))
        .agg(
            F.array_sort(F.collect_list(F.struct(place.alias("place"), "piece", "open_before", "inside"))).alias("pieces"),
            F.max(F.when(F.col("open_before") <= 1, place)).alias("begins"),
            F.max("ends").alias("ends"),
        )
    )
    # What other members of the collection come before is left out.
    kept = members.select("file", "number", "ends", F.filter("pieces", lambda p: p["place"] >= F.col("begins")).alias("pieces"))
    first = kept.select("file", "number", "ends", "pieces", F.get("pieces", F.lit(0)).alias("first"))
    text = F.array_join(F.transform(F.slice("pieces", F.lit(2), F.size("pieces")), lambda p: F.concat(F.lit(kind.closing), p["piece"])), "")
    # Null for what follows the last member, so that nobody parses it, wherever Spark puts the filter.
    whole = F.when(F.col("ends") == 1, F.concat(_from_member(F.col("first"), kind.opening), text, F.lit(kind.closing)))
    return first.select("file", "number", whole.alias("text")).filter("text IS NOT NULL")


def _from_member(first: F.Column, opening: str) -> F.Column:
    """A piece from the bracket on that opens a member of the array: the first one outside strings, or, at the beginning
    of a file, the second."""
    string = r'(?:[^"\\]++|\\.)*+"'
    other = rf'[^"\{opening}]*+(?:"{string}[^"\{opening}]*+)*+'
    begun = F.when(first["inside"], F.regexp_replace(first["piece"], f"(?s)^{string}", "")).otherwise(first["piece"])
    return F.regexp_replace(
        F.when(first["open_before"] == 0, F.regexp_replace(begun, rf"(?s)^{other}\{opening}", "")).otherwise(begun), f"(?s)^{other}", ""
    )


def read_acs(spark: SparkSession, path: str, columns: list[str], per_line: bool = False) -> DataFrame:
    """Rows of census responses, all as text.

    A response is an array of arrays whose first row names the columns. Columns are picked by
    those names, so responses may order them differently.
    """
    if per_line:
        whole = F.from_json("value", "array<array<string>>", {"mode": "FAILFAST"})
        parsed = spark.read.text(path).select(whole.alias("rows"))
        several = F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0)))
        rows = parsed.select(F.element_at("rows", 1).alias("header"), F.explode(several).alias("row"))
    else:
        row = F.from_json("text", "array<string>", {"mode": "FAILFAST"})
        parsed = _array_members(spark, path, ROWS).select("file", "number", row.alias("row"))
        headers = parsed.filter("number = 0").select("file", F.col("row").alias("header"))
        rows = parsed.filter("number > 0").join(headers, "file")
    return rows.select(F.map_from_arrays("header", "row").alias("row")).select([_named(name).alias(name) for name in columns])


def _named(name: str) -> F.Column:
    """A row's value of a column; a column that the response doesn't have stops the job."""
    absent = F.raise_error(F.lit(f"the response has no column {name}"))
    return F.when(F.map_contains_key("row", name), F.col("row")[name]).otherwise(absent)


def acs_from_rows(spark: SparkSession, response: list[list[str]]) -> DataFrame:
    """A response that the caller already holds as rows, header first."""
    header, *rows = response
    return spark.createDataFrame(rows, ", ".join(f"`{name}` string" for name in header))


def county_rows(rows: DataFrame, state: str, county: str) -> DataFrame:
    """Census rows of one county."""
    return rows.filter((F.col("state") == state) & (F.col("county") == county))


def read_features(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """One row per tract feature; the geometry stays JSON text."""
    if per_line:
        collections = spark.read.schema(FEATURE_SCHEMA).json(path, mode="FAILFAST")
        features = collections.select(F.inline("features"))
    else:
        kind = "type STRING, properties MAP<STRING, STRING>, geometry STRING"
        parsed = _array_members(spark, path, OBJECTS).select(F.from_json("text", kind, {"mode": "FAILFAST"}).alias("feature"))
        features = parsed.select("feature.*").filter("type = 'Feature'")
    return features.select(
        F.col("properties")["GEODESC"].alias("GEODESC"),
        F.col("properties")["CNTY2010"].alias("CNTY2010"),
        "properties",
        "geometry",
    )
