"""The registered queries, each over one folder of order data, and their SQL counterparts."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from functools import reduce

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Column, DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql.types import DecimalType  # noqa: E402

import oracle  # noqa: E402
from civicspan.functions.text import recode_age, tract_key  # noqa: E402
from civicspan.operators import cascade, quality  # noqa: E402
from civicspan.operators.cascade import cascade_delete  # noqa: E402
from civicspan.operators.joins import decode  # noqa: E402
from civicspan.operators.publish import publish, publish_version, read_published  # noqa: E402
from civicspan.plans import clearance, community, incidents, lookups, reconcile, rollup, samples, tracts, views  # noqa: E402
from civicspan.session import fresh_path, tasks_for, written  # noqa: E402
from civicspan.sources import delimited, documents  # noqa: E402
from civicspan.sources.buckets import bucketed_tables, save_bucketed  # noqa: E402
from civicspan.sources.datasets import Tables, read_laid_out  # noqa: E402
from civicspan.sources.schema import REGISTRY  # noqa: E402
from civicspan.sources.star import ACS_GEOGRAPHY, ACS_VARIABLES, Star, star_tables  # noqa: E402
from civicspan.streaming.drops import load_new_drops  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"
ASIA_1996 = {"state": "ASIA", "year": 1996}
BRAND_9 = {**ASIA_1996, "offense_code": "Brand#9"}
Query = Callable[[SparkSession, str], DataFrame]


def plain(rows: DataFrame) -> DataFrame:
    """Exact decimals as doubles, the type the SQL counterparts return."""
    decimals = [f.name for f in rows.schema if isinstance(f.dataType, DecimalType)]
    return rows.withColumns({name: F.col(name).cast("double") for name in decimals}) if decimals else rows


def on_tables(plan: Callable[..., DataFrame], **arguments) -> Query:
    """A plan over the star tables."""
    return lambda spark, folder: plain(plan(star_tables(spark, folder), **arguments))


# Sources: each writes star data in the file format concerned and reads it back.


def _declared_incidents(spark: SparkSession, folder: str) -> DataFrame:
    """Orders in the declared incident layout, with padded, empty, blank and quoted text."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    filled = {
        "data_year": F.year("o_orderdate"),
        "agency_id": F.col("o_custkey"),
        "incident_id": key,
        "nibrs_month_id": F.expr("o_custkey * 1000 + (year(o_orderdate) - 1995) * 12 + month(o_orderdate)"),
        "submission_date": F.expr("o_orderdate + INTERVAL 45 DAYS"),
        "report_date_flag": F.when(key % 2 == 0, "R"),
        "cleared_except_id": F.when(status == "F", F.substr("o_orderpriority", F.lit(1), F.lit(1))).otherwise("6"),
        "cleared_except_date": F.when(status == "F", F.expr("o_orderdate + INTERVAL 90 MINUTES")),
        "data_home": F.lit("C"),
        "orig_format": F.lit("F"),
        "did": key * 10,
        "cargo_theft_flag": F.when(key % 3 == 0, "Y  ").when(key % 3 == 1, ""),
        "incident_date": F.col("o_orderdate"),
        "incident_hour": key % 24,
        "incident_status": F.when(key % 4 == 0, "")
        .when(key % 4 == 2, "  ")
        .when(key % 4 == 3, F.concat(F.lit('status "'), status, F.lit('", checked'))),
    }
    return Star(spark, folder).raw("orders").select(
        [filled[f.name].cast(f.dataType).alias(f.name) for f in REGISTRY["nibrs_incident"].schema]
    )


def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "incident-csv")
    delimited.write_table(_declared_incidents(spark, folder), path)
    return delimited.read_table(spark, "nibrs_incident", path)


def csv_encoding(spark: SparkSession, folder: str) -> DataFrame:
    """Text outside ASCII in files of another encoding."""
    path = fresh_path(spark, "latin-csv")
    status = F.concat(F.lit("Clôturé "), (F.col("incident_id") % 10).cast("string"))
    rows = _declared_incidents(spark, folder).withColumn("incident_status", status)
    delimited.write_table(rows, path, encoding="ISO-8859-1")
    return delimited.read_table(spark, "nibrs_incident", path, encoding="ISO-8859-1")


def header_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Clean files, and files with renamed columns, a surplus and a missing one, side by side."""
    root = fresh_path(spark, "drifted-csv")
    rows = _declared_incidents(spark, folder)
    kinds = {
        "clean": rows,
        "renamed": rows.withColumnsRenamed({"cargo_theft_flag": "cargo_flag", "incident_status": "status"}),
        "surplus": rows.withColumn("note", F.when(F.col("incident_id") % 5 == 0, "seen")),
        "short": rows.drop("did"),
    }
    for i, (kind, shaped) in enumerate(kinds.items()):
        delimited.write_table(shaped.filter(f"(incident_id div 4) % 4 = {i}"), f"{root}/{kind}")
    drift = delimited.header_drift(spark, "nibrs_incident", f"{root}/*")
    return drift.groupBy(
        F.regexp_extract("file", "/([a-z]+)/[^/]+$", 1).alias("kind"), "position", "declared_name", "header_name"
    ).agg(F.sum("filled_rows").alias("filled_rows"))


def _yearly_drops(spark: SparkSession, folder: str) -> tuple[str, list[int]]:
    """The incidents as one folder of CSV files per year, and the years."""
    drops = fresh_path(spark, "drops")
    rows = _declared_incidents(spark, folder)
    delimited.write_table(rows.withColumn("drop", F.col("data_year")), drops, folders=("drop",))
    return drops, [year for (year,) in rows.select("data_year").distinct().collect()]


def incremental_drop_load(spark: SparkSession, folder: str) -> DataFrame:
    drops, _ = _yearly_drops(spark, folder)
    loaded, checkpoint = fresh_path(spark, "loaded"), fresh_path(spark, "progress")
    for _ in range(2):  # the second run finds nothing new
        load_new_drops(spark, "nibrs_incident", f"{drops}/drop=*", loaded, checkpoint)
    return spark.read.schema(REGISTRY["nibrs_incident"].schema).parquet(loaded)


def yearly_append(spark: SparkSession, folder: str) -> DataFrame:
    drops, years = _yearly_drops(spark, folder)
    path = fresh_path(spark, "incidents-by-year")
    for year in years:
        delimited.append_drop(delimited.read_table(spark, "nibrs_incident", f"{drops}/drop={year}"), path)
    return spark.read.schema(REGISTRY["nibrs_incident"].schema).parquet(path)


def publish_summary(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "published")
    summary = clearance.with_rates(clearance.county_clearances(star_tables(spark, folder), by_year=True))
    publish(summary, path, source="orders", retrieved="2024-01-01")
    return plain(spark.read.parquet(path))


def publish_versions(spark: SparkSession, folder: str) -> DataFrame:
    """All years, then one of them again from another source; readers see both in one version."""
    path = fresh_path(spark, "versions")
    summary = clearance.with_rates(clearance.county_clearances(star_tables(spark, folder), by_year=True))
    summary = summary.withColumns({f.name: F.col(f.name).cast("double") for f in summary.schema if "percent" in f.name})
    summary = written(summary, "summary")
    publish_version(summary, path, source="orders", retrieved="2024-01-01")
    publish_version(summary.filter("data_year = 1996"), path, source="orders again", retrieved="2024-02-01")
    return read_published(spark, path)


def quarantine_load(spark: SparkSession, folder: str) -> DataFrame:
    """A file with values that fit no type and a line with too many fields; loaded and rejected lines."""
    path = fresh_path(spark, "dirty-csv")
    key = F.col("incident_id")
    incidents = _declared_incidents(spark, folder)
    dirty = incidents.select([F.col(c).cast("string").alias(c) for c in incidents.columns]).withColumns(
        {
            "data_year": F.when(key % 40 == 0, "?").otherwise(F.col("data_year")),
            "incident_date": F.when(key % 40 == 1, "soon").otherwise(F.col("incident_date")),
        }
    )
    surplus = F.when(key % 40 == 2, F.lit("surplus"))
    delimited.write_table(dirty.filter(surplus.isNull()), f"{path}/plain")
    delimited.write_table(dirty.filter(surplus.isNotNull()).withColumn("note", surplus), f"{path}/wide")
    good, bad = delimited.read_table_with_rejects(spark, "nibrs_incident", f"{path}/*")
    delimited.write_rejects(bad, f"{path}-rejects", "nibrs_incident", "drop")
    rejected = delimited.read_rejects(spark, f"{path}-rejects").select(
        F.get(F.split("line", ","), F.lit(REGISTRY["nibrs_incident"].columns.index("incident_id"))).cast("bigint").alias("incident_id"),
        F.lit(None).cast("int").alias("data_year"),
        "reason",
    )
    return good.select("incident_id", "data_year", F.lit("").alias("reason")).unionByName(rejected)


def _bucketed(plan: Callable[..., DataFrame]) -> Query:
    """A plan over facts that are laid out by incident."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        names = ["agencies", "nibrs_incident", "nibrs_offense", "nibrs_arrestee", "nibrs_offense_type", "nibrs_cleared_except"]
        star, path = star_tables(spark, folder), fresh_path(spark, "bucketed")
        buckets = max(8, tasks_for(Star(spark, folder).raw("lineitem").count()))
        save_bucketed({name: star[name] for name in names}, path, buckets=buckets)
        return plain(plan(bucketed_tables(spark, path)))

    return run


def incremental_clearances(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of all drops but the last year's, then that year's are added; the report comes from the counts alone."""
    t, root = star_tables(spark, folder), fresh_path(spark, "lake")
    store = fresh_path(spark, "counts")
    keys = t["nibrs_incident"].select(
        "incident_id", "data_year", F.concat(F.lit("S"), F.col("agency_id") % 3).alias(delimited.STATE_FOLDER)
    )
    rows = {"nibrs_incident": t["nibrs_incident"].join(keys.drop("data_year"), "incident_id")}
    rows |= {name: t[name].join(keys, "incident_id") for name in ("nibrs_offense", "nibrs_arrestee")}

    def load(condition: str) -> None:
        for name, facts in rows.items():
            known = [f for f in REGISTRY[name].schema if f.name in facts.columns]
            typed = facts.filter(condition).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in known], delimited.STATE_FOLDER)
            delimited.append_drop(typed, f"{root}/{name}", (delimited.STATE_FOLDER, "data_year"), several_years=True)

    for name in rollup.CODES:
        known = [f for f in REGISTRY[name].schema if f.name in t[name].columns]
        t[name].select([F.col(f.name).cast(f.dataType).alias(f.name) for f in known]).write.parquet(f"{root}/{name}")
    last = keys.agg(F.max("data_year")).first()[0]
    load(f"data_year < {last}")
    rollup.refresh(spark, root, store)
    load(f"data_year = {last}")
    rollup.refresh(spark, root, store)
    counts = rollup.stored_counts(spark, store)
    return plain(clearance.with_rates(clearance.placed_clearances(counts, t, by_year=True)))


def _landed(spark: SparkSession, lines: DataFrame, name: str) -> str:
    path = fresh_path(spark, name)
    lines.write.text(path)
    return path


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    path = _landed(spark, Star(spark, folder).manifest_documents(), "manifest")
    return documents.read_manifest(spark, path, per_line=True)


def manifest_tags(spark: SparkSession, folder: str) -> DataFrame:
    return documents.manifest_tags(_manifest(spark, folder))


def manifest_due(spark: SparkSession, folder: str) -> DataFrame:
    due = documents.sources_due(_manifest(spark, folder), "2024-01-01")
    return due.select("name", "source", "last_fetched", "ttl", F.date_format("next_fetch", "yyyy-MM-dd").alias("next_fetch"))


def acs_rows_parse(spark: SparkSession, folder: str) -> DataFrame:
    path = _landed(spark, Star(spark, folder).acs_documents(), "acs")
    return documents.read_acs(spark, path, ["NAME", *ACS_VARIABLES, *ACS_GEOGRAPHY], per_line=True)


def acs_whole_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each response in a file of its own, as it is downloaded."""
    path = fresh_path(spark, "acs-files")
    Star(spark, folder).acs_documents().write.option("maxRecordsPerFile", 1).text(path)
    return documents.read_acs(spark, path, ["NAME", *ACS_VARIABLES, *ACS_GEOGRAPHY])


def acs_county_rows(spark: SparkSession, folder: str) -> DataFrame:
    return documents.county_rows(acs_rows_parse(spark, folder), state="3", county="3")


def acs_tract_key(spark: SparkSession, folder: str) -> DataFrame:
    return Star(spark, folder).acs_rows().select("NAME", tract_key(F.col("NAME")).alias("TRACT"))


def acs_income(spark: SparkSession, folder: str) -> DataFrame:
    return tracts.acs_income(Star(spark, folder).acs_rows().drop(*ACS_GEOGRAPHY))


def geo_features_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = _landed(spark, Star(spark, folder).feature_documents(), "features")
    features = documents.read_features(spark, path, per_line=True)
    return features.withColumn("place", F.col("properties")["NAME"]).drop("properties")


def geo_features_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Each collection in a file of its own, with further members and line breaks, as it is downloaded."""
    path = fresh_path(spark, "feature-files")
    spread = F.regexp_replace("value", r'"features":\[', '"crs": {"type": "name", "properties": {"name": "}]{"}},\n"features" : [\n')
    lines = Star(spark, folder).feature_documents().select(F.regexp_replace(spread, r"\},\{", "},\n  {"))
    lines.write.option("maxRecordsPerFile", 1).text(path)
    features = documents.read_features(spark, path)
    return features.withColumn("place", F.col("properties")["NAME"]).drop("properties")


def _features(spark: SparkSession, folder: str) -> DataFrame:
    features = Star(spark, folder).geo_features().drop("properties")
    return features.withColumn("TRACT", F.col("GEODESC"))


def geo_county_tracts(spark: SparkSession, folder: str) -> DataFrame:
    return tracts.county_tracts(Star(spark, folder).geo_features(), "24003").drop("properties")


def tract_income_join(spark: SparkSession, folder: str) -> DataFrame:
    return tracts.tract_income(_features(spark, folder), acs_income(spark, folder))


def tract_value_layer(spark: SparkSession, folder: str) -> DataFrame:
    return tracts.tract_values(_features(spark, folder), acs_income(spark, folder))


def local_tract_match(spark: SparkSession, folder: str) -> DataFrame:
    """Order places, whose tract names are written in several ways, with the tracts that they mean."""
    star = Star(spark, folder)
    names = star.acs_rows().select(F.col("NAME").alias("name"), (F.col("tract").cast("bigint") - 7000).alias("o_custkey"))
    written_as = """CASE o_orderkey % 8 WHEN 0 THEN name WHEN 1 THEN upper(name)
        WHEN 2 THEN replace(name, 'Census', 'Cencus') WHEN 3 THEN replace(name, ', ', ' / ')
        WHEN 4 THEN replace(name, 'Census Tract', 'Tract') WHEN 5 THEN replace(name, 'Census', 'Cesnus')
        WHEN 6 THEN replace(name, 'Tract ', 'Tract 9') END"""
    local = star.raw("orders").join(names, "o_custkey").selectExpr("o_orderkey", f"{written_as} AS place")
    tracts_named = names.select(F.col("name").alias("Census Tract"), tract_key(F.col("name")).alias("TRACT"))
    return tracts.local_tracts(local, tracts_named, "place")


def tract_features_json(spark: SparkSession, folder: str) -> DataFrame:
    return tracts.feature_lines(tract_income_join(spark, folder), ["TRACT", "Median Income"])


# Checks and cleaning.


def _age_text() -> Column:
    """Ages as text, some of them coded."""
    age = F.col("l_suppkey") % 50
    codes = ["NS", "NN", "NB", "BB"]
    return F.coalesce(*[F.when(age == i, code) for i, code in enumerate(codes)], age.cast("string"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return Star(spark, folder).raw("lineitem")


def pk_violations(spark: SparkSession, folder: str) -> DataFrame:
    return quality.key_violations(_lines(spark, folder), ["l_orderkey", "l_linenumber"])


def fk_orphans(t: Tables) -> DataFrame:
    return quality.orphans(t["nibrs_arrestee"], "incident_id", t["nibrs_victim"], "incident_id")


def null_violations(t: Tables) -> DataFrame:
    arrests = t["nibrs_arrestee"].select("incident_id", "offense_code")
    offenses = t["nibrs_offense"].select("incident_id", "offense_code", "offense_id", "location_id")
    joined = arrests.join(offenses, ["incident_id", "offense_code"], "left")
    return quality.null_violations(joined, ["offense_id", "location_id", "offense_code"])


def length_violations(t: Tables) -> DataFrame:
    lengths = {"offense_name": 15, "county_name": 8, "offense_code": 5}
    return quality.length_violations(incidents.incident_offenses(t), lengths)


def type_violations(spark: SparkSession, folder: str) -> DataFrame:
    text = _lines(spark, folder).select(_age_text().alias("age_num"), "l_returnflag")
    return quality.type_violations(text, {"age_num": "smallint", "l_returnflag": "smallint"})


def domain_violations(spark: SparkSession, folder: str) -> DataFrame:
    return quality.domain_violations(_lines(spark, folder), {"l_returnflag": ["A", "N"], "l_linestatus": ["O"]})


def cardinality_violations(t: Tables) -> DataFrame:
    return quality.cardinality_violations(t["nibrs_offense"], "incident_id", 7)


def age_recode(spark: SparkSession, folder: str) -> DataFrame:
    age = recode_age(_age_text()).cast("int")
    return _lines(spark, folder).select("l_orderkey", "l_linenumber", "l_suppkey", age.alias("age_num"))


CASCADED = ["nibrs_month", "nibrs_incident", "nibrs_offense", "nibrs_arrestee", "nibrs_victim", "nibrs_victim_offense"]


def cascade_subset(t: Tables) -> DataFrame:
    return cascade_delete(t, "nibrs_month", F.col("data_year") == 1996)["nibrs_victim_offense"]


def cascade_stored(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that are left of tables laid out by state and year, after a cascading removal in place."""
    t, root, journal = star_tables(spark, folder), fresh_path(spark, "lake"), fresh_path(spark, "journal")
    drop = t["nibrs_incident"].select(
        "incident_id", "data_year", F.concat(F.lit("S"), F.col("agency_id") % 3).alias(delimited.STATE_FOLDER)
    )
    state = F.concat(F.lit("S"), F.col("agency_id") % 3).alias(delimited.STATE_FOLDER)
    rows = {name: t[name].select("*", state) for name in ("nibrs_month", "nibrs_incident")}
    rows |= {name: t[name].join(drop, "incident_id") for name in ("nibrs_offense", "nibrs_arrestee", "nibrs_victim")}
    for name, facts in rows.items():
        delimited.append_drop(facts, f"{root}/{name}", tuple(cascade.FOLDERS), several_years=True)
    of_victim = read_laid_out(spark, f"{root}/nibrs_victim", cascade.FOLDERS).select("victim_id", *cascade.FOLDERS)
    facts = t["nibrs_victim_offense"].join(of_victim, "victim_id")
    delimited.append_drop(facts, f"{root}/nibrs_victim_offense", tuple(cascade.FOLDERS), several_years=True)
    cascade.prepare_stored_delete(spark, root, CASCADED, "nibrs_month", F.col("data_year") == 1996, journal)
    cascade.finish_stored_delete(spark, root, journal)
    counts = [
        spark.read.parquet(f"{root}/{name}").agg(F.count("*").alias("kept_rows")).select(F.lit(name).alias("table_name"), "kept_rows")
        for name in CASCADED
    ]
    return reduce(DataFrame.unionByName, counts)


def cascade_counts(t: Tables) -> DataFrame:
    kept = cascade_delete(t, "nibrs_month", F.col("data_year") == 1996)
    counts = [
        kept[name].agg(F.count("*").alias("kept_rows")).select(F.lit(name).alias("table_name"), "kept_rows")
        for name in CASCADED
    ]
    result = counts[0]
    for more in counts[1:]:
        result = result.unionByName(more)
    return result


def victim_decode(t: Tables) -> DataFrame:
    victims = decode(t["nibrs_victim"], t["ref_race"], "race_id", ["race_code"])
    victims = decode(victims, t["nibrs_ethnicity"], "ethnicity_id", ["ethnicity_code"])
    return victims.select("victim_id", "incident_id", "race_code", "ethnicity_code")


def arrests_filtered(t: Tables) -> DataFrame:
    return reconcile.exceptional_with_arrest(t, multiple_indicator="M", offense_code="Brand#13")


def taxonomy_clearance(t: Tables) -> DataFrame:
    categories = t["nibrs_offense_type"].withColumnRenamed("offense_category_name", "category")
    return clearance.taxonomy_clearance_rates(t, categories)


def arrest_top_offense(t: Tables) -> DataFrame:
    rank = F.substr("offense_code", F.lit(7)).cast("int")
    return reconcile.arrest_top_offense(t, t["nibrs_offense_type"].select("offense_code", rank.alias("rank")))


def agency_coverage_chains(t: Tables) -> DataFrame:
    """Agencies in chains of up to six, each covered by the next, and in circles of two."""
    number = F.col("agency_id") % 20
    cover = F.when(number < 5, F.col("agency_id") + 1).when(number == 10, F.col("agency_id") + 1).when(number == 11, F.col("agency_id") - 1)
    chained = t["agencies"].withColumn("covered_by_legacy_ori", F.concat(F.lit("ORI"), cover))
    return community.agency_participation(t.replace(agencies=chained), months=3, chains=True)


def sql_views(t: Tables) -> DataFrame:
    """Two of the views, joined in SQL."""
    views.create_views(t)
    return t["agencies"].sparkSession.sql(
        """SELECT o.county_name, o.offense_name, o.offense_count, c.clearances_normal, c.clearances_exceptional_total
           FROM county_offenses o JOIN county_incident_clearances_all_aggregated c
             ON o.county_name = c.county_name AND o.offense_name = c.offense_name
           WHERE o.offense_name ILIKE '%brand#1%'"""
    )


def entry(spark: SparkSession) -> DataFrame:
    """Clearance rates per county and offense."""
    return queries()["county_clearance_rates"](spark, SMOKE_DIR)


def _corpus() -> tuple[dict[str, Query], dict[str, str]]:
    """The corpus queries and their SQL, if the subpackage, the pipeline and all that they need are there."""
    try:
        import corpus_pipeline
        from civicspan.llm import queries as corpus
    except ImportError:
        return {}, {}

    sql = corpus.oracle_sql()
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {**corpus.queries(), "pipeline": corpus_pipeline.run}, sql


def queries() -> dict[str, Query]:
    """Every registered query by name."""
    return {**_library(), **_corpus()[0]}


def _library() -> dict[str, Query]:
    return {
        "csv_roundtrip": csv_roundtrip,
        "csv_encoding": csv_encoding,
        "header_drift": header_drift,
        "manifest_tags": manifest_tags,
        "manifest_due": manifest_due,
        "acs_rows_parse": acs_rows_parse,
        "acs_whole_documents": acs_whole_documents,
        "acs_county_rows": acs_county_rows,
        "acs_tract_key": acs_tract_key,
        "acs_income": acs_income,
        "geo_features_scan": geo_features_scan,
        "geo_features_whole": geo_features_whole,
        "geo_county_tracts": geo_county_tracts,
        "tract_income_join": tract_income_join,
        "tract_value_layer": tract_value_layer,
        "tract_features_json": tract_features_json,
        "yearly_append": yearly_append,
        "incremental_drop_load": incremental_drop_load,
        "publish_summary": publish_summary,
        "publish_versions": publish_versions,
        "quarantine_load": quarantine_load,
        "bucketed_clearance_rates": _bucketed(clearance.county_clearance_rates),
        "bucketed_unmatched_arrests": _bucketed(reconcile.unmatched_arrests),
        "incremental_clearances": incremental_clearances,
        "local_tract_match": local_tract_match,
        "pk_violations": pk_violations,
        "fk_orphans": on_tables(fk_orphans),
        "null_violations": on_tables(null_violations),
        "length_violations": on_tables(length_violations),
        "type_violations": type_violations,
        "domain_violations": domain_violations,
        "cardinality_violations": on_tables(cardinality_violations),
        "validation_report": on_tables(quality.validation_report),
        "age_recode": age_recode,
        "cascade_subset": on_tables(cascade_subset),
        "cascade_stored": cascade_stored,
        "cascade_counts": on_tables(cascade_counts),
        "point_lookup": on_tables(lookups.rows_where, table="nibrs_arrestee", column="offense_code", value="Brand#9"),
        "code_lookup": on_tables(lookups.code_table, table="nibrs_location_type"),
        "arrests_filtered": on_tables(arrests_filtered),
        "victim_decode": on_tables(victim_decode),
        "incident_offenses": on_tables(incidents.incident_offenses),
        "incident_offenses_aggregated": on_tables(incidents.incident_offenses_aggregated),
        "incident_offenses_single": on_tables(incidents.incident_offenses_single),
        "incident_offenses_multiple": on_tables(incidents.incident_offenses_multiple),
        "county_offenses": on_tables(clearance.county_offenses),
        "county_incident_arrests": on_tables(clearance.county_incident_arrests),
        "county_arrests_agg": on_tables(clearance.county_incident_arrests_aggregated),
        "county_exceptional_agg": on_tables(clearance.county_exceptional_clearances),
        "county_clearances_all": on_tables(clearance.county_clearances_by_view),
        "county_clearance_rates": on_tables(clearance.county_clearance_rates),
        "state_county_clearance": on_tables(clearance.state_county_clearance_rates),
        "taxonomy_clearance": on_tables(taxonomy_clearance),
        "clearance_trend": on_tables(clearance.clearance_trend),
        "normal_clearance_report": on_tables(clearance.normal_clearance_report),
        "total_arrests": on_tables(clearance.total_arrests),
        "unmatched_arrests": on_tables(reconcile.unmatched_arrests),
        "unmatched_arrests_by_code": on_tables(reconcile.unmatched_arrests_by_code),
        "unmatched_arrests_by_agency_narrow": on_tables(reconcile.unmatched_arrests_by_agency, broad=False),
        "unmatched_arrests_by_agency": on_tables(reconcile.unmatched_arrests_by_agency),
        "county_offense_arrests": on_tables(
            reconcile.county_offense_arrests, county="NATION_3", offense_like="%BRAND#2%"
        ),
        "exceptional_with_arrest": on_tables(reconcile.exceptional_with_arrest),
        "exceptional_by_code": on_tables(clearance.exceptional_by_code),
        "offense_count_distribution": on_tables(incidents.offense_count_distribution),
        "offense_totals": on_tables(incidents.offense_totals),
        "distinct_clearance_codes": on_tables(lookups.first_clearance_code),
        "state_year_incidents": on_tables(samples.state_year_incidents, **ASIA_1996),
        "state_year_offense": on_tables(samples.state_year_offense, **BRAND_9),
        "victim_demographics": on_tables(samples.victim_demographics, **BRAND_9),
        "offense_locations": on_tables(samples.offense_locations, **BRAND_9),
        "agency_coverage_chains": on_tables(agency_coverage_chains),
        "arrest_survival": on_tables(community.arrest_survival, until="1998-06-30"),
        "median_time_to_arrest": on_tables(community.median_time_to_arrest, until="1998-06-30"),
        "agency_participation": on_tables(community.agency_participation, months=3),
        "cleared_without_arrest": on_tables(reconcile.cleared_without_arrest),
        "time_to_arrest": on_tables(community.time_to_arrest),
        "arrests_by_race": on_tables(
            community.arrests_by_demographic, codes="ref_race", key="race_id", column="race_code"
        ),
        "clearance_by_demographic": on_tables(
            community.clearance_by_demographic, codes="ref_race", key="race_id", column="race_code"
        ),
        "clearance_by_offender": on_tables(
            community.clearance_by_demographic, codes="ref_race", key="race_id", column="race_code", person="offender"
        ),
        "sql_views": on_tables(sql_views),
        "clearance_by_ethnicity": on_tables(
            community.clearance_by_demographic, codes="nibrs_ethnicity", key="ethnicity_id", column="ethnicity_code"
        ),
        "incidents_per_capita": on_tables(community.incidents_per_capita),
        "arrest_top_offense": on_tables(arrest_top_offense),
    }


def oracle_sql() -> dict[str, str]:
    """For each query the same result in SQL over the raw tables."""
    return {**oracle.statements(), **_corpus()[1]}
