"""Readers on small files written here."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from civicspan.functions.text import recode_age, tract_key
from civicspan.operators.publish import publish
from civicspan.plans import tracts
from civicspan.sources import delimited, documents
from civicspan.sources.datasets import parquet_tables
from civicspan.sources.schema import REGISTRY
from civicspan.streaming.drops import load_new_drops

VICTIM_HEADER = ",".join(REGISTRY["nibrs_victim"].columns)
OFFENSE_TYPES = '''offense_code,offense_name,crime_against,ct_flag,hc_flag,hc_code,offense_category_name,offense_group
13B,Simple Assault,Person,f ,t,  ,"",A
23H,"Larceny, ""other""",,,t,x,Larceny,A
'''


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def victim_line(victim, age, year=2021):
    values = {"data_year": year, "victim_id": victim, "incident_id": 7, "victim_type_id": 1, "age_num": age}
    return ",".join(str(values.get(column, "")) for column in REGISTRY["nibrs_victim"].columns)


def test_empty_text_null_and_padding_stay_apart(spark, tmp_path):
    path = write(tmp_path / "NIBRS_OFFENSE_TYPE.csv", OFFENSE_TYPES)
    first, second = delimited.read_table(spark, "nibrs_offense_type", path).orderBy("offense_code").collect()
    assert (first.ct_flag, first.hc_code, first.offense_category_name) == ("f", "  ", "")
    assert (second.crime_against, second.ct_flag) == (None, None)
    assert second.offense_name == 'Larceny, "other"'


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = write(tmp_path / "age.csv", 'age_id,age_code,age_name\n1,NN,"Under\n24 Hours"\n')
    table = delimited.read_table(spark, "nibrs_age", path, multi_line=True)
    assert [tuple(r) for r in table.collect()] == [(1, "NN", "Under\n24 Hours")]


def test_columns_bind_by_position_and_drift_is_reported(spark, tmp_path):
    path = write(tmp_path / "x.csv", "id,kind,code,label\n1,A,3,Argument\n2,A,,\n")
    table = delimited.read_table(spark, "nibrs_circumstances", path)
    assert table.columns == ["circumstances_id", "circumstances_type", "circumstances_code", "circumstances_name"]
    assert [tuple(r) for r in table.orderBy("circumstances_id").collect()] == [
        (1, "A", 3, "Argument"),
        (2, "A", None, None),
    ]
    drift = delimited.header_drift(spark, "nibrs_circumstances", path).drop("file")
    assert [tuple(r) for r in drift.orderBy("position").collect()] == [
        (1, "circumstances_id", "id", 2),
        (2, "circumstances_type", "kind", 2),
        (3, "circumstances_code", "code", 1),
        (4, "circumstances_name", "label", 1),
    ]
    assert delimited.header_drift(spark, "nibrs_offense_type", write(tmp_path / "y.csv", OFFENSE_TYPES)).count() == 0


def test_drift_is_judged_file_by_file(spark, tmp_path):
    columns = REGISTRY["nibrs_circumstances"].columns
    (tmp_path / "in").mkdir()
    for name, header, row in [
        ("clean", columns, "1,A,3,x"),
        ("renamed", [*columns[:3], "Étiquette"], '2,A,4,"é, y"'),
        ("surplus", [*columns, '"note"'], "3,A,5,z,kept"),
        ("short", columns[:3], "4,A,6"),
        ("empty", columns, None),
    ]:
        text = "\n".join([",".join(header), *([row] if row else [])]) + "\n"
        (tmp_path / "in" / f"{name}.csv").write_bytes(text.encode("ISO-8859-1"))
    drift = delimited.header_drift(spark, "nibrs_circumstances", str(tmp_path / "in"), encoding="ISO-8859-1")
    found = sorted((r.file.rsplit("/", 1)[1], *r[1:]) for r in drift.collect())
    assert found == [
        ("renamed.csv", 4, "circumstances_name", "Étiquette", 1),
        ("short.csv", 4, "circumstances_name", None, 0),
        ("surplus.csv", 5, None, "note", 1),
    ]


def test_coded_ages_become_numbers_only_for_victims(spark, tmp_path):
    lines = [VICTIM_HEADER, *(victim_line(i, age) for i, age in enumerate(["NS", "NN", "NB", "BB", "34", ""]))]
    path = write(tmp_path / "v.csv", "\n".join(lines) + "\n")
    table = delimited.read_table(spark, "nibrs_victim", path)
    assert table.schema["age_num"].dataType.simpleString() == "smallint"
    assert [r.age_num for r in table.orderBy("victim_id").collect()] == [-1, -2, -3, -4, 34, None]


@pytest.mark.parametrize("age", ["XX", "1.5"])
def test_other_text_in_a_number_stops_the_load(spark, age):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.createDataFrame([(age,)], "age string").select(recode_age(F.col("age"))).collect()


def test_malformed_rows_stop_the_load(spark, tmp_path):
    path = write(tmp_path / "bad.csv", "age_id,age_code,age_name\nnot a number,00,x\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|FAILED_READ_FILE"):
        delimited.read_table(spark, "nibrs_age", path).collect()


def test_other_encodings(spark, tmp_path):
    path = write(tmp_path / "bias.csv", "bias_id,c,n,d\n11,11,Привет,x\n", encoding="windows-1251")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        table = delimited.read_table(spark, "nibrs_bias_list", path, encoding="windows-1251")
        assert table.first().bias_name == "Привет"
    finally:
        spark.conf.unset("spark.sql.legacy.javaCharsets")


def test_dates_and_timestamps(spark, tmp_path):
    columns = REGISTRY["nibrs_incident"].columns
    for text in ("2021-03-04 00:00:00", "2021-03-04"):
        values = {"agency_id": 1, "incident_id": 2, "nibrs_month_id": 3, "incident_date": text, "cleared_except_id": 6}
        line = ",".join(str(values.get(c, "")) for c in columns)
        path = write(tmp_path / f"i{len(text)}.csv", ",".join(columns) + "\n" + line + "\n")
        row = delimited.read_table(spark, "nibrs_incident", path).first()
        assert row.incident_date == datetime.datetime(2021, 3, 4)


def test_load_drop_finds_files_in_any_case_and_replaces_a_year(spark, tmp_path):
    root = str(tmp_path / "loaded")
    for year, ages in ((2021, ["NS", "20"]), (2022, ["30"])):
        lines = [VICTIM_HEADER, *(victim_line(year * 10 + i, age, year) for i, age in enumerate(ages))]
        folder = tmp_path / f"drop{year}"
        write(folder / "NIBRS_victim.csv", "\n".join(lines) + "\n")
        write(folder / "NIBRS_VICTIM_TYPE.csv", "victim_type_id,c,n\n1,B,Business\n")
        for _ in range(2):
            delimited.load_drop(spark, str(folder), root, ["nibrs_victim", "nibrs_victim_type"])
    tables = parquet_tables(spark, root, ["nibrs_victim", "nibrs_victim_type"])
    assert tables["nibrs_victim"].columns == REGISTRY["nibrs_victim"].columns
    assert sorted((r.data_year, r.age_num) for r in tables["nibrs_victim"].collect()) == [
        (2021, -1),
        (2021, 20),
        (2022, 30),
    ]
    assert tables["nibrs_victim_type"].count() == 1


def agency_drop(folder, state, year, agency):
    columns = REGISTRY["agencies"].columns
    values = {"data_year": year, "agency_id": agency, "state_abbr": state}
    lines = [",".join(columns), ",".join(str(values.get(c, "")) for c in columns)]
    write(folder / "agencies.csv", "\n".join(lines) + "\n")
    write(folder / "NIBRS_victim.csv", "\n".join([VICTIM_HEADER, victim_line(agency, "20", year)]) + "\n")


def test_states_of_one_year_are_kept_side_by_side(spark, tmp_path):
    root, names = str(tmp_path / "loaded"), ["agencies", "nibrs_victim"]
    drops = [("MD", 2021, 1), ("VA", 2021, 2), ("MD", 2022, 3), ("MD", 2021, 4)]
    for i, (state, year, agency) in enumerate(drops):
        agency_drop(tmp_path / f"drop{i}", state, year, agency)
        delimited.load_drop(spark, str(tmp_path / f"drop{i}"), root, names)
    tables = parquet_tables(spark, root, names)
    loaded = sorted((r.state_abbr, r.data_year, r.agency_id) for r in tables["agencies"].collect())
    assert loaded == [("MD", 2021, 4), ("MD", 2022, 3), ("VA", 2021, 2)]
    assert tables["agencies"].columns == REGISTRY["agencies"].columns
    assert tables["nibrs_victim"].count() == 3


def test_an_incomplete_drop_writes_nothing(spark, tmp_path):
    agency_drop(tmp_path / "drop", "MD", 2021, 1)
    with pytest.raises(AnalysisException):
        delimited.load_drop(spark, str(tmp_path / "drop"), str(tmp_path / "loaded"), ["agencies", "nibrs_offense"])
    assert not (tmp_path / "loaded").exists()


def test_streamed_drops_load_each_file_once(spark, tmp_path):
    drops, loaded, progress = (str(tmp_path / name) for name in ("drops", "loaded", "progress"))

    def run():
        load_new_drops(spark, "nibrs_victim", drops, loaded, progress)
        return sorted((r.data_year, r.age_num) for r in spark.read.parquet(loaded).collect())

    write(tmp_path / "drops" / "a.csv", VICTIM_HEADER + "\n" + victim_line(1, "NS") + "\n")
    assert run() == [(2021, -1)]
    assert run() == [(2021, -1)]
    write(tmp_path / "drops" / "b.csv", VICTIM_HEADER + "\n" + victim_line(2, "9", 2022) + "\n")
    assert run() == [(2021, -1), (2022, 9)]


MANIFEST = {
    "data_manifests": [
        {"name": "crimes", "type": "relational_database", "last_fetched": "2023-04-01", "ttl": "annual",
         "tags": [{"key": "type", "value": "crime"}, {"key": "state", "value": "MD"}]},
        {"name": "income", "type": "api", "last_fetched": "2024-02-01", "ttl": "monthly", "tags": []},
        {"name": "other", "type": "api", "last_fetched": "2020-01-01", "ttl": "never", "tags": []},
    ]
}


def test_manifest_tags_and_due_sources(spark, tmp_path):
    manifest = documents.read_manifest(spark, write(tmp_path / "m.json", json.dumps(MANIFEST, indent=2)))
    tags = documents.manifest_tags(manifest).select("name", "tag_key", "tag_value")
    assert sorted(map(str, (tuple(r) for r in tags.collect()))) == sorted(
        map(str, [("crimes", "type", "crime"), ("crimes", "state", "MD"), ("income", None, None), ("other", None, None)])
    )
    assert [r.name for r in documents.sources_due(manifest, "2024-03-01").collect()] == []
    assert [r.name for r in documents.sources_due(manifest, "2024-03-02").collect()] == ["income"]
    assert {r.name for r in documents.sources_due(manifest, "2024-06-01").collect()} == {"income", "crimes"}


RESPONSE = [
    ["NAME", "DP03_0062E", "DP03_0063E", "DP03_0066E", "DP03_0067E", "state", "county", "tract"],
    ["Census Tract 7001.01, Montgomery County, Maryland", "100", "110", "20", "300", "24", "031", "700101"],
    ["Census Tract 7002, Montgomery County, Maryland", "90", "95", "10", "250", "24", "031", "700200"],
]
COLUMNS = RESPONSE[0]


def test_acs_response_to_income(spark, tmp_path):
    path = write(tmp_path / "acs.json", json.dumps(RESPONSE, indent=1))
    raw = documents.read_acs(spark, path, COLUMNS)
    assert documents.county_rows(raw, "24", "031").count() == 2
    assert documents.county_rows(raw, "24", "033").count() == 0
    income = tracts.acs_income(raw.drop("state", "county", "tract"))
    assert dict(income.dtypes) == {
        "Census Tract": "string",
        "Median Income": "bigint",
        "Mean Income": "string",
        "10th Percentile Income": "bigint",
        "90th Percentile Income": "bigint",
        "TRACT": "string",
    }
    found = income.select("TRACT", "Median Income", "Mean Income").orderBy("TRACT").collect()
    assert [tuple(r) for r in found] == [("7001.01", 100, "110"), ("7002.00", 90, "95")]


def test_acs_response_held_in_memory(spark, tmp_path):
    path = write(tmp_path / "acs.json", json.dumps(RESPONSE))
    held, landed = documents.acs_from_rows(spark, RESPONSE), documents.read_acs(spark, path, COLUMNS)
    assert held.columns == COLUMNS
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, landed.collect()))


def test_acs_columns_follow_the_header_of_each_response(spark, tmp_path):
    turned = [row[::-1] for row in RESPONSE]
    write(tmp_path / "acs" / "a.json", json.dumps(RESPONSE))
    write(tmp_path / "acs" / "b.json", json.dumps(turned))
    raw = documents.read_acs(spark, str(tmp_path / "acs"), COLUMNS)
    assert raw.count() == 4 and raw.distinct().count() == 2


def test_missing_income_stops_the_job(spark):
    names = ", ".join(f"{c} string" for c in COLUMNS[:5])
    row = spark.createDataFrame([("Census Tract 1, A, B", "1", "2", None, "3")], names)
    with pytest.raises(Exception, match="10th Percentile Income is missing"):
        tracts.acs_income(row).collect()


def test_tract_key(spark):
    names = ["Census Tract 7002, X", "Census Tract 7001.01, X, Y", "7003"]
    found = spark.createDataFrame([(n,) for n in names], "n string").select(tract_key(F.col("n")).alias("k"))
    assert [r.k for r in found.collect()] == ["7002.00", "7001.01", "7003.00"]


def feature(tract, county):
    return {
        "type": "Feature",
        "properties": {"GEODESC": tract, "CNTY2010": county, "AREA": 1.5},
        "geometry": {"type": "Point", "coordinates": [1.25, 2]},
    }


def test_features_join_income(spark, tmp_path):
    collection = {
        "type": "FeatureCollection",
        "features": [feature("7001.01", "24031"), feature("7009.00", "24031"), feature("7002.00", "24033")],
    }
    features = documents.read_features(spark, write(tmp_path / "geo.json", json.dumps(collection, indent=2)))
    county = tracts.county_tracts(features)
    assert sorted(r.TRACT for r in county.collect()) == ["7001.01", "7009.00"]
    raw = documents.read_acs(spark, write(tmp_path / "acs.json", json.dumps(RESPONSE)), COLUMNS)
    income = tracts.acs_income(raw)
    joined = tracts.tract_income(county, income)
    assert [(r.GEODESC, r["Median Income"]) for r in joined.collect()] == [("7001.01", 100)]
    layer = tracts.tract_values(county, income)
    assert sorted(((r.TRACT, r["Median Income"]) for r in layer.collect())) == [("7001.01", 100), ("7009.00", None)]
    line = json.loads(tracts.feature_lines(joined, ["Median Income"]).first().feature)
    assert line == {
        "type": "Feature",
        "properties": {"Median Income": 100},
        "geometry": {"type": "Point", "coordinates": [1.25, 2]},
    }


def test_publishing_replaces_only_the_years_at_hand(spark, tmp_path):
    path = str(tmp_path / "published")
    publish(spark.createDataFrame([(1, 2020), (2, 2021)], "n int, data_year int"), path, "first", "2024-01-01")
    publish(spark.createDataFrame([(3, 2021)], "n int, data_year int"), path, "second", "2024-02-01")
    found = spark.read.parquet(path).select("n", "data_year", "source", "retrieved").collect()
    assert sorted(tuple(r) for r in found) == [(1, 2020, "first", "2024-01-01"), (3, 2021, "second", "2024-02-01")]
