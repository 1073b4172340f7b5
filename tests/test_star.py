"""Order data as declared tables: ids stay apart however large the keys are."""

from __future__ import annotations

from civicspan.sources.star import star_tables


def test_victims_of_large_supplier_numbers_stay_apart(spark, tmp_path):
    def save(name: str, columns: str, rows: list[tuple]) -> None:
        spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / f"{name}.parquet"))

    lines = [(1, 1, 100_001), (1, 1, 100_001), (2, 1, 1), (2, 2, 4_000_000_001), (2, 1, 4_000_000_001)]
    save(
        "lineitem",
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_returnflag string",
        [(*line, "A") for line in lines],
    )
    save("part", "p_partkey bigint, p_brand string", [(1, "Brand#1"), (2, "Brand#2")])
    save("supplier", "s_suppkey bigint, s_nationkey bigint", [(s, 0) for s in {line[2] for line in lines}])
    save("nation", "n_nationkey bigint, n_regionkey bigint", [(0, 0)])
    tables = star_tables(spark, str(tmp_path))
    victims = tables["nibrs_victim"].select("victim_id", "incident_id", "age_id").collect()
    assert sorted(tuple(v) for v in victims) == [(1001, 1, 1), (2001, 2, 1), (2002, 2, 1)]
    links = tables["nibrs_victim_offense"].collect()
    assert sorted(tuple(x) for x in links) == [(1001, 101), (2001, 201), (2002, 201), (2002, 202)]
