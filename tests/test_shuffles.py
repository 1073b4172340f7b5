"""Shuffles and buckets that are fitted to the input."""

from __future__ import annotations

import pytest

from civicspan import session
from civicspan.sources.star import star_tables


@pytest.fixture
def settings(spark):
    names = [session.SHUFFLE_SETTING, session.ADVISORY_SETTING, session.SPLIT_SETTING]
    before = [spark.conf.get(name, None) for name in names]
    yield
    for name, value in zip(names, before, strict=True):
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_shuffles_grow_with_the_largest_table(spark, settings, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 10)
    spark.range(95).selectExpr("id AS l_orderkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    star_tables(spark, str(tmp_path))
    assert spark.conf.get(session.SHUFFLE_SETTING) == "10"
    assert int(spark.conf.get(session.ADVISORY_SETTING)) == session.ADVISED_BYTES


def test_enough_partitions_are_not_joined_into_large_ones(spark, settings):
    spark.conf.set(session.SHUFFLE_SETTING, "200")
    spark.conf.set(session.ADVISORY_SETTING, "64MB")
    session.fit_shuffles(spark, 10 * session.ROWS_A_TASK)
    assert (spark.conf.get(session.SHUFFLE_SETTING), spark.conf.get(session.ADVISORY_SETTING)) == ("200", str(session.ADVISED_BYTES))
    assert int(spark.conf.get(session.SPLIT_SETTING)) == session.SPLIT_BYTES


def test_settings_that_suffice_stay(spark, settings):
    spark.conf.set(session.ADVISORY_SETTING, "16m")
    before = spark.conf.get(session.SHUFFLE_SETTING)
    session.fit_shuffles(spark, 3)
    assert (spark.conf.get(session.SHUFFLE_SETTING), spark.conf.get(session.ADVISORY_SETTING)) == (before, "16m")


def test_sizes_are_read_as_spark_writes_them():
    assert [session._bytes(t) for t in ("64MB", "16m", "67108864b", "5", "1g", "2KB")] == [64 << 20, 16 << 20, 64 << 20, 5, 1 << 30, 2048]
