from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from civicspan.session import local_session  # noqa: E402
from micro import micro_tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="8", memory="6g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def micro(spark):
    return micro_tables(spark)


@pytest.fixture(scope="session")
def sf_dir():
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    if not os.path.isdir(folder):
        pytest.skip(f"no test data in {folder}")
    return folder
