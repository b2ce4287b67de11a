"""Every registered query agrees with its SQL, and the flagship runs."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, compare

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    made = duckdb.connect()
    for table in TABLES:
        made.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return made


@pytest.mark.parametrize("name", list(queries()))
def test_query_agrees(spark, connection, name):
    good, note = compare(spark, connection, FOLDER, name)
    assert good, note


def test_flagship(spark):
    made = entry(spark)
    assert made.columns == ["dataset_id", "unit", "window_end", "lifetime", "rul", "severity"]
    assert made.count() > 0


def test_every_oracle_has_its_query():
    assert set(oracle_sql()) <= set(queries())
