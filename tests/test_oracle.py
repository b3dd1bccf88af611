"""Every registered query with an SQL form equals its DuckDB statement (sf0.001)."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tools.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_is_registered_with_sql_or_documented():
    # the training-data operators have tests of their own
    rows_only = {k for k in set(QUERIES) - set(SQL) if not k.startswith("op") and k != "pipeline"}
    assert not rows_only
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_duckdb(spark, con, key):
    ok, msg, _, _ = compare(spark, con, SF, key, QUERIES[key], SQL[key])
    assert ok, msg


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "reconciliation_status" in df.columns


def test_exports_start_with_a_byte_order_mark(spark):
    import os
    import tempfile

    from ledgermatch.sinks import exports, store

    root = tempfile.mkdtemp(prefix="run-export-", dir="/tmp")
    df = spark.createDataFrame([("Kigali", "x"), ("=1", "y")], "place string, b string")
    version = exports._publish(spark, root, "report", {"rows": df.coalesce(1)}, {"rows": 2})
    path = store.part_path(spark, root, "report", "rows", version)
    part = next(f for f in os.listdir(path) if f.endswith(".csv"))
    with open(os.path.join(path, part), "rb") as f:
        assert f.readline() == b"\xef\xbb\xbfplace,b\n"
