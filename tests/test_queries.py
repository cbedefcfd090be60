"""Every query that SQL can restate must agree with it; slow model queries are checked by tools/check_oracle.py."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import compare, connect  # noqa: E402

CHECKED = [n for n in entry.oracle_sql() if n not in ("f1_quantile_regression",)]


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, root, name):
    con: duckdb.DuckDBPyConnection = connect(root)
    got = entry.queries()[name](spark, root).toArrow()
    assert compare(got, con.sql(entry.oracle_sql()[name]).to_arrow_table()) == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "mean_qs" in df.columns
