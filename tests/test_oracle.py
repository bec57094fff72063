"""Every registered query against its DuckDB oracle (row count, columns, order-insensitive values).

The default run checks all queries at sf0.001; set SITELORE_ORACLE_SF to another folder.
"""

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import rows_of  # noqa: E402
from sitelore.plans.catalog import QUERIES  # noqa: E402
from sitelore.plans.oracle import ORACLE  # noqa: E402
from sitelore.sources.fixtures import DRIVER_TABLES  # noqa: E402

SF = os.environ.get("SITELORE_ORACLE_SF", "/root/testdata/sf0.001")
NAMES = sorted(ORACLE)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    srecs = [tuple(r) for r in df.collect()]
    rel = con.sql(entry.oracle_sql()[name])
    dcols, drecs = rel.columns, rel.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of(df.columns, srecs) == rows_of(dcols, drecs)


def test_entry_smoke(spark):
    out = entry.entry(spark)
    assert out.count() > 0
