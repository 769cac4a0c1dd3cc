"""The driver's correctness gate, run locally: every registered query with an
oracle SQL must equal DuckDB on sf0.01; every other query must run."""

import duckdb
import pytest

from tests.oracle_check import compare
from kairos.sources.tables import DRIVER_TABLES

from tests.conftest import SF01


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return c


def _names():
    import __spark_entry__ as e
    return list(e.queries())


@pytest.mark.parametrize("name", _names())
def test_query_vs_oracle(spark, con, name):
    import __spark_entry__ as e
    msg = compare(spark, con, SF01, name, e.queries()[name], e.oracle_sql().get(name))
    assert (" OK " in msg) or ("rows-only" in msg), msg
    assert " n=0 " not in f"{msg} ", msg


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() == 4 and df.columns == ["intervention", "variable", "mean", "sd"]
