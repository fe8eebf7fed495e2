"""Every registered query against its DuckDB oracle on the smallest tables."""
import pytest

import __spark_entry__ as E
from tools.check_oracle import duck, normalize, same
from tests.conftest import SF_SMALL

ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    s = QUERIES[name](spark, SF_SMALL).toPandas()
    o = con.sql(ORACLE[name]).df()
    assert sorted(s.columns) == sorted(o.columns)
    assert same(normalize(s), normalize(o)), name


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "passed" in df.columns
