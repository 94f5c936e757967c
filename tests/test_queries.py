"""Every registered query of the library against its DuckDB SQL, and for determinism where there is none."""

import os

import pytest

import __spark_entry__ as entry
from quarry.plans.registry import ORACLE_SQL, QUERIES
from tools.compare import connect, differs, plain

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, con, name):
    assert differs(spark, con, name, SF) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_twice_alike(spark, name):
    one, two = (sorted(map(lambda r: repr(plain(tuple(r))), QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert one and one == two


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query", "chunk_id", "score", "rank"] and df.count() > 0
