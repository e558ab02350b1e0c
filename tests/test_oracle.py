"""Every registered query against its DuckDB oracle on the smallest tables."""

import os

import pytest
from compare import connect, difference

from histmetrics.demo import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

CODEGEN = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK"}
COMPILED = ("distribution", "hotspots", "line_counts", "build_coupling_edges", "link_methods", "module_scores", "parse_commit_log", "fmt_values")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLE[name]) is None


@pytest.mark.parametrize("name", COMPILED)
def test_query_compiled(spark, con, name):
    """The path that users run: the session of the tests interprets stages, these are compiled."""
    kept = {k: spark.conf.get(k) for k in CODEGEN}
    for key, value in CODEGEN.items():
        spark.conf.set(key, value)
    try:
        assert difference(QUERIES[name](spark, SF), con, ORACLE[name]) is None
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)


def test_entry(spark):
    import __spark_entry__ as contract

    assert QUERIES.keys() <= contract.queries().keys()
    assert ORACLE.keys() <= contract.oracle_sql().keys() <= contract.queries().keys()
    df = contract.entry(spark)
    assert df.columns == ["name", "current", "first", "growth"]
    assert df.count() > 0
