import os

import duckdb
import pytest

import __spark_entry__ as spark_entry
from flowcascade.workload.oracle import ORACLE
from flowcascade.workload.queries import QUERIES
from tools.compare import TABLES, differences

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")

ROWS_ONLY = {"flow_prepare", "cascade_fit_score", "model_selection"}


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


def test_every_query_but_the_fits_has_sql():
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


def test_entry(spark):
    assert spark_entry.entry(spark).count() == 17


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0
    sql = ORACLE.get(name)
    if sql is not None:
        assert differences(got, db.execute(sql).df()) == ""
