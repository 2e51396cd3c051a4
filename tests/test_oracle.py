"""Every query against its SQL answer."""

import pytest

import __spark_entry__ as entry
from crmkiln.plans import queries as plans
from compare import connect, oracle_table, spark_table

_TYPES = {
    "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "int": "INTEGER",
    "timestamp_ntz": "TIMESTAMP",
}
QUERIES = plans.registry()
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, connection, name):
    df = QUERIES[name](spark, sf_dir)
    assert spark_table(df) == oracle_table(connection, SQL[name])
    described = {row[0]: row[1] for row in connection.execute(f"DESCRIBE {SQL[name]}").fetchall()}
    assert {column: _TYPES[kind] for column, kind in df.dtypes} == described


def test_names():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5


def test_other_session_zone(spark, sf_dir, connection):
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        for name in ("features_deals", "features_web_analytics", "features_marketing_events"):
            assert spark_table(QUERIES[name](spark, sf_dir)) == oracle_table(connection, SQL[name])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_without_ansi(spark, sf_dir, connection):
    try:
        spark.conf.set("spark.sql.ansi.enabled", "false")
        for name in ("agg_deals_by_region", "kpi_summary", "chart_email_by_hour"):
            assert spark_table(QUERIES[name](spark, sf_dir)) == oracle_table(connection, SQL[name])
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")
