"""Every catalogue query against its DuckDB twin (sf0.001), and every
rows-only query runs."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import rows_of

from places import SF_SMALL

ORACLES = E.oracle_sql()
ROWS_ONLY = sorted(set(E.queries()) - set(ORACLES))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    rel = duck.sql(ORACLES[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    drows = rel.fetchall()
    assert len(srows) == len(drows)
    assert rows_of(sdf.columns, srows) == rows_of(rel.columns, drows)


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_runs(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    assert df.count() > 0


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and df.columns == ["prediction", "n"]
    assert sum(r["n"] for r in rows) == 1000


def test_every_query_has_unique_name():
    assert len(E.queries()) >= 78


@pytest.mark.parametrize("name", ["datetime_split", "scan_csv_typed", "score_vectorised", "runlog_stage_times"])
def test_time_zone_independent(spark, duck, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        test_matches_duckdb(spark, duck, name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
