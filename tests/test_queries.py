"""Every registered query on the supplied tables, against its check SQL."""

import pytest

import __spark_entry__ as contract
from tests.compare import compare, connection

FOLDER = "/root/testdata/sf0.001"
QUERIES, CHECKS = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_equals_check(spark, con, name):
    problem, _ = compare(QUERIES[name](spark, FOLDER), con, CHECKS[name])
    assert problem == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_compare_notices_differences(spark, con):
    df = spark.range(3).selectExpr("id", "cast(id as double) as x")
    same = "SELECT CAST(id AS BIGINT) AS id, CAST(id AS DOUBLE) AS x FROM range(3) t(id)"
    assert compare(df, con, same)[0] == ""
    assert compare(df, con, same.replace("id AS DOUBLE", "id + 1 AS DOUBLE"))[0]
    assert compare(df, con, same.replace("range(3)", "range(2)"))[0]
    assert compare(df, con, same.replace("AS BIGINT", "AS INTEGER"))[0]


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[0] == "wallet_address" and len(df.columns) == 13
    assert df.count() > 0


ORDERED = [
    "f5_avg_holding_duration_estimate_py",
    "f11_value_velocity_py",
    "m1_account_sample",
    "t3_interleaved_split",
    "t4_spaced_sample",
    "t5_stratified_split",
    "t6_stratified_folds",
    "t7_subsample",
]


@pytest.mark.parametrize("name", ORDERED)
def test_ordered_queries_over_many_chunks(spark, con, name):
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        problem, _ = compare(QUERIES[name](spark, FOLDER), con, CHECKS[name])
    finally:
        spark.conf.unset(setting)
    assert problem == ""


def test_zone_of_the_session_does_not_matter(spark, con):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        problem, _ = compare(QUERIES["c4_hour_shares"](spark, FOLDER), con, CHECKS["c4_hour_shares"])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert problem == ""
