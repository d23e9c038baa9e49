"""Inputs that the supplied tables don't hold: broken runs, bad values, unlisted names."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyscope.operators import clusters, evaluate, labels, ledger, registry
from tallyscope.sources import scans, sinks


def test_a_broken_write_is_done_again(spark, tmp_path):
    path = str(tmp_path / "once")
    spark.range(3).write.parquet(path)
    (tmp_path / "once" / "_SUCCESS").unlink()
    assert sinks.write_once(spark.range(10), path).count() == 10
    assert sinks.write_once(spark.range(99), path).count() == 10


def test_eleven_versions_keep_every_account(spark, tmp_path):
    path = str(tmp_path / "versions")
    from tallyscope.schemas import FEATURES, KEY

    for k in range(1, 12):
        row = spark.range(1).select(F.lit(f"k{k}").alias(KEY), *[F.lit(1.0).alias(c) for c in FEATURES])
        out = sinks.upsert_features(row, path, str(k))
    assert {r[0] for r in out.select(KEY).collect()} == {f"k{k}" for k in range(1, 12)}
    with pytest.raises(ValueError):
        sinks.upsert_features(row, path, "9")


def test_bad_numbers_and_times_do_not_end_a_load(spark):
    raw = spark.createDataFrame([("0x1", "99999999999999999999999", "no time")], "hash string, block_number string, block_timestamp string")
    row = scans.conform(raw, "raw_transactions").first()
    assert row.block_number == 0 and row.block_timestamp is None


def test_account_lists_may_be_written_in_capitals(spark):
    tx = spark.createDataFrame([("h", "0xab", "0xCD", 1.0)], "hash string, from_address string, to_address string, value_eth double")
    active = spark.createDataFrame([("0xAb",), ("0xCD",)], "a string")
    assert {r.wallet_address for r in ledger.explode_transactions(tx, active).collect()} == {"0xab", "0xcd"}


def test_tables_refuse_unlisted_values(spark):
    members = spark.createDataFrame([("a", 1), ("b", 1)], "wallet_address string, cluster int")
    given = spark.createDataFrame([("a", "x"), ("b", "new")], "address string, label string")
    with pytest.raises(PySparkException):
        clusters.label_crosstab(members, given, ["x"], key="wallet_address").collect()
    assert clusters.label_crosstab(members, given, ["x", "new"], key="wallet_address").count() == 1
    predictions = spark.createDataFrame([("p", "p"), ("p", "q")], "label string, predicted string")
    with pytest.raises(PySparkException):
        evaluate.confusion_matrix(predictions, ["p"]).collect()


def test_a_missing_metric_fails_the_gate(spark):
    base = spark.createDataFrame([("f1", 0.9), ("gone", 0.5)], "metric string, value double")
    now = spark.createDataFrame([("f1", 0.91)], "metric string, value double")
    assert {r.metric: r.failed for r in evaluate.regression_check(base, now).collect()} == {"f1": False, "gone": True}


def test_an_unknown_account_is_like_nothing(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id bigint, vector array<double>")
    assert clusters.similar(points, 99, 5, key="vec_id").count() == 0
    assert clusters.similar(points, 1, 5, key="vec_id").count() == 1


def test_warehouse_rules_have_no_limit_and_push_their_window(spark, tmp_path):
    rows = spark.range(21_000).select(
        F.concat(F.lit("a"), "id").alias("from_address"), F.lit("dex").alias("to_address"), F.lit("2024-01-25").cast("timestamp").alias("block_timestamp")
    )
    rows.union(rows.limit(5).withColumn("block_timestamp", F.lit("2023-01-01").cast("timestamp"))).write.parquet(str(tmp_path / "tx"))
    tx = spark.read.parquet(str(tmp_path / "tx"))
    found = labels.label_dex_heavy_transactions(tx, ["dex"], min_tx=1, as_of="2024-01-31", days=10)
    assert found.count() == 21_000 and found.where("total_tx > 1").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(block_timestamp" in plan


def test_registry_counts_add_up(spark):
    rows = spark.createDataFrame([("a", "s1"), ("b", "s1"), ("c", "s2")], "address string, source string")
    assert {tuple(r) for r in registry.counts_by_source(rows).collect()} == {("s1", 2), ("s2", 1), ("total_registry_size", 3)}


def test_trace_candidates_fold_addresses(spark):
    rows = [("0xAbC", "0xROUTER", "call", 1)] * 12 + [("0xabc", "0xrouter", "call", 1)] * 13 + [("0xEXCLUDED", "0xRouter", "call", 1)] * 30
    traces = spark.createDataFrame(rows, "from_address string, to_address string, call_type string, k int")
    found = labels.trace_candidates(traces, ["0xRouter"], excluded=["0xExcluded"])
    assert [tuple(r) for r in found.collect()] == [("0xabc", 25)]
