"""Physical plans on stored raw tables: pruned scans, pushed filters, no pair joins."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tallyscope.functions import groups
from tallyscope.functions.scalars import in_window
from tallyscope.operators import features, labels, staging
from tallyscope.plans.catalogue import scratch
from tallyscope.sources import sinks
from tallyscope.sources.views import AS_OF, Views, book

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def stored(spark):
    v = Views(spark, SMALL)
    return {
        "tx": sinks.load_raw(v.tx, "raw_transactions", scratch(spark, "plan-tx")),
        "ci": sinks.load_raw(v.ci, "raw_contract_interactions", scratch(spark, "plan-ci")),
    }


def test_window_reaches_the_scan(stored):
    text = plan(stored["tx"].where(in_window(F.col("block_timestamp"), AS_OF, 10)).select("hash"))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(block_timestamp", text)
    assert "ReadSchema: struct<hash:string,block_timestamp:timestamp>" in text


def test_sums_read_only_their_columns(stored):
    text = plan(staging.account_totals(stored["tx"]))
    assert "ReadSchema: struct<block_timestamp:timestamp,from_address:string,to_address:string,value_eth:double>" in text


def test_category_counts_read_only_addresses(stored):
    text = plan(labels.call_stats(stored["ci"], book("c")))
    assert "ReadSchema: struct<from_address:string,to_address:string>" in text


def test_top_k_is_cut_before_the_shuffle(spark):
    text = plan(contract.queries()["c2_top_contracts"](spark, SMALL))
    assert "WindowGroupLimit" in text and "Partial" in text


@pytest.mark.parametrize("name", ["f13_all_features", "m5_behavioural_features", "m6_feature_mart", "l8_label_table", "v8_exemplars", "v10_calinski_harabasz", "d5_class_report"])
def test_no_pair_joins_and_no_python(spark, name):
    text = plan(contract.queries()[name](spark, SMALL))
    assert not re.search(r"CartesianProduct|NestedLoopJoin|Python", text)


def test_known_contracts_are_counted_before_the_lookup(spark):
    text = plan(contract.queries()["r2_top_unknown_contracts"](spark, SMALL)).split("Physical Plan")[1]
    assert text.index("Join") < text.index("HashAggregate(keys=[to_address")


def exchanges(df):
    return re.findall(r"Exchange (\w+)\(([^)]*)\)", plan(df).split("Physical Plan")[1])


@pytest.mark.parametrize("feature", [lambda v: features.value_velocity(v.led), lambda v: features.holding_duration(v.led_tt)])
def test_ordered_features_move_rows_once(spark, monkeypatch, feature):
    v = Views(spark, SMALL)
    hashed = [keys for kind, keys in exchanges(feature(v)) if kind != "HashedRelationBroadcastMode"]
    # Without a hot account all steps share the partitioning by account.
    assert not any(groups.CHUNK in keys for keys in hashed) and len(hashed) <= 2
    monkeypatch.setattr(groups, "CHUNK_ROWS", 2)
    found = exchanges(feature(v))
    assert not any("range" in kind for kind, _ in found)
    # Rows once, by account and chunk; the others are of summaries by account.
    assert [kind for kind, keys in found if groups.CHUNK in keys] == ["hashpartitioning"]


@pytest.mark.parametrize("feature", [lambda v: features.value_velocity(v.led), lambda v: features.holding_duration(v.led_tt)])
def test_chunks_of_hot_accounts_change_nothing(spark, monkeypatch, feature):
    v = Views(spark, SMALL)
    whole = {tuple(r) for r in feature(v).select("wallet_address", F.round(feature(v).columns[1], 6)).collect()}
    monkeypatch.setattr(groups, "CHUNK_ROWS", 3)
    assert {tuple(r) for r in feature(v).select("wallet_address", F.round(feature(v).columns[1], 6)).collect()} == whole


def test_large_sides_are_repeated_for_heavy_keys_only(spark):
    side = spark.range(500).select(F.concat(F.lit("k"), F.col("id")).alias("k"), F.col("id").alias("x"))
    even = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id") % 700).alias("k"), F.col("id").alias("i"))
    hot = even.withColumn("k", F.when(F.col("i") % 3 > 0, "k1").otherwise(F.col("k")))
    plain = groups.attach(even, side, "k", limit=0)
    salted = groups.attach(hot, side, "k", limit=0)
    assert "Generate" not in plan(plain) and "Generate" in plan(salted)
    for df, out in ((even, plain), (hot, salted)):
        assert out.exceptAll(df.join(side, "k", "left")).count() == 0 and out.count() == 20_000
    repeated = plan(groups.attach(hot, side, "k", limit=0).where("i < 0"))
    assert "_heavy" in repeated
