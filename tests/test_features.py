"""Feature definitions on small literal ledgers."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyscope.operators import features, ledger
from tallyscope.schemas import FEATURES

A, B, OTHER = "0x" + "aa" * 20, "0x" + "bb" * 20, "0x" + "cc" * 20
START = datetime(2026, 1, 1)

TX = (
    "hash string, block_number long, block_timestamp timestamp, from_address string, to_address string, "
    "value_eth double, gas_price double, method_id string"
)
TT = (
    "transaction_hash string, block_timestamp timestamp, from_address string, to_address string, "
    "token_address string, raw_value double"
)


def transactions(spark, times, *, sender=A, receivers=None, values=None, gas=None, method="0x"):
    rows = [
        (f"h{i:04d}", i, t, sender, receivers[i] if receivers else OTHER, values[i] if values else 1.0,
         gas[i] if gas else 20.0, method)
        for i, t in enumerate(times)
    ]
    return spark.createDataFrame(rows, TX)


def exploded(spark, txs, *accounts):
    active = spark.createDataFrame([(a,) for a in accounts or (A,)], "wallet_address string")
    return ledger.explode_transactions(txs, active)


def rhythm(spark, times, **kw):
    return features.rhythm_features(exploded(spark, transactions(spark, times, **kw))).first()


def test_daily_activity(spark):
    row = rhythm(spark, [START + timedelta(days=d) for d in range(10)])
    assert row["tx_frequency_per_day"] == pytest.approx(10 / 9)
    assert row["activity_regularity"] == 0.0
    assert row["hour_of_day_entropy"] == 0.0
    assert row["burst_score"] == 1.0


def test_single_instant(spark):
    row = rhythm(spark, [START] * 3)
    assert row["tx_frequency_per_day"] == 3.0
    assert row["activity_regularity"] == 0.0


def test_entropy_of_all_hours(spark):
    row = rhythm(spark, [START + timedelta(hours=h) for h in range(24)])
    assert row["hour_of_day_entropy"] == pytest.approx(math.log2(24))


def test_regularity_is_sample_deviation(spark):
    row = rhythm(spark, [START, START, START, START + timedelta(days=1)])
    assert row["activity_regularity"] == pytest.approx(math.sqrt(2))


def test_weekend_ratio(spark):
    saturday = datetime(2026, 1, 3)
    assert rhythm(spark, [saturday, saturday])["weekend_vs_weekday_ratio"] == 2.0
    mixed = [saturday, saturday + timedelta(days=2), saturday + timedelta(days=3)]
    assert rhythm(spark, mixed)["weekend_vs_weekday_ratio"] == 0.5


def test_burst(spark):
    row = rhythm(spark, [START + timedelta(minutes=m) for m in range(20)] + [START + timedelta(hours=h) for h in range(1, 10)])
    assert row["burst_score"] == pytest.approx(20 / (29 / 10))


def test_gas_sensitivity(spark):
    times, gas = [], []
    for d, n in enumerate([1, 2, 3, 4]):
        times += [START + timedelta(days=d)] * n
        gas += [10.0 * n] * n
    assert rhythm(spark, times, gas=gas)["gas_price_sensitivity"] == pytest.approx(1.0)
    two = rhythm(spark, [START, START + timedelta(days=1)], gas=[1.0, 2.0])
    assert two["gas_price_sensitivity"] == 0.0
    flat = rhythm(spark, [START + timedelta(days=d) for d in range(5)], gas=[7.0] * 5)
    assert flat["gas_price_sensitivity"] == 0.0


def test_code_flag(spark):
    assert rhythm(spark, [START])["is_contract"] == 0.0
    assert rhythm(spark, [START], method="0xabcdef12")["is_contract"] == 1.0


def concentration(spark, receivers):
    txs = transactions(spark, [START] * len(receivers), receivers=receivers)
    return features.counterparty_concentration(exploded(spark, txs)).first()["counterparty_concentration"]


def test_concentration(spark):
    assert concentration(spark, [OTHER] * 5) == 1.0
    assert concentration(spark, [f"0x{i:040x}" for i in range(100)]) == pytest.approx(0.01)


def velocity(spark, moves):
    rows = [
        (f"h{i}", i, START + timedelta(hours=i), A if v < 0 else OTHER, OTHER if v < 0 else A, abs(v), 1.0, "0x")
        for i, v in enumerate(moves)
    ]
    return features.value_velocity(exploded(spark, spark.createDataFrame(rows, TX))).first()["value_velocity"]


def test_velocity(spark):
    assert velocity(spark, [10.0, -5.0, -5.0]) == pytest.approx(1.0)
    # Without an outflow all volume counts.
    assert velocity(spark, [10.0, 10.0]) == pytest.approx(1.0)
    assert velocity(spark, [-3.0, 1.0]) == pytest.approx(1.0)
    assert velocity(spark, [0.0]) == 0.0


def test_transfer_to_oneself_counts_twice_as_outflow(spark):
    rows = [("h0", 0, START, A, A, 4.0, 1.0, "0x")]
    led = exploded(spark, spark.createDataFrame(rows, TX))
    assert led.count() == 2
    assert features.value_velocity(led).first()["value_velocity"] == pytest.approx(1.0)


def holding(spark, moves):
    rows = [
        (f"h{i}", START + timedelta(hours=h), A if out else OTHER, OTHER if out else A, token, 1.0)
        for i, (h, out, token) in enumerate(moves)
    ]
    active = spark.createDataFrame([(A,)], "wallet_address string")
    led = ledger.explode_token_transfers(spark.createDataFrame(rows, TT), active)
    return features.holding_duration(led).first()["avg_holding_duration_estimate"]


def test_holding(spark):
    assert holding(spark, [(0, False, "t"), (24, True, "t")]) == pytest.approx(24.0)
    assert holding(spark, [(0, True, "t"), (5, True, "t")]) == 0.0
    # A later inflow replaces an earlier one; a second outflow closes nothing.
    assert holding(spark, [(0, False, "t"), (10, False, "t"), (12, True, "t"), (20, True, "t")]) == pytest.approx(2.0)
    # Tokens are kept apart.
    assert holding(spark, [(0, False, "t"), (1, True, "u"), (6, True, "t")]) == pytest.approx(6.0)


def test_protocol_ratios(spark):
    calls = spark.createDataFrame([(A, A, "R1"), (A, A, "r2"), (A, A, "x"), (A, A, "x")], "wallet_address string, from_address string, to_address string")
    row = features.protocol_ratios(calls, ["r1", "r2"], ["none"]).first()
    assert (row["dex_to_total_ratio"], row["lending_to_total_ratio"]) == (0.5, 0.0)


def test_all_features_of_two_accounts(spark):
    txs = transactions(spark, [START + timedelta(hours=h) for h in range(6)], receivers=[B.upper().replace("X", "x")] * 6)
    tt = spark.createDataFrame([("h0", START, OTHER, A, "t", 1.0)], TT)
    ci = spark.createDataFrame([(A, OTHER)], "from_address string, to_address string")
    active = spark.createDataFrame([(A.upper().replace("X", "x"),), (B,)], "a string").select(F.lower("a"))
    matrix = features.all_features(
        ledger.explode_transactions(txs, active),
        ledger.explode_token_transfers(tt, active),
        ledger.explode_contract_calls(ci, active),
        [OTHER],
        [],
    )
    rows = {r["wallet_address"]: r for r in matrix.collect()}
    assert matrix.columns == ["wallet_address", *FEATURES]
    assert set(rows) == {A, B}
    assert rows[A]["dex_to_total_ratio"] == 1.0 and rows[B]["dex_to_total_ratio"] == 0.0
    assert all(rows[B][c] is not None for c in FEATURES)


def test_equal_transfers_are_dropped_but_transactions_kept(spark):
    active = spark.createDataFrame([(A,)], "wallet_address string")
    tt = spark.createDataFrame([("h0", START, A, A, "t", 1.0)] * 2, TT)
    assert ledger.explode_token_transfers(tt, active).count() == 1
    txs = spark.createDataFrame([("h0", 0, START, A, OTHER, 1.0, 1.0, "0x")] * 2, TX)
    assert ledger.explode_transactions(txs, active).count() == 2


def test_impute(spark):
    df = spark.createDataFrame(
        [("a", 1.0, "x"), ("b", None, "x"), ("c", 5.0, None), ("d", float("nan"), "y")], "k string, n double, t string"
    )
    rows = {r["k"]: r for r in features.impute(df, ["n"], ["t"]).collect()}
    assert rows["b"]["n"] == 3.0 and rows["d"]["n"] == 3.0
    assert rows["c"]["t"] == "x"


def test_standardise(spark):
    df = spark.createDataFrame([(1.0, 4.0), (2.0, 4.0), (3.0, 4.0)], "x double, c double")
    rows = features.standardise(df, ["x", "c"]).collect()
    assert [r["x"] for r in rows] == [-1.0, 0.0, 1.0]
    assert [r["c"] for r in rows] == [0.0] * 3
    assert features.standardise(df, ["c"], constant=None, suffix="_z").first()["c_z"] is None


def test_min_max(spark):
    df = spark.createDataFrame([(1.0, 4.0), (2.0, 4.0), (3.0, 4.0)], "x double, c double")
    assert [tuple(r) for r in features.min_max(df, ["x", "c"]).collect()] == [(0.0, 0.0), (0.5, 0.0), (1.0, 0.0)]
