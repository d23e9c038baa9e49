"""The building blocks on skewed input, cut into many chunks, against brute force."""

import math
import random
import statistics
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyscope.functions import groups, ordered


@pytest.fixture()
def chunked(spark):
    """Keep small inputs in several partitions, as large ones are."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield spark
    spark.conf.unset(name)


def skewed(n=400, seed=1):
    """Rows of which two thirds share one key."""
    rng = random.Random(seed)
    return [
        ("hot" if rng.random() < 0.67 else f"k{rng.randrange(12)}", rng.randrange(60), i, round(rng.uniform(-9, 9), 2))
        for i in range(n)
    ]


def by_key(rows):
    grouped = {}
    for row in rows:
        grouped.setdefault(row[0], []).append(row)
    return grouped


def test_hot_key_spans_chunks(chunked):
    df = chunked.createDataFrame(skewed(), "k string, t int, i int, x double")
    chunks = groups.range_chunks(df, "k", "t", "i").where("k = 'hot'").select(groups.CHUNK).distinct().count()
    assert chunks > 2


def test_running_peak(chunked):
    rows = skewed()
    df = chunked.createDataFrame(rows, "k string, t int, i int, x double")
    found = ordered.running_peak(df, "k", ["t", "i"], F.col("x"), {"size": F.lit(1)}).collect()
    assert len(found) == len(by_key(rows))
    for row in found:
        run, peak = 0.0, 0.0
        for r in sorted(by_key(rows)[row["k"]], key=lambda r: (r[1], r[2])):
            run += r[3]
            peak = max(peak, abs(run))
        assert row["peak"] == pytest.approx(peak)
        assert row["size"] == len(by_key(rows)[row["k"]])


def test_closed_pairs(chunked):
    rows = skewed(600, 7)
    df = chunked.createDataFrame(rows, "k string, t int, i int, x double").select(
        "k", F.timestamp_seconds("t").alias("ts"), "i", (F.col("x") > 0).alias("inward")
    )
    found = ordered.closed_pairs(df, ["k"], ["ts", "i"], F.col("inward")).collect()
    for row in found:
        opened, gaps = None, []
        for r in sorted(by_key(rows)[row["k"]], key=lambda r: (r[1], r[2])):
            if r[3] > 0:
                opened = r[1]
            elif opened is not None:
                gaps.append(r[1] - opened)
                opened = None
        assert row["pairs"] == len(gaps)
        assert row["seconds"] == pytest.approx(sum(gaps))


def test_global_position(chunked):
    rows = skewed()
    df = chunked.createDataFrame(rows, "k string, t int, i int, x double")
    found = groups.global_position(df, F.col("x").desc(), F.col("i").asc()).collect()
    expected = sorted(rows, key=lambda r: (-r[3], r[2]))
    assert [r["i"] for r in sorted(found, key=lambda r: r["position"])] == [r[2] for r in expected]
    assert sorted(r["position"] for r in found) == list(range(1, len(rows) + 1))


def test_group_position_with_missing_group(chunked):
    rows = [(None if r[0] == "k3" else r[0], *r[1:]) for r in skewed()]
    df = chunked.createDataFrame(rows, "k string, t int, i int, x double")
    found = groups.group_position(df, "k", F.col("t").asc(), F.col("i").asc()).collect()
    assert len(found) == len(rows)
    for key, members in by_key(rows).items():
        mine = sorted((r for r in found if r["k"] == key), key=lambda r: r["position"])
        assert [r["i"] for r in mine] == [r[2] for r in sorted(members, key=lambda r: (r[1], r[2]))]
        assert {r["group_size"] for r in mine} == {len(members)}


@pytest.mark.parametrize("n", [1, 2, 7, 9, 10, 11])
def test_tile_equals_ntile(spark, n):
    df = spark.range(1, n + 1).select(F.col("id").alias("p"), groups.tile(F.col("id"), F.lit(n), 3).alias("tile"))
    df.createOrReplaceTempView("tiles")
    wrong = spark.sql("SELECT * FROM (SELECT tile, ntile(3) OVER (ORDER BY p) AS other FROM tiles) WHERE tile <> other")
    assert wrong.count() == 0


@pytest.mark.parametrize("limit", ["1000", "2"])
def test_top_k_beyond_the_window_limit(spark, limit):
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    spark.conf.set(name, limit)
    try:
        rows = skewed()
        df = spark.createDataFrame(rows, "k string, t int, i int, x double")
        found = groups.top_k(df, ["k"], [F.col("x").desc(), F.col("i").asc()], 5).collect()
    finally:
        spark.conf.unset(name)
    for key, members in by_key(rows).items():
        best = [r[2] for r in sorted(members, key=lambda r: (-r[3], r[2]))[:5]]
        assert [r["i"] for r in sorted(found, key=lambda r: r["rank"]) if r["k"] == key] == best


@pytest.mark.parametrize("limit", [1000, 0])
def test_key_filters_with_and_without_broadcast(spark, limit):
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, t int, i int, x double")
    keys = spark.createDataFrame([("hot",), ("k1",), ("k1",), (None,)], "k string")
    kept = {r["i"] for r in groups.keep_keys(df, keys, "k", limit=limit).collect()}
    dropped = {r["i"] for r in groups.drop_keys(df, keys, "k", limit=limit).collect()}
    flags = {r["i"]: r["f"] for r in groups.flag_keys(df, keys, "k", "f", limit=limit).collect()}
    expected = {r[2] for r in rows if r[0] in ("hot", "k1")}
    assert kept == expected
    assert dropped == {r[2] for r in rows} - expected
    assert {i for i, f in flags.items() if f} == expected and len(flags) == len(rows)


@pytest.mark.parametrize("size", [1, 2, 5, 400, 30_001])
def test_exact_median(spark, size):
    rng = random.Random(size)
    rows = [("hot" if rng.random() < 0.8 else "b", float(rng.randrange(size))) for _ in range(size)]
    df = spark.createDataFrame(rows, "k string, x double")
    grouped = {}
    for k, x in rows:
        grouped.setdefault(k, []).append(x)
    found = {r["k"]: r["median"] for r in groups.exact_median(df, ["k"], "x").collect()}
    assert found == {k: statistics.median(x) for k, x in grouped.items()}
    assert groups.exact_median(df, [], "x").first()["median"] == statistics.median([x for _, x in rows])


@pytest.mark.parametrize("parts", [2, 10])
def test_exact_tiles(chunked, parts):
    rng = random.Random(parts)
    rows = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(9)}", rng.choice((None, *range(50)))) for _ in range(3_000)]
    rows += [("one", 4), ("none", None), ("none", None)]
    df = chunked.createDataFrame([(k, None if x is None else x / 7) for k, x in rows], "k string, x double")
    found = {r["k"]: r["q"] for r in groups.exact_tiles(df, ["k"], "x", parts, "q").collect()}
    for key, members in by_key(rows).items():
        values = sorted(x / 7 for _, x in members if x is not None)
        assert found[key] == [values[-(-len(values) * i // parts) - 1] if values else None for i in range(1, parts)]
    assert len(found) == len(by_key(rows))


def test_median_of_a_hot_account(spark):
    from tallyscope.operators import staging

    # The account "a" has 60,001 values, more than a sketch of 10,000 keeps apart.
    tx = spark.range(60_001).select(
        F.lit("a").alias("from_address"), F.concat(F.lit("b"), F.col("id") % 7).alias("to_address"),
        F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("decimal(38,0)").alias("value"),
    )
    found = {r[0]: round(r[1] * 1e18) for r in staging.median_value(tx).collect()}
    members = {}
    for r in tx.collect():
        for k in (r.from_address, r.to_address):
            members.setdefault(k, []).append(int(r.value))
    assert found == {k: statistics.median_low(x) for k, x in members.items()}


def test_drift_bounds_of_a_large_baseline(spark):
    from tallyscope.operators import evaluate

    n = 2_000_003  # a prime, so the products are the numbers below it, mixed
    base = spark.range(n).select((F.col("id") * 7919 % n).cast("double").alias("x"))
    cuts = [-(-n * i // 10) - 1 for i in range(1, 10)]
    now = spark.createDataFrame([(float(c + k),) for c in cuts for k in (0, 1)], "x double")
    row = evaluate.drift_report(base, now, ["x"]).first()
    # Each value after a bound is in the next tenth.
    tenths = [((cuts + [n - 1])[k] - ([-1] + cuts)[k]) / n for k in range(10)]
    shares = [(1 if k in (0, 9) else 2) / 18 for k in range(10)]
    assert row.psi == pytest.approx(sum((c - b) * math.log(c / b) for b, c in zip(tenths, shares, strict=True)), abs=1e-9)


def test_best_row(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, t int, i int, x double")
    found = {r["k"]: r["i"] for r in groups.best_row(df, ["k"], F.struct("x", "i")).collect()}
    assert found == {k: max(m, key=lambda r: (r[3], r[2]))[2] for k, m in by_key(rows).items()}


@pytest.mark.parametrize("limit", [0, 7, 100_000])
def test_exact_ranks_by_sorting_and_by_chunks(chunked, limit):
    rng = random.Random(limit)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(9)}", rng.choice((None, *range(40)))) for _ in range(2_000)]
    rows += [("one", 4), ("none", None)]
    df = chunked.createDataFrame(rows, "k string, x int")
    found = {r["k"]: r["q"] for r in groups.exact_ranks(df, ["k"], "x", ["1", "(_all + 2) div 2", "_all"], "q", limit=limit).collect()}
    assert len(found) == len(by_key(rows))
    for key, members in by_key(rows).items():
        v = sorted(x for _, x in members if x is not None)
        assert found[key] == ([v[0], v[(len(v) + 2) // 2 - 1], v[-1]] if v else [None] * 3)


@pytest.mark.parametrize("rows", [1, 40, 10_000])
def test_time_chunks_follow_the_time(chunked, rows):
    rng = random.Random(rows)
    data = [("hot" if rng.random() < 0.66 else None if rng.random() < 0.5 else "k", rng.choice((None, rng.randrange(400_000))), i) for i in range(600)]
    df = chunked.createDataFrame(data, "k string, s int, i int").withColumn("ts", F.timestamp_seconds("s"))
    out = groups.time_chunks(df, ["k"], "ts", rows=rows).collect()
    assert sorted(r.i for r in out) == list(range(600))
    for key in ("hot", None, "k"):
        mine = sorted(((r.s is not None, r.s or 0), r[groups.CHUNK]) for r in out if r.k == key)
        assert [c for _, c in mine] == sorted(c for _, c in mine)
        assert len({c for _, c in mine}) == 1 or rows < 10_000
    if rows == 40:
        assert len({r[groups.CHUNK] for r in out if r.k == "hot"}) > 5


def test_heavy_keys_miss_none(spark):
    df = spark.range(100_000).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 10 == 1, "b").otherwise(F.col("id").cast("string")).alias("k"))
    found = {r.k for r in groups.heavy_keys(df, "k", 0.05).collect()}
    assert found == {"a", "b"}
    assert groups.heavy_keys(df.where("false"), "k", 0.05).count() == 0


def test_sums_of_wei_are_exact(spark):
    from tallyscope.functions import wei

    rng = random.Random(8)
    amounts = [10**37] * 2_000 + [rng.randrange(10 ** rng.randint(1, 38)) * rng.choice((1, 1, -1)) for _ in range(3_000)] + [10**38 - 1, 0]
    df = spark.createDataFrame([(k % 3, Decimal(a)) for k, a in enumerate(amounts)] + [(7, None)], "g int, value decimal(38,0)")
    rows, parts = wei.with_parts(df)
    first = rows.groupBy("g", F.pmod(F.col("_part0"), F.lit(5)).alias("p")).agg(*wei.part_sums(parts, "s"))
    second = first.groupBy("g", "p").agg(*wei.join_parts("s"))
    third = second.groupBy("g").agg(*wei.add_limbs("s"))
    got = {r.g: r for r in third.withColumn("t", wei.total("s")).withColumn("u", wei.in_units("t")).withColumn("more", F.col("t") > wei.pair_of("1.5")).collect()}
    for g in range(3):
        want = sum(a for k, a in enumerate(amounts) if k % 3 == g)
        assert int(got[g].t.high) * 10**18 + int(got[g].t.low) == want and 0 <= got[g].t.low < 10**18
        assert got[g].u == pytest.approx(want / 10**18, rel=1e-15) and got[g].more == (want > 15 * 10**17)
    assert (got[7].t.high, got[7].t.low) == (0, 0)
    assert spark.createDataFrame([(1234.5678901234,), (1e-9,)], "value_eth double").select(wei.wei(spark.createDataFrame([(1.0,)], "value_eth double"))).collect()[0][0] == 1234567890123400000000


def test_sample_ranks_by_exact_wei(spark):
    """Sums that are equal as doubles but not in wei are ranked by wei."""
    from tallyscope.operators import staging

    rows = [(f"a{k}", "sink", Decimal(10**37 + k)) for k in range(9) for _ in range(300)]
    tx = spark.createDataFrame([(f"h{i}", *r, "2024-01-30 00:00:00") for i, r in enumerate(rows)], "hash string, from_address string, to_address string, value decimal(38,0), t string")
    tx = tx.withColumn("block_timestamp", F.col("t").cast("timestamp"))
    found = [r.wallet_address for r in staging.sample_accounts(tx, as_of="2024-01-31 00:00:00", max_accounts=30).collect()]
    assert found == ["sink"] + [f"a{k}" for k in reversed(range(9))]
