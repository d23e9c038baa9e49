"""Labels, registry, context, clusters, evaluation and tables on small input."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyscope import schemas
from tallyscope.operators import clusters, context, evaluate, labels, ledger, quality, registry, splits, staging, store
from tallyscope.plans import label_queries
from tallyscope.plans.catalogue import scratch
from tallyscope.sources import scans, sinks
from tallyscope.sources.views import Views

SMALL = "/root/testdata/sf0.001"


# ----------------------------------------------------------------- labels


def test_label_table_equals_resolved_rules(spark):
    v = Views(spark, SMALL)
    limits = label_queries.LIMITS
    callers, senders, blocks = label_queries.calls(v), label_queries.senders(v), label_queries.blocks(v)
    frames = [
        labels.label_mev_bots(blocks, **limits["mev_bot"]),
        labels.label_dex_heavy(callers, **limits["defi_farmer"]),
        labels.label_nft_traders(callers, **limits["nft_trader"]),
        labels.label_smart_money(senders, callers, **limits["smart_money"]),
        labels.label_airdrop_hunters(callers, **limits["airdrop_hunter"]),
        labels.label_whales(senders, **limits["hodler"]),
    ]
    resolved = labels.resolve_labels(frames, label_queries.PROTOCOLS)
    rest = v.active.select(F.col("wallet_address").alias("address")).join(resolved, "address", "left_anti")
    rest = rest.where(~F.col("address").isin(label_queries.PROTOCOLS)).select(
        "address", F.lit("retail_trader").alias("label"), F.lit("default_unlabeled").alias("source")
    )
    whole = resolved.unionByName(rest, allowMissingColumns=True)
    columns = ["address", "label", "source", "total_tx", "dex_tx", "dex_ratio", "total_eth", "tx_per_day"]
    built = label_queries.built(v)
    assert sorted(map(str, built.select(*columns).collect())) == sorted(map(str, whole.select(*columns).collect()))


STATS = "address string, calls long, callees long, dex_calls long, dex_share double, nft_share double, bridge_calls long"


@pytest.mark.parametrize(
    ("calls", "share", "hit"), [(50, 0.70, True), (49, 0.9, False), (50, 0.69, False), (500, 1.0, True)]
)
def test_dex_heavy_bounds(spark, calls, share, hit):
    df = spark.createDataFrame([("a", calls, 1, int(calls * share), share, 0.0, 0)], STATS)
    assert labels.label_dex_heavy(df).count() == int(hit)


@pytest.mark.parametrize(("callees", "bridge", "hit"), [(20, 3, True), (19, 3, False), (20, 2, False)])
def test_airdrop_bounds(spark, callees, bridge, hit):
    df = spark.createDataFrame([("a", 100, callees, 0, 0.0, 0.0, bridge)], STATS)
    assert labels.label_airdrop_hunters(df).count() == int(hit)


@pytest.mark.parametrize(("eth", "pace", "hit"), [(100.0, 2.0, True), (99.9, 1.0, False), (500.0, 2.1, False)])
def test_whale_bounds(spark, eth, pace, hit):
    df = spark.createDataFrame([("a", 10, eth, 5, pace)], "address string, total_tx long, total_eth double, active_days long, tx_per_day double")
    assert labels.label_whales(df).count() == int(hit)


@pytest.mark.parametrize(("sandwich", "arb", "hit"), [(5, 0, True), (0, 3, True), (4, 2, False)])
def test_mev_bounds(spark, sandwich, arb, hit):
    df = spark.createDataFrame([("a", sandwich, arb)], "address string, sandwich_blocks long, arb_blocks long")
    assert labels.label_mev_bots(df).count() == int(hit)


def test_block_patterns(spark):
    router = schemas.addresses("dex")
    rows = [("a", 1, router[0]), ("a", 1, "x"), ("a", 2, router[0]), ("a", 2, router[1]), ("a", 3, router[0]), ("A", 4, "x"), ("a", 4, "y")]
    df = spark.createDataFrame(rows, "from_address string, block_number long, to_address string")
    row = labels.block_stats(df, router).first()
    assert (row["sandwich_blocks"], row["arb_blocks"]) == (2, 1)


def test_protocols_are_never_labelled(spark):
    known = schemas.PROTOCOLS[0]
    df = spark.createDataFrame([(known, "mev_bot", "s"), ("a", "unheard", "s"), ("a", "hodler", "s")], "address string, label string, source string")
    assert [tuple(r) for r in labels.resolve_labels([df]).collect()] == [("a", "hodler", "s")]


def test_address_variants():
    assert [len(schemas.addresses(c)) for c in ("dex", "lending", "nft_marketplace", "bridge")] == [5, 4, 3, 3]
    assert [len(schemas.addresses(c, "staging")) for c in ("dex", "lending", "nft_marketplace", "bridge")] == [7, 4, 5, 4]
    assert len(schemas.PROTOCOLS) == 17


# --------------------------------------------------------------- registry


def test_seed_of_known_contracts(spark):
    book = {c: schemas.addresses(c) for c in ("dex", "lending", "nft_marketplace", "bridge")}
    rows = {r["address"]: r["category"] for r in registry.seed_rows(registry.known_contracts(spark), book).collect()}
    assert rows == {a: c for a, _, c in schemas.KNOWN_CONTRACTS}


@pytest.mark.parametrize(
    ("name", "category"),
    [("UniswapV2Pair", "dex"), ("CompoundLens", "lending"), ("BlurExchange", "nft_marketplace"), ("L1Gateway", "bridge"),
     ("StakingHub", "staking"), ("YearnVault", "yield"), ("ERC20Token", "token"), ("TransparentProxy", "proxy"), ("Foo", "other")],
)
def test_category_from_name(spark, name, category):
    from tallyscope.functions.scalars import category_from_name

    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(category_from_name(F.col("n"))).first()[0] == category


def test_first_source_wins(spark):
    layout = "address string, label string, category string, source string"
    one = spark.createDataFrame([("a", "one", "dex", "s1")], layout)
    two = spark.createDataFrame([("a", "two", "dex", "s2"), ("b", "two", "dex", "s2")], layout)
    assert {(r["address"], r["label"]) for r in registry.merge_sources([one, two]).collect()} == {("a", "one"), ("b", "two")}


# ---------------------------------------------------------------- context


def test_context_of_idle_account_is_null(spark):
    v = Views(spark, SMALL)
    idle = spark.createDataFrame([("0xIDLE",)], "a string")
    row = context.account_context(idle, v.tx, v.ci, v.tt, registry.latest(v.registry)).first()
    assert row["wallet_address"] == "0xidle"
    assert row["transaction_summary"] is None and row["top_contracts"] is None
    flat = context.flat_context(context.account_context(idle, v.tx, v.ci, v.tt, registry.latest(v.registry))).first()
    assert (flat["tx_count"], flat["total_eth"], flat["active_hours"]) == (0, 0.0, [])


def test_busiest_hours_prefer_lower_hour(spark):
    day = datetime(2026, 1, 5)
    rows = [("a", day + timedelta(hours=h)) for h in (9, 9, 4, 2, 22)]
    df = spark.createDataFrame(rows, "from_address string, block_timestamp timestamp")
    row = context.timing_patterns(df).first()
    assert row["most_active_hours"] == [9, 2, 4]
    assert row["weekday_ratio"] == 1.0
    assert len(row["hourly_distribution"]) == 24 and row["hourly_distribution"][9] == 0.4


# --------------------------------------------------------------- clusters


def blobs(spark, n=300, seed=3):
    rng = random.Random(seed)
    centres = [(0.0, 0.0), (8.0, 0.0), (0.0, 9.0)]
    rows = []
    for i in range(n):
        # Two thirds of the points crowd one blob.
        c = 0 if rng.random() < 0.66 else rng.randrange(1, 3)
        rows.append((i, [rng.gauss(centres[c][0], 1.0), rng.gauss(centres[c][1], 1.0)], c if rng.random() < 0.95 else -1))
    return rows, spark.createDataFrame(rows, "vec_id long, vector array<double>, cluster int")


def brute_silhouettes(rows, distance):
    points = [r for r in rows if r[2] != -1]
    scores = {}
    for i, x, c in points:
        sums = {}
        for j, y, d in points:
            if i != j:
                sums.setdefault(d, []).append(distance(x, y))
        if c not in sums:
            scores[i] = 0.0
            continue
        a = sum(sums[c]) / len(sums[c])
        b = min(sum(v) / len(v) for d, v in sums.items() if d != c)
        scores[i] = (b - a) / max(a, b)
    return scores


def test_silhouettes_over_many_blocks(spark):
    rows, df = blobs(spark)
    found = {r["vec_id"]: r["silhouette"] for r in clusters.silhouettes(df, "vec_id", block_rows=40).collect()}
    assert found == pytest.approx(brute_silhouettes(rows, math.dist), abs=1e-6)


def test_fast_silhouettes(spark):
    rows, df = blobs(spark)
    found = {r["vec_id"]: r["silhouette"] for r in clusters.fast_silhouettes(df, 2, "vec_id").collect()}
    assert found == pytest.approx(brute_silhouettes(rows, lambda x, y: math.dist(x, y) ** 2), abs=1e-9)


def test_single_cluster_has_no_score(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0], 0) for i in range(5)], "vec_id long, vector array<double>, cluster int")
    assert all(math.isnan(r["silhouette"]) for r in clusters.silhouettes(df, "vec_id").collect())
    assert all(math.isnan(r["silhouette"]) for r in clusters.fast_silhouettes(df, 2, "vec_id").collect())
    assert math.isnan(clusters.calinski_harabasz(df, 2).first()[0])


def brute_density(rows, eps, min_samples, min_size):
    """Connected core points from all pairs."""
    near = {
        i: [j for j, q, _ in rows if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= eps * eps] for i, p, _ in rows
    }
    core = {i for i, others in near.items() if len(others) >= min_samples}
    seen, parts = set(), []
    for start in sorted(core):
        if start in seen:
            continue
        stack, part = [start], []
        seen.add(start)
        while stack:
            i = stack.pop()
            part.append(i)
            for j in near[i]:
                if j in core and j not in seen:
                    seen.add(j)
                    stack.append(j)
        if len(part) >= min_size:
            parts.append(sorted(part))
    parts.sort(key=lambda m: (-len(m), m[0]))
    found = {i: -1 for i, _, _ in rows}
    for number, members in enumerate(parts):
        found.update({i: number for i in members})
    return found


@pytest.mark.parametrize("eps", [0.15, 0.6])
def test_density_clusters(spark, eps):
    rows, df = blobs(spark, 400)
    found = clusters.density_clusters(df, eps=eps, min_samples=3, min_cluster_size=5, key="vec_id")
    assert {r["vec_id"]: r["cluster"] for r in found.collect()} == brute_density(rows, eps, 3, 5)


def test_density_clusters_with_huge_coordinates(spark):
    huge = [(1e300, 2.0)] * 5 + [(1.0000000000000002e300, 2.0)] * 5 + [(-1e300, 2.0)] * 4 + [(1e300, -1.7e308)] * 6
    near = [(0.1 * i, 0.0) for i in range(7)]
    rows = [(i, [float(x), float(y)]) for i, (x, y) in enumerate(huge + near)]
    df = spark.createDataFrame(rows, "vec_id int, vector array<double>")
    found = clusters.density_clusters(df, eps=0.25, min_samples=3, min_cluster_size=5, key="vec_id").collect()
    told = [r["cluster"] for r in sorted(found, key=lambda r: r["vec_id"])]
    # By falling size: 7 near points, 6, then 5 and 5; the group of 4 is too small.
    assert told == [2] * 5 + [3] * 5 + [-1] * 4 + [1] * 6 + [0] * 7


def test_density_clusters_do_not_depend_on_the_grid(spark):
    rows, df = blobs(spark, 300)
    half = F.transform("vector", lambda x: x + 0.3 / math.sqrt(2.0))
    here = clusters.density_clusters(df, eps=0.6, min_samples=4, min_cluster_size=4, key="vec_id")
    there = clusters.density_clusters(df.withColumn("vector", half), eps=0.6, min_samples=4, min_cluster_size=4, key="vec_id")
    found = {r["vec_id"]: r["cluster"] for r in here.collect()}
    assert found == {r["vec_id"]: r["cluster"] for r in there.collect()}
    assert len(set(found.values())) > 2


def test_density_clusters_over_a_cell_edge_and_without_places(spark):
    nan, inf = float("nan"), float("inf")
    edge = 0.1 / math.sqrt(2.0)
    rows = [(i, [edge + (0.0005 if i % 2 else -0.0005), edge + (0.0005 if i // 2 else -0.0005)]) for i in range(4)]
    rows += [(10, [nan, 0.0]), (11, [inf, 0.0]), (12, None), (13, [0.0, None]), (14, [9.0, 9.0]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    found = clusters.density_clusters(df, eps=0.1, min_samples=4, min_cluster_size=4, key="vec_id").collect()
    assert sorted((r["vec_id"], r["cluster"]) for r in found) == [(0, 0), (1, 0), (2, 0), (3, 0), (3, 0)] + [(i, -1) for i in range(10, 15)]
    assert clusters.density_clusters(df.limit(0), eps=0.1, min_samples=4, min_cluster_size=4, key="vec_id").count() == 0


def test_density_clusters_link_crowded_cells_by_their_closest_places(spark):
    # Two crowded clouds, once a little nearer than eps and once a little further.
    for gap, clouds in ((0.0999, 1), (0.1001, 2)):
        xs = [-(i + 1) * 1e-5 for i in range(40)] + [gap - 1e-5 + i * 1e-5 for i in range(40)]
        df = spark.createDataFrame([(i, [x, 0.0]) for i, x in enumerate(xs)], "vec_id long, vector array<double>")
        found = clusters.density_clusters(df, eps=0.1, min_samples=5, min_cluster_size=5, key="vec_id").collect()
        assert len({r["cluster"] for r in found}) == clouds


def test_density_cluster_along_a_chain(spark):
    rows = [(i, [i * 0.5 + 0.25, 0.0], 0) for i in range(40)] + [(100 + i, [i * 0.5 + 0.25, 5.0], 0) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>, cluster int")
    found = clusters.density_clusters(df, eps=0.5, min_samples=1, min_cluster_size=6, key="vec_id")
    assert {r["vec_id"]: r["cluster"] for r in found.collect()} == {i: 0 if i < 100 else 1 for i, _, _ in rows}


def test_crosstab_margins_add_up(spark):
    members = spark.createDataFrame([("a", 0), ("b", 0), ("c", -1)], "wallet_address string, cluster int")
    known = spark.createDataFrame([("a", "hodler")], "address string, label string")
    rows = {r["cluster"]: r.asDict() for r in clusters.label_crosstab(members, known, ["hodler"], margins=True).collect()}
    assert rows["All"] == {"cluster": "All", "hodler": 1, "unlabeled": 2, "All": 3}
    assert rows["-1"]["unlabeled"] == 1


# ----------------------------------------------------- splits, evaluation


@pytest.mark.parametrize(("n", "ratio"), [(1, 0.2), (4, 0.2), (10, 0.2), (53, 0.2), (30, 0.5), (7, 1.0)])
def test_spaced_sample(spark, n, ratio):
    import numpy as np

    df = spark.createDataFrame([(f"a{i:03d}", 0, float(i)) for i in range(n)], "wallet_address string, cluster int, distance double")
    found = sorted(int(r["distance"]) for r in splits.spaced_sample(df, ratio=ratio).collect())
    assert found == [int(i) for i in np.linspace(0, n - 1, max(1, int(n * ratio)), dtype=int)]


def test_split_shares(spark):
    rows = [(f"a{i}", "big" if i % 10 else "small") for i in range(1000)]
    df = spark.createDataFrame(rows, "wallet_address string, label string")
    counts = {(r["label"], r["split"]): r["count"] for r in splits.stratified_split(df).groupBy("label", "split").count().collect()}
    assert counts == {
        ("big", "train"): 630, ("big", "validation"): 135, ("big", "test"): 135,
        ("small", "train"): 70, ("small", "validation"): 15, ("small", "test"): 15,
    }


def test_class_report_counts_absent_guesses_as_zero(spark):
    df = spark.createDataFrame([(0, 0, 0.9), (0, 0, 0.8), (1, 0, 0.7), (2, 2, 0.6)], "label int, predicted int, confidence double")
    rows = {r["class"]: r for r in evaluate.class_report(df).collect()}
    assert rows[1]["precision"] == 0.0 and rows[1]["f1"] == 0.0
    assert rows[0]["precision"] == pytest.approx(2 / 3)
    assert rows[0]["macro_f1"] == pytest.approx((0.8 + 0.0 + 1.0) / 3)
    assert rows[0]["meets_target"] is False


def test_regression_check(spark):
    base = spark.createDataFrame([("macro_f1", 0.9), ("other", 0.5)], "metric string, value double")
    now = spark.createDataFrame([("macro_f1", 0.88), ("other", 0.495)], "metric string, value double")
    assert {r["metric"]: r["failed"] for r in evaluate.regression_check(base, now).collect()} == {"macro_f1": True, "other": False}


def test_no_drift_against_itself(spark):
    df = spark.range(500).selectExpr("cast(id % 37 as double) as x")
    moved = df.selectExpr("x + 30 as x")
    assert evaluate.drift_report(df, df, ["x"]).first()["drift_detected"] is False
    assert evaluate.drift_report(df, moved, ["x"]).first()["drift_detected"] is True


# ----------------------------------------------------------------- tables


def test_missing_feature_column_is_refused(spark):
    with pytest.raises(ValueError, match="missing"):
        store.storable_features(spark.createDataFrame([("a",)], "wallet_address string"))


def test_upsert_of_nothing_changes_nothing(spark):
    path = scratch(spark, "upsert-test")
    full = spark.createDataFrame([("a", *[1.0] * 12)], ["wallet_address", *schemas.FEATURES])
    sinks.upsert_features(full, path, "1")
    assert sinks.upsert_features(full.limit(0), path, "2").count() == 1
    assert sinks.latest_version(spark, path).endswith("version=1")


def test_unknown_raw_table_is_refused(spark):
    with pytest.raises(ValueError, match="unknown table"):
        scans.conform(spark.range(1), "raw_logs")


def test_quality_reports(spark):
    df = spark.createDataFrame([("a", True), ("a", None), (None, False)], "address string, is_erc20 boolean")
    assert quality.not_null_report({"contracts": df}).first()["failures"] == 1
    assert quality.unique_report({"contracts": df}).first()["failures"] == 1


def test_text_expiry(spark):
    texts = spark.createDataFrame([("a", "one")], "wallet_address string, narrative string")
    entries = store.text_entries(texts, created_at="2026-01-01 00:00:00")
    assert store.current_texts(entries, "2026-01-01 23:59:59").count() == 1
    assert store.current_texts(entries, "2026-01-02 00:00:00").count() == 0
    assert store.invalidate(entries, spark.createDataFrame([("a",)], "k string")).count() == 0
    assert store.invalidate(entries).count() == 0


def test_either_side_once(spark):
    df = spark.createDataFrame([("A", "b"), ("a", "a"), ("x", "B"), ("x", "y")], "from_address string, to_address string")
    wanted = spark.createDataFrame([("a",), ("B",)], "k string")
    assert sorted(map(tuple, ledger.touching(df, wanted).collect())) == [("A", "b"), ("a", "a"), ("x", "B")]


def test_sample_takes_each_tier(spark):
    # 31 accounts with the sink: tiers of 11, 10 and 10.
    when = datetime(2026, 1, 1)
    rows = [(f"s{i}", "sink", when, float(i + 1)) for i in range(30)]
    df = spark.createDataFrame(rows, "from_address string, to_address string, block_timestamp timestamp, value_eth double")
    kept = staging.sample_accounts(df, as_of="2026-01-02 00:00:00", min_tx=1, min_eth=0.0, max_accounts=9)
    volumes = [r["total_eth"] for r in kept.collect()]
    assert len(volumes) == 9 and volumes == sorted(volumes, reverse=True)
    assert sum(1 for x in volumes if x > 20) == 3 and sum(1 for x in volumes if x <= 10) == 3
