"""Similarity, clustering, cluster reports, splits and samples."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.scalars import dot, ratio_band, squared_distance
from tallyscope.operators import clusters, context, neighbours, splits
from tallyscope.plans.catalogue import query, r, scratch
from tallyscope.schemas import KEY
from tallyscope.sources import sinks
from tallyscope.sources.views import Views

DIMS = 64
ID = "vec_id"
# The vector components serve as a feature matrix.
COLUMNS = [f"e{i}" for i in range(DIMS)]


def wide(v: Views) -> DataFrame:
    return clusters.as_columns(v.points, COLUMNS, ID, "cluster")


WIDE = "wide AS (SELECT vec_id, cluster, " + ", ".join(f"vector[{i + 1}] AS {c}" for i, c in enumerate(COLUMNS)) + " FROM points)"
LONG = f"{WIDE}, long AS (SELECT * FROM (UNPIVOT wide ON {', '.join(COLUMNS)} INTO NAME feature VALUE x))"
CENTRES = """centres AS (SELECT cluster, d, avg(x) AS c, count(*) AS size FROM dims WHERE cluster <> -1 GROUP BY 1, 2)"""
GAPS = f"""{CENTRES}, gaps AS (SELECT vec_id, cluster, sqrt(sum((x - c) ** 2)) AS distance
    FROM dims JOIN centres USING (cluster, d) GROUP BY 1, 2)"""

# --------------------------------------------------- similarity, scaling


@query(
    "v1_similar_accounts",
    f"""SELECT p.vec_id, p.cluster, {r('list_cosine_similarity(p.vector, q.vector)', 'similarity')}
    FROM points p, points q WHERE q.vec_id = 0 AND p.vec_id <> 0
    ORDER BY list_cosine_similarity(p.vector, q.vector) DESC, p.vec_id LIMIT 10""",
    "points",
)
def _(v: Views):
    return clusters.similar(v.points, 0, 10, ID)


@query(
    "v1_similar_to_many",
    f"""ranked AS (SELECT q.vec_id AS query, p.vec_id, list_cosine_similarity(p.vector, q.vector) AS s,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(p.vector, q.vector) DESC, p.vec_id) AS n
    FROM points p, points q WHERE q.vec_id % 20 = 0 AND p.vec_id <> q.vec_id)
    SELECT query, CAST(n AS INT) AS rank, vec_id, {r('s', 'similarity')} FROM ranked WHERE n <= 10""",
    "points",
)
def _(v: Views):
    asked = v.points.where(F.col(ID) % 20 == 0).select(ID)
    return neighbours.similar_many(v.points, asked, 10, ID)


@query(
    "v2_standard_scaling",
    f"""SELECT vec_id, CAST(d AS INT) AS d, {r('(x - avg(x) OVER w) / stddev_pop(x) OVER w', 'x')} FROM dims
    WINDOW w AS (PARTITION BY d)""",
    "dims",
)
def _(v: Views):
    scaled = clusters.standardise_vectors(v.points, DIMS)
    return scaled.select(ID, F.posexplode("vector").alias("d", "x"))


@query("v3_principal_components")
def _(v: Views):
    reduced = clusters.reduce_dimensions(clusters.standardise_vectors(v.points, DIMS))
    return reduced.select(ID, F.col("vector")[0].alias("pc1"), F.col("vector")[1].alias("pc2"))


# Turning to all components keeps each vector's length, and the components are uncorrelated.
@query(
    "v3_rotation_evidence",
    f"""scaled AS (SELECT vec_id, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS x FROM dims WINDOW w AS (PARTITION BY d))
    SELECT vec_id, {r('sum(x * x)', 'squared_length')}, true AS falling, true AS uncorrelated
    FROM scaled GROUP BY 1""",
    "dims",
)
def _(v: Views):
    turned = clusters.reduce_dimensions(clusters.standardise_vectors(v.points, DIMS), DIMS)
    c = F.col("vector")
    told = turned.agg(*[F.var_pop(c[i]).alias(f"v{i}") for i in range(DIMS)], *[
        F.abs(F.covar_pop(c[i], c[i + 1])).alias(f"c{i}") for i in range(DIMS - 1)
    ])
    flags = told.select(
        F.struct(
            reduce(and_, [F.col(f"v{i}") >= F.col(f"v{i + 1}") - 1e-9 for i in range(DIMS - 1)]).alias("falling"),
            reduce(and_, [F.col(f"c{i}") < 1e-9 for i in range(DIMS - 1)]).alias("uncorrelated"),
        )
    )
    rows = turned.select(ID, dot(c, c).alias("squared_length"), flags.scalar().alias("_f"))
    return rows.select(ID, "squared_length", "_f.falling", "_f.uncorrelated")


@query(
    "v4_assignment_evidence",
    "SELECT vec_id, true AS at_nearest_centre, true AS listed FROM points",
    "points",
)
def _(v: Views):
    model = clusters.fit_clusters(v.points, 6)
    centres = F.lit([[float(x) for x in c] for c in model.stages[-1].clusterCenters()])
    placed = clusters.apply_clusters(model, v.points)
    gaps = F.transform(centres, lambda c: squared_distance(F.col("embedding"), c))
    return placed.select(
        ID,
        (F.element_at(gaps, F.col("cluster") + 1) <= F.array_min(gaps) + 1e-12).alias("at_nearest_centre"),
        F.col("cluster").between(0, 5).alias("listed"),
    )


@query("v4_fitted_clusters")
def _(v: Views):
    model = clusters.fit_clusters(v.points, 6)
    return clusters.apply_clusters(model, v.points).select(ID, "cluster")


@query("v6_predicted_clusters")
def _(v: Views):
    known, new = v.points.where(F.col("cluster") != -1), v.points.where(F.col("cluster") == -1)
    return clusters.apply_clusters(clusters.fit_clusters(known, 6), new).select(ID, "cluster")


EPS, MIN_SAMPLES, MIN_SIZE = 0.015, 4, 8
# Two fixed directions that use every component.
AXES = [[0.125 if i < DIMS // 2 else -0.125 for i in range(DIMS)], [0.125 - 0.25 * (i % 2) for i in range(DIMS)]]


@query(
    "v5_density_clusters",
    f"""WITH RECURSIVE p AS MATERIALIZED (SELECT vec_id, list_inner_product(CAST(embedding AS DOUBLE[]), {AXES[0]}::DOUBLE[]) AS x,
        list_inner_product(CAST(embedding AS DOUBLE[]), {AXES[1]}::DOUBLE[]) AS y FROM embeddings),
    near AS MATERIALIZED (SELECT a.vec_id, b.vec_id AS other FROM p a JOIN p b
        ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= {EPS * EPS!r}),
    core AS MATERIALIZED (SELECT vec_id FROM near GROUP BY 1 HAVING count(*) >= {MIN_SAMPLES}),
    link AS MATERIALIZED (SELECT n.* FROM near n JOIN core a USING (vec_id) JOIN core b ON n.other = b.vec_id),
    reach AS (SELECT vec_id, vec_id AS root FROM core UNION
        SELECT l.other, r.root FROM reach r JOIN link l USING (vec_id)),
    comp AS (SELECT vec_id, min(root) AS root FROM reach GROUP BY 1),
    sized AS (SELECT root, count(*) AS size FROM comp GROUP BY 1 HAVING count(*) >= {MIN_SIZE}),
    numbered AS (SELECT root, CAST(row_number() OVER (ORDER BY size DESC, root) - 1 AS INT) AS cluster FROM sized)
    SELECT vec_id, coalesce(cluster, -1) AS cluster FROM p LEFT JOIN comp USING (vec_id) LEFT JOIN numbered USING (root)""",
)
def _(v: Views):
    on_axes = [dot(F.col("vector"), F.array(*[F.lit(w) for w in axis])) for axis in AXES]
    flat = v.points.select(ID, F.array(*on_axes).alias("vector"))
    found = clusters.density_clusters(
        flat, eps=EPS, min_samples=MIN_SAMPLES, min_cluster_size=MIN_SIZE, key=ID
    )
    return found.select(ID, "cluster")


@query("v5_density_on_components")
def _(v: Views):
    reduced = clusters.reduce_dimensions(v.points)
    found = clusters.density_clusters(reduced, eps=0.05, min_samples=3, min_cluster_size=10, key=ID)
    return found.select(ID, "cluster")


@query(
    "v6_nearest_centroid",
    f"""{CENTRES}, g AS (SELECT vec_id, c.cluster, sqrt(sum((x - c) ** 2)) AS distance
        FROM dims JOIN centres c USING (d) GROUP BY 1, 2)
    SELECT vec_id, cluster, {r('distance', 'distance')} FROM (SELECT *, row_number() OVER (PARTITION BY vec_id
    ORDER BY distance, cluster) AS rn FROM g) WHERE rn = 1""",
    "dims",
)
def _(v: Views):
    centres = clusters.centroids(v.points.where(F.col("cluster") != -1), DIMS)
    return clusters.assign_nearest(v.points, centres).select(ID, "cluster", "distance")


# --------------------------------------------------------------- reports


@query(
    "v7_cluster_statistics",
    f"""SELECT cluster, count(*) AS size, CAST(d AS INT) AS d, {r('avg(x)', 'x')} FROM dims GROUP BY cluster, d""",
    "dims",
)
def _(v: Views):
    stats = clusters.centroids(v.points, DIMS)
    return stats.select("cluster", "size", F.posexplode("centroid").alias("d", "x"))


@query(
    "v8_exemplars",
    f"""{GAPS} SELECT vec_id, cluster, {r('distance', 'distance')}, CAST(rn AS INT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance, vec_id) AS rn FROM gaps) WHERE rn <= 20""",
    "dims",
)
def _(v: Views):
    return clusters.exemplars(v.points, DIMS, 20, ID).drop("vector")


SILHOUETTE = """pairs AS (SELECT a.vec_id, a.cluster, b.cluster AS other, list_distance(a.vector, b.vector) AS gap
    FROM points a JOIN points b ON a.vec_id <> b.vec_id AND a.cluster <> -1 AND b.cluster <> -1),
means AS (SELECT vec_id, cluster, other, avg(gap) AS m FROM pairs GROUP BY 1, 2, 3),
ab AS (SELECT vec_id, cluster, max(CASE WHEN cluster = other THEN m END) AS a,
    min(CASE WHEN cluster <> other THEN m END) AS b FROM means GROUP BY 1, 2),
sil AS (SELECT vec_id, cluster, CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM ab)"""


@query(
    "v9_silhouettes",
    f"{SILHOUETTE} SELECT vec_id, cluster, {r('silhouette', 'silhouette')} FROM sil",
    "points",
)
def _(v: Views):
    return clusters.silhouettes(v.points, ID)


@query(
    "v9_mean_silhouette",
    f"{SILHOUETTE} SELECT {r('avg(silhouette)', 'silhouette')}, count(*) AS points FROM sil",
    "points",
)
def _(v: Views):
    scores = clusters.silhouettes(v.points, ID)
    return scores.agg(F.avg("silhouette").alias("silhouette"), F.count(F.lit(1)).alias("points"))


@query(
    "v9_fast_silhouettes",
    SILHOUETTE.replace("list_distance(a.vector, b.vector)", "list_distance(a.vector, b.vector) ** 2")
    + f" SELECT vec_id, cluster, {r('silhouette', 'silhouette')} FROM sil",
    "points",
)
def _(v: Views):
    return clusters.fast_silhouettes(v.points, DIMS, ID)


@query(
    "v10_calinski_harabasz",
    f"""{CENTRES}, mid AS (SELECT d, avg(x) AS m FROM dims WHERE cluster <> -1 GROUP BY 1),
    w AS (SELECT sum((x - c) ** 2) AS w FROM dims JOIN centres USING (cluster, d)),
    b AS (SELECT sum(size * (c - m) ** 2) AS b, count(DISTINCT cluster) AS k FROM centres JOIN mid USING (d)),
    n AS (SELECT count(DISTINCT vec_id) AS n FROM dims WHERE cluster <> -1)
    SELECT {r('(b / (k - 1)) / (w / (n - k))', 'calinski_harabasz')}, k AS n_clusters FROM w, b, n""",
    "dims",
)
def _(v: Views):
    return clusters.calinski_harabasz(v.points, DIMS)


@query(
    "v11_cluster_sizes",
    f"""SELECT cluster, count(*) AS size, {r('count(*) * 100.0 / (SELECT count(*) FROM points)', 'pct')},
    (SELECT count(DISTINCT cluster) FROM points WHERE cluster <> -1) AS n_clusters,
    {r('(SELECT avg(CASE WHEN cluster = -1 THEN 1 ELSE 0 END) FROM points)', 'noise_ratio')}
    FROM points GROUP BY cluster""",
    "points",
)
def _(v: Views):
    return clusters.cluster_sizes(v.points)


@query("v12_stability")
def _(v: Views):
    return clusters.stability(v.points.drop("cluster"), k=5, runs=3, key=ID)


PROFILE = f"""{LONG},
prof AS (SELECT cluster, feature, avg(x) AS mean, stddev_samp(x) AS std, any_value(gm) AS global_mean,
    avg(x) / any_value(gm) AS ratio_to_global, (avg(x) - any_value(gm)) / any_value(gs) AS z_score, count(*) AS size,
    count(*) * 100.0 / any_value(n) AS pct FROM (SELECT *, avg(x) OVER w AS gm, stddev_samp(x) OVER w AS gs,
    count(*) OVER w AS n FROM long WINDOW w AS (PARTITION BY feature)) GROUP BY 1, 2)"""
BAND = """CASE WHEN ratio_to_global > 2 THEN 'HIGH' WHEN ratio_to_global > 1.3 THEN 'high'
    WHEN ratio_to_global < 0.3 THEN 'LOW' WHEN ratio_to_global < 0.7 THEN 'low' ELSE '' END"""
_NUMBERS = ["mean", "std", "global_mean", "ratio_to_global", "z_score", "pct"]


def profile(v: Views) -> DataFrame:
    return clusters.profiles(wide(v), COLUMNS)


@query(
    "v13_cluster_profiles",
    f"{PROFILE} SELECT cluster, feature, size, {', '.join(r(c, c) for c in _NUMBERS)}, {BAND} AS band FROM prof",
    "points",
)
def _(v: Views):
    return profile(v)


@query(
    "v14_distinctive_features",
    f"""{PROFILE} SELECT cluster, feature, {r('ratio_to_global', 'ratio_to_global')}, {r('z_score', 'z_score')},
    CAST(rn AS INT) AS rank, CASE WHEN ratio_to_global > 1.3 THEN 'HIGH' WHEN ratio_to_global < 0.7 THEN 'LOW'
    ELSE '~avg' END AS direction FROM (SELECT *, row_number() OVER (PARTITION BY cluster
    ORDER BY abs(z_score) DESC, feature) AS rn FROM prof) WHERE rn <= 5""",
    "points",
)
def _(v: Views):
    best = clusters.distinctive_features(profile(v))
    return best.select("cluster", "feature", "ratio_to_global", "z_score", "rank", "direction")


@query(
    "v15_discriminating_features",
    f"""{PROFILE} SELECT feature, {r('stddev_samp(ratio_to_global)', 'spread')} FROM prof GROUP BY 1
    ORDER BY stddev_samp(ratio_to_global) DESC, 1 LIMIT 6""",
    "points",
)
def _(v: Views):
    return clusters.discriminating_features(profile(v))


@query(
    "v16_silhouette_report",
    f"""{SILHOUETTE} SELECT cluster, {r('avg(silhouette)', 'mean')}, {r('stddev_samp(silhouette)', 'std')},
    {r('min(silhouette)', 'min')}, {r('max(silhouette)', 'max')}, count(*) AS count,
    count(*) FILTER (silhouette < 0) AS negative, {r('median(silhouette)', 'median')} FROM sil GROUP BY 1""",
    "points",
)
def _(v: Views):
    return clusters.silhouette_report(clusters.silhouettes(v.points, ID))


@query(
    "v17_profile_matrix",
    f"""{PROFILE} SELECT cluster, {', '.join(
        r(f"max(CASE WHEN feature = '{c}' THEN least(ratio_to_global, 5) END)", c) for c in COLUMNS)}
    FROM prof GROUP BY 1""",
    "points",
)
def _(v: Views):
    return clusters.profile_matrix(profile(v), COLUMNS)


VOLUMES = """fv AS (SELECT 'w' || c_custkey AS wallet_address, c_acctbal AS balance,
    coalesce(v, 0) AS total_eth_volume, coalesce(n, 0) AS tx_count FROM customer LEFT JOIN (
    SELECT from_address, sum(value_eth) AS v, count(*) AS n FROM tx GROUP BY 1) s
    ON from_address = 'w' || c_custkey)"""


def volumes(v: Views) -> DataFrame:
    accounts = v.table("customer").select(
        F.concat(F.lit("w"), F.col("c_custkey").cast("string")).alias(KEY), F.col("c_acctbal").alias("balance")
    )
    return clusters.features_with_volume(accounts, v.tx)


@query(
    "v18_features_with_volume",
    f"""{VOLUMES} SELECT wallet_address, {r('balance', 'balance')}, {r('total_eth_volume', 'total_eth_volume')},
    tx_count FROM fv""",
    "tx",
)
def _(v: Views):
    return volumes(v)


@query(
    "a10_cluster_summary",
    f"""{LONG} SELECT cluster, feature, {r('avg(x)', 'mean')}, {r('stddev_samp(x)', 'std')}, {r('median(x)', 'median')}
    FROM long GROUP BY 1, 2""",
    "points",
)
def _(v: Views):
    return clusters.cluster_summary(wide(v), COLUMNS)


@query(
    "s13_profile_documents",
    f"""{PROFILE} SELECT CASE WHEN cluster = -1 THEN 'noise' ELSE 'cluster_' || cluster END AS cluster, size,
    {r('round(pct, 2)', 'pct')}, feature, {r('round(mean, 6)', 'mean')}, {r('round(global_mean, 6)', 'global_mean')},
    {r('round(ratio_to_global, 3)', 'ratio')}, {r('round(z_score, 3)', 'z_score')} FROM prof""",
    "points",
)
def _(v: Views):
    saved = sinks.write_json(sinks.profile_documents(profile(v)), scratch(v.spark, "profiles"))
    rows = saved.select("cluster", "size", "pct", F.explode("features").alias("feature", "s"))
    return rows.select("cluster", "size", "pct", "feature", "s.*")


@query(
    "c8_cluster_text",
    f"""{PROFILE}, {GAPS},
    st AS (SELECT cluster, size, string_agg('  ' || feature || ': ' || format('{{:.4f}}', round(mean, 4)), chr(10)
        ORDER BY feature) AS t FROM prof GROUP BY 1, 2),
    ex AS (SELECT cluster, string_agg('  ' || vec_id, chr(10) ORDER BY rn) AS m FROM (SELECT *, row_number() OVER (
        PARTITION BY cluster ORDER BY distance, vec_id) AS rn FROM gaps) WHERE rn <= 3 GROUP BY 1)
    SELECT cluster, 'Cluster ' || cluster || ' has ' || size || ' members.' || chr(10) || 'Its statistics:' || chr(10)
    || t || chr(10) || 'Its most typical members:' || chr(10) || coalesce(m, '  none') || chr(10)
    || 'Name the cluster, describe what its members share, and say what that means for others.' AS prompt
    FROM st LEFT JOIN ex USING (cluster)""",
    "dims",
)
def _(v: Views):
    return context.describe_clusters(profile(v), clusters.exemplars(v.points, DIMS, 3, ID), ID)


@query(
    "s14_exemplar_file",
    f"""{GAPS} SELECT vec_id, cluster, {r('distance', 'distance')}, CAST(rn AS INT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance, vec_id) AS rn FROM gaps) WHERE rn <= 15""",
    "dims",
)
def _(v: Views):
    best = clusters.exemplars(v.points, DIMS, 15, ID).drop("vector")
    return sinks.write_csv(best, scratch(v.spark, "exemplars"))


@query(
    "x8_ratio_bands",
    "SELECT l_orderkey, l_linenumber, " + r("l_quantity / 25", "ratio") + ", "
    + BAND.replace("ratio_to_global", "(l_quantity / 25)") + " AS band FROM lineitem",
)
def _(v: Views):
    ratio = F.col("l_quantity") / 25
    return v.table("lineitem").select("l_orderkey", "l_linenumber", ratio.alias("ratio"), ratio_band(ratio).alias("band"))


# ------------------------------------------------------ splits, samples


def segments(v: Views) -> DataFrame:
    return v.table("customer").select("c_custkey", F.col("c_mktsegment").alias("label"))


ORDER = "md5('42:' || c_custkey), c_custkey"


@query(
    "t3_interleaved_split",
    f"""{VOLUMES} SELECT wallet_address, CASE WHEN row_number() OVER (
    ORDER BY round(total_eth_volume, 9) DESC, wallet_address) % 2 = 1 THEN 'discovery' ELSE 'validation' END AS split
    FROM fv""",
    "tx",
)
def _(v: Views):
    return splits.interleaved_split(volumes(v)).select(KEY, "split")


@query(
    "t4_spaced_sample",
    f"""{GAPS}, k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance, vec_id) - 1 AS pos,
        count(*) OVER (PARTITION BY cluster) AS n FROM gaps),
    m AS (SELECT *, greatest(1, CAST(floor(n * 0.2) AS BIGINT)) AS want FROM k),
    picks AS (SELECT cluster, i, CASE WHEN want = 1 THEN 0 ELSE (i * (n - 1)) // (want - 1) END AS pos
        FROM (SELECT DISTINCT cluster, n, want, unnest(range(want)) AS i FROM m))
    SELECT vec_id, cluster, {r('distance', 'distance')}, CAST(i AS INT) AS pick FROM m JOIN picks USING (cluster, pos)""",
    "dims",
)
def _(v: Views):
    taken = splits.spaced_sample(clusters.centroid_distances(v.points, DIMS), key=ID)
    return taken.select(ID, "cluster", "distance", "pick")


_PART = "CASE WHEN s < 0.7 THEN 'train' WHEN s < 0.85 THEN 'validation' ELSE 'test' END AS split"


@query(
    "t5_stratified_split",
    f"""SELECT c_custkey, label, {_PART} FROM (SELECT c_custkey, c_mktsegment AS label, (row_number() OVER (
    PARTITION BY c_mktsegment ORDER BY {ORDER}) - 1) / count(*) OVER (PARTITION BY c_mktsegment) AS s FROM customer)""",
)
def _(v: Views):
    return splits.stratified_split(segments(v), key="c_custkey")


@query(
    "t5_unstratified_split",
    f"""SELECT c_custkey, label, {_PART} FROM (SELECT c_custkey, CASE WHEN c_custkey = 0 THEN 'rare' ELSE c_mktsegment
    END AS label, (row_number() OVER (ORDER BY {ORDER}) - 1) / count(*) OVER () AS s FROM customer)""",
)
def _(v: Views):
    rare = segments(v).withColumn("label", F.when(F.col("c_custkey") == 0, "rare").otherwise(F.col("label")))
    return splits.stratified_split(rare, key="c_custkey")


@query(
    "t6_stratified_folds",
    f"""SELECT c_custkey, c_mktsegment AS label, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY {ORDER})
    - 1) % 5 AS INT) AS fold FROM customer""",
)
def _(v: Views):
    return splits.stratified_folds(segments(v), key="c_custkey")


@query(
    "t7_subsample",
    f"""SELECT c_custkey, label FROM (SELECT c_custkey, c_mktsegment AS label, row_number() OVER (ORDER BY {ORDER}) AS p,
    count(*) OVER () AS n FROM customer) WHERE p <= floor(n * 0.8)""",
)
def _(v: Views):
    return splits.subsample(segments(v), key="c_custkey")


@query(
    "t8_explorer_page",
    f"""{WIDE} SELECT vec_id AS wallet_address, cluster, {r('e3', 'e3')} FROM wide WHERE cluster = 4
    ORDER BY wide.e3 DESC, vec_id LIMIT 100""",
    "points",
)
def _(v: Views):
    rows = wide(v).select(F.col(ID).alias(KEY), "cluster", "e3")
    return splits.explorer_page(rows, "e3", cluster=4)
