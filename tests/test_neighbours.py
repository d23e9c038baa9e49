"""Similar points of many queries, against the form for one query and all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyscope.operators import clusters, neighbours

LAYOUT = "id long, vector array<double>"


def brute(rows, asked, k):
    usable = {i: np.array(v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    result = set()
    for q in asked & set(usable):
        scores = []
        for i, v in usable.items():
            length = np.linalg.norm(v) * np.linalg.norm(usable[q])
            if i != q:
                scores.append((-round(float(v @ usable[q] / length), 9) if length else 0.0, i))
        result |= {(q, n, i) for n, (_s, i) in enumerate(sorted(scores)[:k], 1)}
    return result


def found(df):
    return {(r["query"], r["rank"], r["id"]) for r in df.collect()}


def test_clustered_copies_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    heads = rng.normal(size=(6, 8))
    rows = [(i, (heads[i % 6] + 0.05 * rng.normal(size=8)).tolist()) for i in range(300)]
    # A third of all rows are copies of one vector.
    rows += [(i, heads[0].tolist()) for i in range(300, 450)]
    rows += [(500, [0.0] * 8), (501, None), (502, []), (503, [float("nan")] * 8), (504, [None] * 8)]
    points = spark.createDataFrame(rows, LAYOUT).withColumn("query", F.lit("clash"))
    asked = {0, 1, 7, 301, 500, 501, 503, 9999}
    queries = spark.createDataFrame([(i,) for i in sorted(asked)] * 2, "wanted long")
    small = neighbours.similar_many(points, queries, 5, "id", pivots=12, cell_rows=20, query_rows=3)
    expected = brute(rows, asked, 5)
    assert found(small) == expected
    assert found(neighbours.similar_many(points, queries, 5, "id")) == expected


def test_equals_the_form_for_one_query(spark):
    points = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vector")
    )
    many = neighbours.similar_many(points, points.where("vec_id in (0, 17)").select("vec_id"), 10, "vec_id")
    for query in (0, 17):
        one = clusters.similar(points, query, 10, "vec_id").collect()
        rows = many.where(F.col("query") == query).orderBy("rank").collect()
        assert [(r["vec_id"], r["similarity"]) for r in rows] == [(r["vec_id"], r["similarity"]) for r in one]


def test_clusters_save_comparisons(spark, monkeypatch):
    rng = np.random.default_rng(8)
    heads = np.eye(16)
    rows = [(i, (heads[i % 16] + 0.01 * rng.normal(size=16)).tolist()) for i in range(640)]
    met = []
    inner = neighbours._compare

    def counted(wanted, *rest):
        met.append(wanted.count())
        return inner(wanted, *rest)

    monkeypatch.setattr(neighbours, "_compare", counted)
    points = spark.createDataFrame(rows, LAYOUT)
    queries = points.where("id < 16").select("id")
    result = neighbours.similar_many(points, queries, 3, "id", pivots=64)
    assert found(result) == brute(rows, set(range(16)), 3)
    # Of 16 * 64 pairs of query and cell.
    assert sum(met) < 16 * 64 / 3


@pytest.mark.parametrize("k", [0, 101])
def test_k_has_bounds(spark, k):
    points = spark.createDataFrame([(1, [1.0])], LAYOUT)
    with pytest.raises(ValueError):
        neighbours.similar_many(points, points.select("id"), k, "id")


def test_empty(spark):
    none = spark.createDataFrame([], LAYOUT)
    some = spark.createDataFrame([(1, [1.0, 0.0])], LAYOUT)
    assert neighbours.similar_many(none, some.select("id"), 3, "id").count() == 0
    assert neighbours.similar_many(some, none.select("id"), 3, "id").count() == 0
    assert neighbours.similar_many(some, some.select("id"), 3, "id").count() == 0
