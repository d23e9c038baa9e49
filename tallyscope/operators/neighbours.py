"""Most similar points of many points at once, exact, by cosine.

Points lie in cells around pivots; a cell knows the largest angle between its
pivot and its points. Angles obey the triangle inequality, so a query can be no
nearer to any point of a cell than (its angle to the pivot) - (that angle).
Each query meets its own cell first; the k-th score found there rules out all
cells whose bound lies below it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.groups import top_k
from tallyscope.functions.scalars import dot, norm
from tallyscope.schemas import KEY
from tallyscope.session import settle

#: Pivots, and so cells, at most; a sample of this many rows reaches the driver.
PIVOTS = 256
#: Points of a cell that meet queries in one task; larger cells are cut.
CELL_ROWS = 20_000
#: Queries that meet a part of a cell in one task.
QUERY_ROWS = 4_096
#: More than the rounding error of a cosine, so that ties are settled by exact scores.
SLACK = 1e-9


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Rows of length one; zero vectors stay zero."""
    rows = np.stack(vectors.to_numpy()).astype(np.float64)
    # Scaled first, so that squares neither overflow nor vanish.
    rows = rows / np.maximum(np.abs(rows).max(axis=1, keepdims=True, initial=0.0), np.finfo(float).tiny)
    lengths = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(lengths == 0, 1.0, lengths)


def _angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ pivots.T, -1.0, 1.0))


def _usable(points: DataFrame, key: str) -> DataFrame:
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return points.where(F.col(key).isNotNull() & (F.size("vector") > 0) & fine).select(key, "vector")


def _home_cells(points: DataFrame, pivots: np.ndarray, key: str) -> DataFrame:
    """Each point with its nearest pivot and the angle to it."""

    def place(batches):
        for batch in batches:
            angles = _angles(_matrix(batch["vector"]), pivots)
            cell = angles.argmin(axis=1)
            yield batch.assign(cell=cell.astype("int32"), angle=angles[np.arange(len(cell)), cell])

    schema = f"{points.select(key, 'vector')._jdf.schema().toDDL()}, cell int, angle double"
    return points.mapInPandas(place, schema)


def _bounds(queries: DataFrame, pivots: np.ndarray, widths: dict[int, float], query_type: str) -> DataFrame:
    """For each query the highest cosine that each cell could hold."""
    cells = np.array(sorted(widths), dtype="int32")
    spread = np.array([widths[c] for c in cells.tolist()])

    def bound(batches):
        for batch in batches:
            angles = _angles(_matrix(batch["vector"]), pivots[cells])
            best = np.cos(np.clip(angles - spread, 0.0, np.pi)) + SLACK
            yield pd.DataFrame(
                {
                    "query": np.repeat(batch["query"].to_numpy(), len(cells)),
                    "cell": np.tile(cells, len(batch)),
                    "bound": best.ravel(),
                }
            )

    return queries.mapInPandas(bound, f"query {query_type}, cell int, bound double")


def _compare(wanted: DataFrame, points: DataFrame, key: str, k: int, key_type: str) -> DataFrame:
    """Candidates of each query in each part of a cell that it is to meet.

    A part gives all different vectors that score at least as high as its k-th
    best, each with its k + 1 smallest ids: copies tie, and the query itself may
    be among them.
    """

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: dict[str, list] = {"query": [], key: []}
        if len(left) and len(right):
            ordered = right.sort_values(key, kind="stable")
            rows, which = np.unique(_matrix(ordered["vector"]), axis=0, return_inverse=True)
            ids = ordered[key].to_numpy()[np.argsort(which.ravel(), kind="stable")]
            ends = np.cumsum(np.bincount(which.ravel(), minlength=len(rows)))
            shares = [ids[start:end][: k + 1] for start, end in zip([0, *ends[:-1]], ends)]
            queries = left["query"].to_numpy()
            vectors = _matrix(left["vector"])
            # The own vector may be one of the best, hence one more.
            kth = min(k + 1, len(rows))
            for start in range(0, len(queries), 256):
                scores = vectors[start : start + 256] @ rows.T
                edge = np.partition(scores, len(rows) - kth, axis=1)[:, len(rows) - kth]
                for q, (line, low) in enumerate(zip(scores, edge), start):
                    for row in np.flatnonzero(line >= low - SLACK):
                        found["query"].extend([queries[q]] * len(shares[row]))
                        found[key].extend(shares[row])
        return pd.DataFrame(found)

    left = wanted.groupBy("cell", "part", "block")
    right = points.groupBy("cell", "part", "block")
    return left.cogroup(right).applyInPandas(meet, f"query {key_type}, {key} {key_type}")


def similar_many(
    points: DataFrame,
    queries: DataFrame,
    k: int = 10,
    key: str = KEY,
    *,
    pivots: int | None = None,
    cell_rows: int = CELL_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """The ``k`` points most like each query account by cosine, itself excluded.

    ``queries`` has one column of ids, repeated or unknown ones do no harm; ids of
    ``points`` are unique. Result: ``query``, ``rank`` from 1, ``key``,
    ``similarity``; ties go to the smaller id. A zero vector scores 0 with all.
    Rows whose vector is NULL, empty or holds NULL or non-finite components take
    no part. All vectors have one length.

    Pivots come from a sample of ``pivots`` rows (without it the square root of the
    number of rows, at most ``PIVOTS``), which decides only the work, not the
    result. Work grows with queries times the points in cells that their bound
    can't exclude: all cells for directions without any clusters, few otherwise.
    """
    if not 1 <= k <= 100:
        raise ValueError("k must lie between 1 and 100")
    key_type = points.schema[key].dataType.simpleString()
    usable = _usable(points, key)
    if pivots is None:
        pivots = min(PIVOTS, 1 + math.isqrt(usable.count()))
    # Only hashes move before the sample is cut out, no vectors.
    place = F.xxhash64(key)
    last = usable.select(place.alias("h")).orderBy("h").limit(pivots).agg(F.max("h").alias("h"))
    sample = usable.where(place <= last.scalar()).limit(pivots).select("vector").toPandas()
    if sample.empty:
        return points.sparkSession.createDataFrame(
            [], f"query {key_type}, rank int, {key} {key_type}, similarity double"
        )
    centres = _matrix(sample["vector"])
    placed = settle(_home_cells(usable, centres, key))
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("width"))
    # At most one row per pivot.
    cells = sizes.collect()
    parts = F.create_map(*[F.lit(x) for c in cells for x in (c["cell"], -(-c["n"] // cell_rows))])
    asked = queries.select(F.col(queries.columns[0]).cast(key_type).alias("query")).distinct()
    asked = settle(
        asked.join(placed.withColumnRenamed(key, "query"), "query").select(
            "query", "vector", F.col("cell").alias("home")
        )
    )
    blocks = max(1, -(-asked.count() // query_rows))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query", F.lit(1)), F.lit(blocks)).cast("int"))

    beside = placed.select(
        key,
        "vector",
        "cell",
        F.pmod(F.xxhash64(key, F.lit(2)), parts[F.col("cell")]).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )

    def candidates(chosen: DataFrame) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), (parts[F.col("cell")] - 1).cast("int")))
        met = chosen.select("query", "vector", "block", "cell", every.alias("part"))
        # Parts that no query of a block is to meet stay out of the exchange.
        used = met.select("cell", "part", "block").distinct()
        return _compare(met, beside.join(used, ["cell", "part", "block"], "left_semi"), key, k, key_type)

    def scored(pairs: DataFrame) -> DataFrame:
        other = placed.select(key, F.col("vector").alias("_v"))
        both = pairs.where(F.col("query") != F.col(key)).join(other, key)
        both = both.join(asked.select("query", F.col("vector").alias("_q")), "query")
        length = norm(F.col("_v")) * norm(F.col("_q"))
        score = F.when(length == 0, 0.0).otherwise(F.try_divide(dot(F.col("_v"), F.col("_q")), length))
        best = both.select("query", key, score.alias("similarity"))
        return top_k(best, ["query"], [F.desc("similarity"), F.asc(key)], k)

    near = settle(scored(candidates(asked.withColumnRenamed("home", "cell"))))
    low = near.where(F.col("rank") == k).select("query", F.col("similarity").alias("low"))
    bounds = _bounds(asked, centres, {c["cell"]: c["width"] for c in cells}, key_type)
    far = bounds.join(asked, "query").where(F.col("cell") != F.col("home"))
    far = far.join(low, "query", "left").where(F.col("low").isNull() | (F.col("bound") >= F.col("low")))
    far = settle(far.select("query", "vector", "block", "cell"))
    whole = near.drop("rank").unionByName(scored(candidates(far)).drop("rank"))
    ranked = top_k(whole, ["query"], [F.desc("similarity"), F.asc(key)], k)
    return ranked.select("query", F.col("rank").cast("int").alias("rank"), key, "similarity")
