"""Operator 5: near duplicates among embeddings by a PCA-ordered tiled comparison.

Vectors are scaled to length one and rotated onto their principal axes, so leading
dimensions hold most of the length. Inside a label they are ordered by the first
axis and cut into blocks of several thousand, and pairs of blocks meet. Vectors
within the threshold are close to each other, so blocks whose ranges on the first
axes are too far apart don't meet. A block is cut into tiles across its widest
axes, and tiles whose boxes are too far apart are passed over. A pair of tiles adds
up leading dimensions first; the rest of each product is bounded by the norms of
what is left, and pairs that can't reach the threshold stop there. Only turned
vectors move to the blocks. The few pairs that rounding leaves open are decided by
the cosine of the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions.groups import attach, group_position, is_small
from tallyscope.llm.common import query, ready, table
from tallyscope.llm.components import Forest, connected_components
from tallyscope.session import settle

THRESHOLD = 0.93
TILE = 1_024
#: Turned vectors of a block, in bytes; a task holds two blocks.
BLOCK_BYTES = 8 << 20
#: Dimensions after which a pair may stop.
STEPS = (8, 16, 32)
#: Axes on which blocks are compared.
AXES = 4
#: Room for rounding. It keeps more pairs in the bounds, and leaves pairs so close to the threshold to the originals.
SLACK = 1e-9


def compare(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions (i, j) of all pairs whose cosine may reach ``threshold``, and the cosines as far as rounding allows.

    ``a`` and ``b`` are unit vectors on the principal axes.
    """
    def rest(x: np.ndarray, upto: int) -> np.ndarray:
        return np.sqrt((x[:, upto:] ** 2).sum(1))

    first = min(STEPS[0], a.shape[1])
    bound = a[:, :first] @ b[:, :first].T + rest(a, first)[:, None] * rest(b, first)[None, :]
    i, j = np.nonzero(bound >= threshold - SLACK)
    before, sums = 0, np.zeros(len(i))
    for upto in (*[s for s in STEPS if s < a.shape[1]], a.shape[1]):
        sums += np.einsum("ij,ij->i", a[i, before:upto], b[j, before:upto])
        left = rest(a, upto)[i] * rest(b, upto)[j]
        keep = sums + left >= threshold - SLACK
        i, j, sums, before = i[keep], j[keep], sums[keep], upto
    return i, j, sums


def cut(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Positions of the rows in tiles of at most ``size``, halved across the axis on which a tile is widest."""
    todo, done = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        part = x[rows]
        axis = int(np.argmax(part.max(0) - part.min(0)))
        order = rows[np.argsort(part[:, axis], kind="stable")]
        todo += [order[: len(rows) // 2], order[len(rows) // 2 :]]
    return done


def close_tiles(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of tiles of two blocks (of one, if ``same``) whose boxes allow a cosine of ``threshold``."""
    # Unit vectors with this cosine are at most so far apart.
    reach = max(0.0, 2 - 2 * threshold) + SLACK
    tiles_a = cut(a, TILE)
    tiles_b = tiles_a if same else cut(b, TILE)
    box_a, box_b = ([(x[t].min(0), x[t].max(0)) for t in tiles] for x, tiles in ((a, tiles_a), (b, tiles_b)))
    for k, (rows_a, (low_a, high_a)) in enumerate(zip(tiles_a, box_a, strict=True)):
        for rows_b, (low_b, high_b) in list(zip(tiles_b, box_b, strict=True))[k if same else 0 :]:
            gap = np.maximum(0.0, np.maximum(low_a - high_b, low_b - high_a))
            if gap @ gap <= reach:
                yield rows_a, rows_b


def cosines(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Cosines of pairs of vectors that are not zero, in double precision.

    Each is first scaled by a power of two, which changes no digit, so that squares of large components stay finite.
    """
    out = np.zeros(len(a))
    for k in range(len(a)):
        x, y = (np.asarray(v[k].values, dtype=float) for v in (a, b))
        x, y = (np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])) for v in (x, y))
        out[k] = (x @ y) / (np.sqrt(x @ x) * np.sqrt(y @ y))
    return out


def _compare_blocks(threshold: float):
    def links(unit: pd.DataFrame) -> pd.DataFrame:
        """Links of each vector within this pair of blocks with its root in their forest; open pairs as ``low``, ``high``."""
        low = unit[unit["side"] == 0]
        high = unit[unit["side"] == 1]
        same = high.empty
        high = low if same else high
        a, b = (np.stack(t["turned"].to_numpy()) for t in (low, high))
        ids_a, ids_b, copies_a, copies_b, rows_a, rows_b = (
            t[c].to_numpy() for c in ("node", "copies", "row") for t in (low, high)
        )
        count_a, count_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        forest, lows, highs = Forest(), [], []
        for tile_a, tile_b in close_tiles(a, b, threshold, same):
            i, j, cosine = compare(a[tile_a], b[tile_b], threshold)
            i, j = tile_a[i], tile_b[j]
            if same:  # each pair once, and none of a vector with itself
                keep = i < j if tile_a is tile_b else i != j
                i, j, cosine = i[keep], j[keep], cosine[keep]
            sure = cosine >= threshold + SLACK
            lows.append(rows_a[i[~sure]])
            highs.append(rows_b[j[~sure]])
            i, j = i[sure], j[sure]
            np.add.at(count_a, i, copies_b[j])
            np.add.at(count_b, j, copies_a[i])
            for x, y in zip(ids_a[i].tolist(), ids_b[j].tolist(), strict=True):
                if x != y:
                    forest.union(x, y)
        nodes, count = (ids_a, count_a + count_b) if same else (np.concatenate([ids_a, ids_b]), np.concatenate([count_a, count_b]))
        nodes, count = nodes[count > 0], count[count > 0]
        roots = np.array([forest.find(x) for x in nodes.tolist()], dtype=np.int64)
        lows, highs = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (lows, highs))
        found = pd.DataFrame({"node": nodes, "links": count, "root": roots})
        left_open = pd.DataFrame({"low": lows, "high": highs})
        return pd.concat([found, left_open]).astype("Int64")[["node", "links", "root", "low", "high"]]

    return links


def _reaches(threshold: float):
    @F.arrow_udf("boolean")
    def reaches(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in parts:
            yield pa.array(cosines(a, b) >= threshold)

    return reaches


def _usable(vector: str) -> Column:
    v = F.col(f"`{vector}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def embedding_classes(
    vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD
) -> DataFrame:
    """(key, n_links, component_id, kept), one row per row of ``vectors``.

    Two vectors link when their labels are equal and not NULL, their lengths are
    equal and their cosine is ``threshold`` or more. ``n_links`` counts the other
    rows that a row links with directly; ``component_id`` is the smallest key that
    links reach. NULL, empty and zero vectors, ones with a NULL or non-finite
    component and rows without a label or key link with nothing and stand alone.
    Equal vectors are compared once. Rows that repeat a key are one node. Further
    columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ready(spark)
    rows = vectors.select(
        F.col(f"`{key}`").cast("bigint").alias("_id"), F.col(f"`{vector}`").alias("vector"), F.col(f"`{label}`").alias("label")
    )
    usable = F.coalesce(_usable("vector") & F.col("label").isNotNull() & F.col("_id").isNotNull(), F.lit(False))
    # A class of equal vectors by content; its node is its smallest key.
    content = F.when(usable, F.sha2(F.to_json(F.struct("label", "vector")).cast("binary"), 256))
    rows = settle(rows.withColumn("_content", content))
    used = rows.where("_content IS NOT NULL")
    if used.isEmpty():
        return _result(rows.withColumn("n_links", F.lit(0).cast("bigint")).withColumn("component", F.col("_id")), key)
    classes = settle(
        used.groupBy("_content").agg(
            F.min("_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"), F.first("label").alias("label")
        ).withColumn("row", F.monotonically_increasing_id())
    )
    counted = settle(_links(classes, _blocks(_turned(classes)), threshold))
    connected = connected_components(counted.select(F.col("node").alias("a"), F.col("root").alias("b")))
    found = counted.groupBy("node").agg(F.sum("links").alias("n_links"))
    found = found.join(connected, "node", "left")
    # Rows of equal vectors share the result of their node.
    repeated = settle(classes.where("copies > 1").select("_content", "copies", F.col("node").alias("_node")))
    members = attach(rows, repeated, "_content").withColumn("node", F.coalesce("_node", "_id"))
    members = members.withColumn("copies", F.coalesce("copies", F.lit(1))).drop("_node")
    return _result(attach(members, settle(found), "node"), key)


def _result(rows: DataFrame, key: str) -> DataFrame:
    """Each vector's links count its own copies; unusable rows stand alone."""
    component = F.coalesce("component", "node") if "node" in rows.columns else F.col("component")
    # The comparison of a vector with itself isn't in the links, so its copies are added here.
    links = F.coalesce("n_links", F.lit(0)) + (F.col("copies") - 1 if "copies" in rows.columns else F.lit(0))
    out = rows.withColumn("_component", component)
    return out.select(
        F.col("_id").alias(key),
        links.cast("bigint").alias("n_links"),
        F.col("_component").alias("component_id"),
        F.coalesce(F.col("_id") == F.col("_component"), F.lit(False)).alias("kept"),
    )


def _unit_vectors(width: int):
    @F.arrow_udf("array<double>")
    def unit(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in parts:
            out = np.zeros((len(vectors), width))
            for k, v in enumerate(vectors):
                x = np.asarray(v.values, dtype=float)
                x = x / np.abs(x).max()  # so that squares neither overflow nor vanish
                # Shorter vectors are filled up with zeros; they are in groups of their own.
                out[k, : len(x)] = x / np.sqrt(x @ x)
            yield pa.FixedSizeListArray.from_arrays(out.ravel(), width).cast(pa.list_(pa.float64()))

    return unit


def _turned(classes: DataFrame) -> DataFrame:
    """Unit vectors on the principal axes of all of them, in falling order of variance."""
    width = classes.agg(F.max(F.size("vector"))).first()[0]
    unit = classes.withColumn("_unit", array_to_vector(_unit_vectors(width)("vector")))
    group = F.concat_ws(":", F.col("label").cast("string"), F.size("vector").cast("string"))
    if is_small(classes, 1):  # a single row has no covariance
        return unit.withColumn("turned", vector_to_array("_unit")).drop("_unit").withColumn("group", group)
    axes = PCA(k=width, inputCol="_unit", outputCol="_turned").fit(unit)
    turned = axes.transform(unit).withColumn("turned", vector_to_array("_turned")).drop("_unit", "_turned")
    return turned.withColumn("group", group)


def _blocks(turned: DataFrame) -> DataFrame:
    """Blocks of a group: consecutive vectors on the first axis."""
    placed = group_position(turned.drop("vector"), "group", F.col("turned")[0], F.col("row"))
    rows = F.greatest(F.lit(TILE), F.floor(F.lit(BLOCK_BYTES) / (F.size("turned") * 8)))
    return settle(placed.withColumn("block", F.floor((F.col("position") - 1) / rows).cast("int")).drop("position", "group_size"))


def _links(classes: DataFrame, blocks: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root) by pair of blocks that may hold a pair within the threshold."""
    reach = max(0.0, 2 - 2 * threshold) + SLACK
    axes = range(AXES)
    ranges = [f(F.try_element_at("turned", F.lit(d + 1))).alias(f"{n}{d}") for d in axes for n, f in (("lo", F.min), ("hi", F.max))]
    box = settle(blocks.groupBy("group", "block").agg(*ranges))
    other = box.select(*[F.col(c).alias(f"_{c}") for c in box.columns])
    # Axes that a short vector lacks add nothing.
    gaps = [F.greatest(F.lit(0.0), F.col(f"lo{d}") - F.col(f"_hi{d}"), F.col(f"_lo{d}") - F.col(f"hi{d}")) for d in axes]
    near = sum((g * g for g in gaps), F.lit(0.0)) <= reach
    pairs = box.join(other, (F.col("group") == F.col("_group")) & (F.col("block") <= F.col("_block")) & near)
    ends = F.when(F.col("block") == F.col("_block"), F.array(F.struct(F.col("block").alias("b"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("block").alias("b"), F.lit(0).alias("side")), F.struct(F.col("_block").alias("b"), F.lit(1).alias("side")))
    )
    plan = pairs.select("group", F.col("block").alias("first"), F.col("_block").alias("second"), F.explode(ends).alias("e"))
    plan = plan.select("group", "first", "second", F.col("e.b").alias("block"), "e.side")
    units = blocks.select("group", "block", "row", "node", "copies", "turned").join(plan, ["group", "block"])
    # A unit holds two blocks at most.
    schema = "node bigint, links bigint, root bigint, low bigint, high bigint"
    found = settle(units.groupBy("group", "first", "second").applyInPandas(_compare_blocks(threshold), schema))
    sure = found.where("low IS NULL").select("node", "links", "root")
    undecided = found.where("low IS NOT NULL").select("low", "high")
    if undecided.isEmpty():
        return sure
    for side in ("low", "high"):
        ends = [F.col(c).alias(f"{side}_{c}") for c in ("node", "copies", "vector")]
        undecided = attach(settle(undecided), settle(classes.select(F.col("row").alias(side), *ends)), side)
    linked = undecided.where(_reaches(threshold)("low_vector", "high_vector"))
    ways = [
        F.struct(F.col(f"{x}_node").alias("node"), F.col(f"{y}_copies").alias("links"), F.least("low_node", "high_node").alias("root"))
        for x, y in (("low", "high"), ("high", "low"))
    ]
    return sure.unionByName(linked.select(F.explode(F.array(*ways)).alias("w")).select("w.*"))


CHECK = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS c FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id,
  vec_id <= coalesce(c, vec_id) AS kept FROM v LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""


@query("op5_embedding_duplicates", CHECK)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of embeddings of one label with a cosine of 0.93 or more."""
    return embedding_classes(table(spark, folder, "embeddings"))

