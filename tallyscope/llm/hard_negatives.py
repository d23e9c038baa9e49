"""Operator 13: hard negatives for embeddings by a vertical (BOND) scan.

Rows are packed into blocks that hold one array per dimension. For an anchor the
dimensions of a block are read in falling order of the anchor's magnitude. After a
few of them, the least and the most that the others can still add bound every
score, and rows that can no longer be among the best of a window leave the bitmap
of candidates. What is left at the end has exact scores. Every block gives its best
rows of each window, so few rows per anchor are ranked over all blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions.groups import top_k
from tallyscope.llm.common import lean, query, ready, table
from tallyscope.session import settle

POSITIVES = 5
NEGATIVES = 10
#: A negative has this many hundredths of the positive's score, both included.
LOW, HIGH = 30, 90
#: Components are multiplied by this and rounded down.
SCALE = 256
ANCHOR_EVERY = 100
#: Rows of a block. Small tables get smaller blocks, for more tasks.
BLOCK_ROWS, SMALL_BLOCK_ROWS, SMALL_BLOCKS = 65_536, 4_096, 32
#: Dimensions read between two looks at the bounds.
STEP = 8

_LONG = 2**63 - 1
_PACKED = "block int, width int, kind string, ids binary, labels binary, columns binary, anchors binary"


def _narrow(columns: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest type that holds them."""
    low, high = (int(columns.min()), int(columns.max())) if columns.size else (0, 0)
    for kind in (np.int16, np.int32):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return columns.astype(kind)
    return columns


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per (block, width) from rows that are sorted by them and by id.

    Of rows that repeat an id, the first (by label and vector) counts.
    """
    def finish(key: tuple[int, int], ids: list, labels: list, vectors: list) -> pa.RecordBatch:
        block, width = key
        known = np.array(ids, dtype=np.int64)
        rows = np.concatenate(vectors).reshape(len(ids), width)
        columns = _narrow(np.ascontiguousarray(rows.T))
        anchor = known % ANCHOR_EVERY == 0
        out = {
            "block": [block], "width": [width], "kind": [columns.dtype.str], "ids": [known.tobytes()],
            "labels": [np.array(labels, dtype=np.int64).tobytes()], "columns": [columns.tobytes()],
            "anchors": [np.flatnonzero(anchor).astype(np.int32).tobytes()],
        }
        return pa.RecordBatch.from_pydict(out, schema=_PACKED_SCHEMA)

    now, ids, labels, vectors = None, [], [], []
    for batch in batches:
        values = batch.column(4)
        flat, cuts = values.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *batch.column(1).to_pylist()])
        for at, (block, width, key, label) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True)):
            if now != (block, width):
                if ids:
                    yield finish(now, ids, labels, vectors)
                now, ids, labels, vectors = (block, width), [], [], []
            if not ids or ids[-1] != key:
                ids.append(key)
                labels.append(label)
                vectors.append(flat[cuts[at] : cuts[at + 1]])
    if ids:
        yield finish(now, ids, labels, vectors)


_PACKED_SCHEMA = pa.schema(
    [("block", pa.int32()), ("width", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("labels", pa.binary()),
     ("columns", pa.binary()), ("anchors", pa.binary())]
)


class Block:
    """The rows of a block: ids, labels and one array per dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray):
        self.ids, self.labels = ids, labels
        self.low = columns.min(axis=1) if columns.size else np.zeros(len(columns), dtype=np.int64)
        self.high = columns.max(axis=1) if columns.size else np.zeros(len(columns), dtype=np.int64)
        self.most = np.maximum(np.abs(self.low.astype(float)), np.abs(self.high.astype(float)))
        self.whole, self.columns = columns, columns.astype(np.float64)

    def scan(self, anchor: np.ndarray, alive: np.ndarray, narrow) -> tuple[np.ndarray, np.ndarray]:
        """Positions and exact scores of the rows that ``narrow`` leaves.

        ``alive`` holds positions. ``narrow(scores, least, most)`` is given what the
        rows have so far and what the other dimensions can add at least and at most.
        """
        columns, low, high = self.columns, self.low, self.high
        if float(np.abs(anchor.astype(float)) @ self.most) >= 2.0**52:  # doubles would round: Python's whole numbers
            columns, low, high, anchor = (x.astype(object) for x in (self.whole, low, high, anchor))
        else:
            anchor = anchor.astype(np.float64)
        order = np.argsort(-np.abs(anchor.astype(float)), kind="stable")
        ends = np.stack([anchor[order] * low[order], anchor[order] * high[order]])
        least, most = ends.min(axis=0), ends.max(axis=0)
        scores = np.zeros(len(alive), dtype=anchor.dtype)
        for k in range(0, len(order), STEP):
            read = order[k : k + STEP]
            # Without losses so far, whole arrays are read; then only the candidates.
            held = columns[read] if len(alive) == len(self.ids) else columns[np.ix_(read, alive)]
            scores = scores + anchor[read] @ held
            keep = narrow(scores, least[k + STEP :].sum(), most[k + STEP :].sum())
            if not keep.all():
                alive, scores = alive[keep], scores[keep]
            if not len(alive):
                break
        return alive, scores


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties by smaller id."""
    return np.lexsort((ids, -scores))[:k]


def nearest(block: Block, key: int, label: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k other rows of the label with the highest scores, and these."""

    def narrow(scores: np.ndarray, least, most) -> np.ndarray:
        if len(scores) <= k:
            return np.ones(len(scores), dtype=bool)
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        return (scores + most) >= kth + least

    alive, scores = block.scan(anchor, np.flatnonzero((block.labels == label) & (block.ids != key)), narrow)
    first = best(block.ids[alive], scores, k)
    return alive[first], scores[first]


def in_windows(
    block: Block, label: int, anchor: np.ndarray, positives: list[int], k: int, low: int, high: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every positive score the k best rows of other labels in its window, and their scores."""
    windows = [(-(-low * p // 100), high * p // 100) for p in positives]
    real = sorted({w for w in windows if w[0] <= w[1]})

    def narrow(scores: np.ndarray, least, most) -> np.ndarray:
        upper, lower = scores + most, scores + least
        keep = np.zeros(len(scores), dtype=bool)
        for a, b in real:
            sure = lower[(lower >= a) & (upper <= b)]
            floor = np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) >= k else a
            keep |= (upper >= floor) & (lower <= b)
        return keep

    alive, scores = np.zeros(0, dtype=np.int64), np.zeros(0)
    if real:
        alive, scores = block.scan(anchor, np.flatnonzero(block.labels != label), narrow)
    out = []
    for a, b in windows:
        inside = np.flatnonzero((scores >= a) & (scores <= b))
        first = inside[best(block.ids[alive[inside]], scores[inside], k)]
        out.append((alive[first], scores[first]))
    return out


def _whole(scores: np.ndarray) -> list[int]:
    return [max(-_LONG - 1, min(_LONG, int(s))) for s in scores]


def _arrays(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[prefix + "ids"], dtype=np.int64)
    columns = np.frombuffer(row[prefix + "columns"], dtype=row[prefix + "kind"]).reshape(row["width"], len(ids))
    return ids, np.frombuffer(row[prefix + "labels"], dtype=np.int64), columns


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Block]]:
    """Rows of the plan with their block, which is built once for consecutive rows."""
    now, block = None, None
    for batch in batches:
        for k in range(batch.num_rows):
            row = {n: c[k].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
            if now != (row["block"], row["width"]):
                now, block = (row["block"], row["width"]), Block(*_arrays(row))
            yield row, block


def _positive_rows(k: int):
    @lean
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _units(batches):
            ids, labels, rows = _arrays(row, "a_")
            out: list[tuple] = []
            for key, label, anchor in zip(ids.tolist(), labels.tolist(), rows.T, strict=True):
                at, scores = nearest(block, key, label, anchor, k)
                out += [(row["pack"], row["width"], key, i, s) for i, s in zip(block.ids[at].tolist(), _whole(scores), strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(_POSITIVE.names, r, strict=True)) for r in out], schema=_POSITIVE)

    return find


_POSITIVE = pa.schema([("pack", pa.int32()), ("width", pa.int32()), *[(n, pa.int64()) for n in ("anchor_id", "positive_id", "positive_score")]])


def _negative_rows(k: int, low: int, high: int):
    @lean
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _units(batches):
            ids, labels, rows = _arrays(row, "a_")
            wanted: dict[int, list] = {}
            for p in row["positives"]:
                wanted.setdefault(p["anchor_id"], []).append((p["positive_id"], p["positive_score"]))
            out: list[tuple] = []
            for key, label, anchor in zip(ids.tolist(), labels.tolist(), rows.T, strict=True):
                pairs = wanted.get(key, [])
                found = in_windows(block, label, anchor, [s for _, s in pairs], k, low, high) if pairs else []
                for (positive, score), (at, scores) in zip(pairs, found, strict=True):
                    out += [(key, positive, i, score, s) for i, s in zip(block.ids[at].tolist(), _whole(scores), strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(_NEGATIVE.names, r, strict=True)) for r in out], schema=_NEGATIVE)

    return find


_NEGATIVE = pa.schema([(n, pa.int64()) for n in ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")])


def _anchor_packs(blocks: DataFrame) -> DataFrame:
    """The anchors of each block, packed like a block."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.frombuffer(row["anchors"], dtype=np.int32)
                if len(at):
                    ids, labels, columns = _arrays(row)
                    out = {
                        "pack": [row["block"]], "width": [row["width"]], "a_kind": [row["kind"]], "a_ids": [ids[at].tobytes()],
                        "a_labels": [labels[at].tobytes()], "a_columns": [np.ascontiguousarray(columns[:, at]).tobytes()],
                    }
                    yield pa.RecordBatch.from_pydict(out, schema=_ANCHORS)

    return blocks.mapInArrow(cut, "pack int, width int, a_kind string, a_ids binary, a_labels binary, a_columns binary")


_ANCHORS = pa.schema(
    [("pack", pa.int32()), ("width", pa.int32()), ("a_kind", pa.string()), ("a_ids", pa.binary()), ("a_labels", pa.binary()), ("a_columns", pa.binary())]
)


def packed_blocks(vectors: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, int]:
    """The rows that take part, in blocks by a hash of the id, and the number of blocks."""
    v = F.col(f"`{vector}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("bigint"))
    rows = vectors.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.select(
        F.col(f"`{key}`").cast("bigint").alias("_id"), F.col(f"`{label}`").cast("bigint").alias("_label"), whole.alias("_vector"), F.size(v).alias("width")
    )
    count = rows.count()
    blocks = max(math.ceil(count / BLOCK_ROWS), min(SMALL_BLOCKS, math.ceil(count / SMALL_BLOCK_ROWS)), 1)
    placed = rows.withColumn("block", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int"))
    placed = placed.select("block", "width", "_id", "_label", "_vector").repartition(blocks, "block")
    ordered = placed.sortWithinPartitions("block", "width", "_id", "_label", "_vector")
    return settle(ordered.mapInArrow(_pack, _PACKED)), blocks


def mine_hard_negatives(
    vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose key is divisible by ``ANCHOR_EVERY``, against all rows.
    A score is the inner product of components floor(256 x). An anchor's positives are
    its ``positives`` best other rows of its label; for each, the ``negatives`` best
    rows of other labels whose score is between ``low`` and ``high`` hundredths of the
    positive's follow; ties go by the smaller key. A positive without such rows has none.

    Rows with a NULL key, label or vector or a NULL or non-finite component take no part.
    Vectors meet only those of their length; empty ones score 0. Of rows that repeat a
    key the smallest by label and vector counts. Components and scores beyond a long
    are its ends. Further columns are ignored; an empty table gives an empty result.
    """
    ready(vectors.sparkSession)
    blocks, count = packed_blocks(vectors, key, vector, label)
    packs = settle(_anchor_packs(blocks))
    # Each pack of anchors, at most a hundredth of a block, goes to every block.
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("block")
    sides = blocks.drop("anchors")
    # By a shuffle: how large the repeated packs are isn't bounded.
    units = sides.join(packs.select("*", everywhere).hint("merge"), ["block", "width"])
    found = units.mapInArrow(_positive_rows(positives), "pack int, width int, anchor_id bigint, positive_id bigint, positive_score bigint")
    first = settle(top_k(found, ["anchor_id"], [F.desc("positive_score"), F.col("positive_id")], positives))
    # A pack's list holds so many positives per anchor at most.
    lists = first.groupBy("pack", "width").agg(
        F.collect_list(F.struct("anchor_id", "positive_id", "positive_score")).alias("positives")
    )
    wanted = settle(packs.join(lists, ["pack", "width"]))
    units = sides.join(wanted.select("*", everywhere).hint("merge"), ["block", "width"])
    found = units.mapInArrow(
        _negative_rows(negatives, low, high), "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint"
    )
    ranked = top_k(found, ["anchor_id", "positive_id"], [F.desc("negative_score"), F.col("negative_id")], negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


CHECK = f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % {ANCHOR_EVERY} = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same
    AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= {NEGATIVES}
"""


@query("op13_hard_negatives", CHECK)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Ten negatives each for the five nearest rows of every hundredth embedding; each seventh row changes its label first."""
    rows = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", moved))
