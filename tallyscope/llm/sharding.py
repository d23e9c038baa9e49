"""Operator 2: contiguous shards of near equal bytes.

Rows are range-partitioned by their order and settled once with running byte and
row counts inside each partition. The totals of the partitions (one row each) give
every partition its global start; equal byte targets then cut the shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyscope.functions.groups import one_row
from tallyscope.llm.common import query, ready, table
from tallyscope.session import settle


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes of a text and one for its end; a missing text counts as empty."""
    return (F.coalesce(F.octet_length(f"`{text}`"), F.lit(0)) + 1).cast("bigint")


def shard_by_bytes(
    df: DataFrame, shards: int, order: list[str], size: Column, *, shard: str = "shard", slot: str = "slot"
) -> DataFrame:
    """Add the shard (0 .. ``shards`` - 1) and the position inside it (from 0).

    Rows keep the order of the columns ``order`` (NULL first; rows that are equal
    in them keep the order in which Spark reads them). A row belongs to the shard
    in which its first byte falls, so shards differ by one row's size at most and
    no row is left out. ``size`` must be positive. An empty table gives an empty
    result, and with fewer rows than shards some shards have none. Columns called
    ``shard`` or ``slot`` are replaced, all others stay.
    """
    ready(df.sparkSession)

    @F.arrow_udf("bigint")
    def running(sizes: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen = 0
        for part in sizes:
            x = part.to_numpy(zero_copy_only=False).astype(np.int64)
            upto = seen + np.cumsum(x)
            seen = int(upto[-1]) if len(upto) else seen
            yield pa.array(upto - x)

    kept = [c for c in df.columns if c not in (shard, slot)]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], size.alias("_size"))
    # The read position splits rows that are equal in the order.
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in order]
    rows = rows.withColumn("_read", F.monotonically_increasing_id())
    placed = (
        rows.repartitionByRange(*keys, F.col("_read"))
        .sortWithinPartitions(*keys, F.col("_read"))
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_before", running("_size"))
        .withColumn("_part", F.shiftright("_id", 33))
        .withColumn("_row", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_read", "_id")
    )
    placed = settle(placed)
    totals = placed.groupBy("_part").agg(F.sum("_size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: a proven bound for the broadcast.
    starts = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_first_byte"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_first_row"),
    )
    total = one_row(placed.agg(F.sum("_size").alias("bytes")))["bytes"]
    start = (F.col("_first_byte") + F.col("_before")).cast("decimal(38,0)")
    cut = F.floor(start * shards / total.cast("decimal(20,0)")).cast("int")
    located = (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(shard, F.least(cut, F.lit(shards - 1)))
        .withColumn("_at", F.col("_first_row") + F.col("_row"))
    )
    # One row per shard.
    firsts = located.groupBy(shard).agg(F.min("_at").alias("_first"))
    out = located.join(F.broadcast(firsts), shard)
    return out.select(*[F.col(f"`{c}`") for c in kept], shard, (F.col("_at") - F.col("_first")).alias(slot))


SHARDS = 8

# The checksum in SQL: the usual table of 256 remainders, then byte by byte.
CHECK = f"""
WITH RECURSIVE t AS (SELECT i AS b, i AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM t WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS c FROM t WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size FROM documents),
bytes AS (SELECT doc_id, size, list_transform(regexp_extract_all(hex(encode(text)), '..'),
  lambda x: CAST('0x' || x AS BIGINT)) AS b FROM d),
sums AS (SELECT doc_id, size, xor(list_reduce(b, lambda a, x: xor(a >> 8, c[(xor(a, x) & 255) + 1]), 4294967295),
  4294967295) AS text_crc32 FROM bytes, crc),
s AS (SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS start, sum(size) OVER () AS total FROM sums),
p AS (SELECT doc_id, size, text_crc32, CAST(start * {SHARDS} // total AS INTEGER) AS shard FROM s)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p
"""


@query("op2_shards", CHECK)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in eight shards, in the order of their ids."""
    docs = table(spark, folder, "documents").select(
        "doc_id", text_size().alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32")
    )
    out = shard_by_bytes(docs, SHARDS, ["doc_id", "size", "text_crc32"], F.col("size"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
