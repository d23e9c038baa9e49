"""Tables that grow by batches: appended rows, removed keys, purges.

A table is a folder of numbered batches and nothing is ever overwritten, so a
running reader keeps its files. A batch holds rows, keys to remove, or the whole
table anew; the last kind names the batches that it replaces, so a batch that is
appended meanwhile is not lost. A batch counts once its rows are complete
(``_SUCCESS``); what a broken run left is ignored and its number not used again.

Appends and removals may run side by side; replace (purge, flush) from one job at
a time.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions.groups import attach
from tallyscope.operators.labels import assert_labels, label_cluster, latest_labels
from tallyscope.operators.store import current_texts, unexpired
from tallyscope.schemas import KEY

ROWS, KEYS, WHOLE = "rows", "keys", "whole"
_NAME = re.compile(r"batch-(\d+)-(rows|keys|whole)-[0-9a-f]+")


@dataclass(frozen=True)
class Batch:
    number: int
    kind: str
    path: str
    done: bool


def _folders(spark: SparkSession, path: str) -> list[Batch]:
    """All batches, finished or not; one entry per write, not per row or file."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    found = []
    for status in fs.listStatus(where):
        name = _NAME.fullmatch(status.getPath().getName())
        if name:
            folder = f"{path}/{name[0]}"
            done = fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/data/_SUCCESS"))
            found.append(Batch(int(name[1]), name[2], folder, done))
    return sorted(found, key=lambda b: (b.number, b.path))


def _live(spark: SparkSession, path: str) -> list[Batch]:
    """Finished batches that no later one replaces."""
    done = [b for b in _folders(spark, path) if b.done]
    replaced: set[str] = set()
    for batch in done:
        if batch.kind == WHOLE:
            replaced |= {r["value"] for r in spark.read.text(f"{batch.path}/replaced").collect()}
    return [b for b in done if b.path.rsplit("/", 1)[-1] not in replaced]


def _write(df: DataFrame, path: str, kind: str, replaced: list[Batch] | None = None) -> None:
    spark = df.sparkSession
    number = max((b.number for b in _folders(spark, path)), default=0) + 1
    folder = f"{path}/batch-{number:09d}-{kind}-{uuid.uuid4().hex}"
    if replaced is not None:
        names = [(b.path.rsplit("/", 1)[-1],) for b in replaced]
        spark.createDataFrame(names, "value string").coalesce(1).write.text(f"{folder}/replaced")
    df.write.parquet(f"{folder}/data")


def append(df: DataFrame, path: str) -> None:
    """Add rows; an empty frame adds none."""
    _write(df, path, ROWS)


def remove(keys: DataFrame, path: str, key: str = KEY) -> None:
    """Remove all rows of the given keys that were written before; NULL removes nothing."""
    ids = keys.select(F.col(keys.columns[0]).alias(key)).where(F.col(key).isNotNull())
    _write(ids.distinct(), path, KEYS)


def _merged(spark: SparkSession, batches: list[Batch], schema: str, key: str) -> DataFrame:
    frames, gone = [], []
    for batch in batches:
        data = f"{batch.path}/data"
        if batch.kind == KEYS:
            gone.append(spark.read.parquet(data).withColumn("_gone", F.lit(batch.number)))
        elif batch.kind == WHOLE:
            frames.append(spark.read.schema(f"{schema}, _batch int").parquet(data))
        else:
            frames.append(spark.read.schema(schema).parquet(data).withColumn("_batch", F.lit(batch.number)))
    if not frames:
        return spark.createDataFrame([], f"{schema}, _batch int")
    rows = reduce(DataFrame.unionByName, frames)
    if gone:
        last = reduce(DataFrame.unionByName, gone).groupBy(key).agg(F.max("_gone").alias("_gone"))
        rows = attach(rows, last, key)
        rows = rows.where(F.col("_gone").isNull() | (F.col("_batch") > F.col("_gone"))).drop("_gone")
    return rows


def read(spark: SparkSession, path: str, schema: str, key: str = KEY) -> DataFrame:
    """All rows that were appended and not removed since; no folder means no rows."""
    return _merged(spark, _live(spark, path), schema, key).drop("_batch")


def replace(spark: SparkSession, path: str, schema: str, change, key: str = KEY) -> None:
    """Write ``change(table)`` as the whole table anew, in place of the batches read.

    Rows keep the number of their batch, so a removal that ends later still finds them;
    ``change`` may only drop rows or alter values.
    """
    seen = _live(spark, path)
    _write(change(_merged(spark, seen, schema, key)), path, WHOLE, replaced=seen)


# ------------------------------------------------------------------ labels

LABELS = (
    "address string, label string, source string, confidence double, evidence string, "
    "asserted_at timestamp, wallet_address string"
)


def append_labels(assertions: DataFrame, path: str) -> None:
    """Append label assertions; addresses are lower-cased, confidence cut to 0..1."""
    append(assert_labels(assertions), path)


def append_cluster_label(members: DataFrame, cluster: int, path: str, **assertion) -> None:
    """Append one assertion per member of a cluster (see ``label_cluster``)."""
    append(label_cluster(members, cluster, **assertion), path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """The newest assertion per address."""
    return latest_labels(read(spark, path, LABELS, "address"))


# ------------------------------------------------------------------- texts

TEXTS = (
    "wallet_address string, narrative string, cluster_id int, created_at timestamp, expires_at timestamp"
)


def append_texts(entries: DataFrame, path: str) -> None:
    append(entries.select(KEY, "narrative", "cluster_id", "created_at", "expires_at"), path)


def remove_texts(accounts: DataFrame, path: str) -> None:
    """Forget the texts of the given accounts; later texts of theirs stay."""
    remove(accounts, path)


def purge_texts(spark: SparkSession, path: str, as_of: str) -> None:
    """Drop what has expired at ``as_of`` and fold all batches into one."""
    replace(spark, path, TEXTS, lambda table: unexpired(table, as_of))


def flush_texts(spark: SparkSession, path: str) -> None:
    """Forget all texts."""
    replace(spark, path, TEXTS, lambda table: table.limit(0))


def read_texts(spark: SparkSession, path: str, as_of: str | None = None) -> DataFrame:
    """All texts, or with ``as_of`` the newest valid one per account."""
    table = read(spark, path, TEXTS)
    return table if as_of is None else current_texts(table, as_of)
