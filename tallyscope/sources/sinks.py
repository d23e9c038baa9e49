"""Writing tables. Every writer returns the frame it would read back."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.operators.store import storable_features, upsert
from tallyscope.sources.scans import conform, label_layout


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def write_once(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Write a result unless it is there complete, so a restarted run goes on.

    What a broken run left, a folder without the mark of success, is replaced.
    """
    if not _exists(df.sparkSession, f"{path}/_SUCCESS"):
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def _order(version: str) -> list[tuple]:
    """Versions compare by their numbers, so 10 follows 9."""
    return [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.split(r"(\d+)", version) if x]


def upsert_features(df: DataFrame, path: str, version: str) -> DataFrame:
    """Replace the rows of the given accounts in the feature table.

    A table is a folder of versions; the new version is complete before it is
    read, and the old one stays for running readers. An empty input changes
    nothing.
    """
    spark = df.sparkSession
    current = latest_version(spark, path)
    if df.isEmpty():
        return spark.read.parquet(current) if current else df
    if current is not None and _order(version) <= _order(current.rsplit("version=", 1)[-1]):
        raise ValueError(f"version {version} is not newer than {current}")
    merged = storable_features(df) if current is None else upsert(
        spark.read.parquet(current), storable_features(df)
    )
    # An unfinished folder of this version is what a broken run left.
    merged.write.mode("overwrite").parquet(f"{path}/version={version}")
    return spark.read.parquet(f"{path}/version={version}")


def latest_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the newest finished version, by number."""
    if not _exists(spark, path):
        return None
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    done = [n for n in names if n.startswith("version=") and _exists(spark, f"{path}/{n}/_SUCCESS")]
    newest = max(done, key=lambda n: _order(n.removeprefix("version=")), default=None)
    return f"{path}/{newest}" if newest else None


def append_features(df: DataFrame, path: str) -> DataFrame:
    """Checked append to the feature table."""
    storable_features(df).write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)


def replace_labels(df: DataFrame, path: str) -> DataFrame:
    """Full replacement of the label table."""
    label_layout(df).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def load_raw(df: DataFrame, table: str, path: str) -> DataFrame:
    """Full load of a raw table, files sorted for reads by sender and time.

    The rows are range-partitioned by sender and time, so a sender's rows lie
    together and a hot sender fills several files.
    """
    order = ["from_address", "block_timestamp"]
    ready = conform(df, table).repartitionByRange(*order).sortWithinPartitions(*order)
    ready.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def save_labels(df: DataFrame, path: str) -> DataFrame:
    missing = {"address", "label"} - set(df.columns)
    if missing:
        raise ValueError(f"label columns missing: {sorted(missing)}")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def profile_documents(profile: DataFrame) -> DataFrame:
    """One nested document per cluster: feature -> rounded statistics."""
    stats = F.struct(
        F.round("mean", 6).alias("mean"),
        F.round("global_mean", 6).alias("global_mean"),
        F.round("ratio_to_global", 3).alias("ratio"),
        F.round("z_score", 3).alias("z_score"),
    )
    name = F.when(F.col("cluster") == -1, "noise").otherwise(
        F.concat(F.lit("cluster_"), F.col("cluster").cast("string"))
    )
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature", stats.alias("stats")))))
    # A cluster has one row per feature, so the list is short.
    return profile.groupBy("cluster", "size", "pct").agg(entries.alias("features")).select(
        name.alias("cluster"),
        "size",
        F.round("pct", 2).alias("pct"),
        "features",
        F.lit(None).cast("string").alias("suggested_label"),
    )


def write_json(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def write_csv(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").csv(path, header=True)
    return df.sparkSession.read.schema(df.schema).csv(path, header=True)
