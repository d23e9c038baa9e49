"""Reading tables: pruned scans, key filters, type normalisation, label files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.functions.groups import keep_keys
from tallyscope.operators.ledger import touching
from tallyscope.schemas import LABEL_COLUMNS, LABEL_TEXT_COLUMNS, RAW_LAYOUTS


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table with only the wanted columns."""
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def scan_touching(spark: SparkSession, path: str, columns: Sequence[str], accounts: DataFrame) -> DataFrame:
    """Rows with a wanted account on either side."""
    return touching(scan(spark, path, columns), accounts)


def scan_keyed(
    spark: SparkSession, path: str, columns: Sequence[str], key: str, values: DataFrame
) -> DataFrame:
    """Rows whose lower-cased ``key`` is wanted."""
    marked = scan(spark, path, columns).withColumn("_key", F.lower(key))
    return keep_keys(marked, values, "_key").drop("_key")


NUMERIC = (
    T.DecimalType,
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
)


def numbers_as_double(df: DataFrame) -> DataFrame:
    """Every numeric column as a double; other columns unchanged."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, NUMERIC) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _coerced(field: T.StructField, given: T.DataType) -> Column:
    value = F.col(field.name)
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(value.cast("string"), F.lit(""))
    if isinstance(field.dataType, T.TimestampType):
        return value.try_cast("timestamp")
    if isinstance(given, T.StringType):
        value = value.try_cast("double")
    if isinstance(given, T.BooleanType):
        value = value.cast("int")
    return F.coalesce(value.try_cast(field.dataType), F.lit(0).cast(field.dataType))


def conform(df: DataFrame, table: str) -> DataFrame:
    """A raw table in its stored layout.

    Known columns only; booleans become 0/1, what is no number or out of range
    becomes 0, what is no time becomes NULL, and missing text becomes empty.
    """
    if table not in RAW_LAYOUTS:
        raise ValueError(f"unknown table {table}; known are {sorted(RAW_LAYOUTS)}")
    given = {f.name: f.dataType for f in df.schema.fields}
    fields = [f for f in RAW_LAYOUTS[table].fields if f.name in given]
    return df.select(*[_coerced(f, given[f.name]).alias(f.name) for f in fields])


def label_layout(df: DataFrame) -> DataFrame:
    """Labels in their stored layout; absent columns and missing text filled."""
    filled = []
    for c in LABEL_COLUMNS:
        text = c in LABEL_TEXT_COLUMNS
        if c not in df.columns:
            filled.append((F.lit("") if text else F.lit(0.0)).alias(c))
        elif text:
            filled.append(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c))
        else:
            filled.append(F.col(c).cast("double").alias(c))
    return df.select(*filled)


def named_labels(df: DataFrame) -> DataFrame:
    """Labels as (wallet_address, label_name, ...), whatever names the file uses."""
    if "wallet_address" not in df.columns and "address" in df.columns:
        df = df.withColumn("wallet_address", F.col("address"))
    if "label" in df.columns and isinstance(df.schema["label"].dataType, T.StringType):
        df = df.withColumnRenamed("label", "label_name")
    return df


def read_labels(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Labels from Parquet, or from CSV with a header where a schema is given."""
    if schema is None:
        return named_labels(spark.read.parquet(path))
    return named_labels(spark.read.schema(schema).csv(path, header=True))
