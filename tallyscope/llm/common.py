"""What the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tallyscope.session import checkpoint_root

PACKAGE = __name__.split(".")[0]
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
_READY: set[str] = set()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register a query of (session, table folder), with its check SQL if there is one."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if check is not None:
            CHECKS[name] = check
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Make sure that the executors can import this package.

    A job started with the package on its path (``--py-files``, an installed
    wheel, PYTHONPATH) needs nothing. Otherwise Spark ships a zip of the source.
    """
    # Rows here are whole texts: small batches bound what a worker holds at a time.
    for setting, most in BATCH.items():
        if int(spark.conf.get(setting, str(most + 1))) > most:
            spark.conf.set(setting, str(most))
    context = spark.sparkContext
    if context.applicationId in _READY:
        return

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            try:
                __import__(f"{package}.llm.common")
                yield pa.RecordBatch.from_pydict({"found": pa.array([True] * batch.num_rows)})
            except ImportError:
                yield pa.RecordBatch.from_pydict({"found": pa.array([False] * batch.num_rows)})

    package = PACKAGE
    found.__module__ = "__main__"  # this one function travels by value
    if not spark.range(1).mapInArrow(found, "found boolean").first()[0]:
        root = Path(__file__).resolve().parents[1]
        # Executors that start later fetch it too, so it stays in the shared folder.
        shared = f"{checkpoint_root(spark)}/code/{package}.zip"
        with tempfile.TemporaryDirectory() as folder:
            with zipfile.ZipFile(f"{folder}/{package}.zip", "w") as z:
                for f in root.rglob("*.py"):
                    z.write(f, f.relative_to(root.parent))
            path = context._jvm.org.apache.hadoop.fs.Path
            target = path(shared)
            store = target.getFileSystem(context._jsc.hadoopConfiguration())
            store.copyFromLocalFile(False, True, path(f"file://{folder}/{package}.zip"), target)
        context.addPyFile(shared)
    _READY.add(context.applicationId)


def sample_rows(df: DataFrame, by: list[str], size: int, salt: str = "sample") -> list[Row]:
    """Up to ``size`` rows of the smallest hashes of the columns ``by``, on the driver; ties by all columns.

    The hashes are cut at about twice the share that is wanted before any row moves,
    so all tasks together send about ``2 * size`` rows, however many tasks there are.
    """
    count = df.count()
    place = F.xxhash64(F.lit(salt), *[F.col(f"`{c}`").cast("string") for c in by])
    kept = df.withColumn("_place", place)
    if count > 2 * size:
        # A hash is even over the range of a long.
        kept = kept.where(F.col("_place") < int(-(1 << 63) + (1 << 64) * (2 * size / count)))
    return kept.orderBy("_place", *[F.col(f"`{c}`") for c in df.columns]).limit(size).collect()


def lean(batches_to_batches: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that hands free memory back to the system when a task ends.

    Spark keeps a worker for later tasks; without this each would hold on to the
    most that any task of any earlier stage needed.
    """

    @wraps(batches_to_batches)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from batches_to_batches(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return run


def byte_view(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; NULL is empty."""
    rows = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(rows.buffers()[1], dtype=np.int64)[rows.offset : rows.offset + len(rows) + 1]
    data, low, high = rows.buffers()[2], int(offsets[0]), int(offsets[-1])
    return (memoryview(data)[low:high] if data is not None and high > low else memoryview(b"")), offsets - low


#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers; modulo 2^64 on purpose."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))
