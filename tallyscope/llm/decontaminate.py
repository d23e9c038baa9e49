"""Operator 1: find and remove benchmark text in documents.

The distinct word windows of the benchmark are a broadcast hash set. A document's
words become numbers in the benchmark's vocabulary, so a window can only start
where all its words are known; its hash is then looked up and the hit verified
word by word. A benchmark over ``BLOCK_BYTES`` is taken in blocks, one pass each,
so what is broadcast stays bounded.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.common import LOWER, byte_view, lean, query, ready, table
from tallyscope.session import settle

WINDOW = 13
BLOCK_BYTES = 8 << 20
CHUNK_WORDS = 200_000

#: Lower case, and every byte that no word holds as a space.
WORDS = bytes(LOWER[b] if chr(b).isalnum() or b >= 0x80 else 32 for b in range(256))
FOUND = "struct<n_words:bigint,spans:array<int>,items:array<string>>"


class WindowSet:
    """Distinct windows by length: word numbers, their hash and the items that hold them."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, text in items:
            words = text.translate(WORDS).split()
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            length = min(window, len(words))
            for i in range(len(words) - length + 1 if words else 0):
                held = by_length.setdefault(length, {}).setdefault(tuple(numbers[i : i + length]), set())
                if item is not None:
                    held.add(item)
        self.tables = []
        for length, windows in sorted(by_length.items()):
            rows = np.array(list(windows), dtype=np.int32).reshape(len(windows), length)
            held = [sorted(s) for s in windows.values()]
            seed = 1
            while True:  # distinct windows need distinct hashes
                factors = np.random.default_rng(seed).integers(1, 1 << 63, length, dtype=np.uint64) | np.uint64(1)
                hashes = (rows.astype(np.uint64) * factors).sum(1, dtype=np.uint64)
                if len(np.unique(hashes)) == len(hashes):
                    break
                seed += 1
            order = np.argsort(hashes)
            self.tables.append((length, factors, hashes[order], rows[order], [held[i] for i in order]))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Vocabulary numbers, 0 for unknown words, and a closing 0."""
        out = np.zeros(len(words) + 1, dtype=np.int32)
        out[:-1] = np.fromiter(map(self.vocabulary.get, words, repeat(0)), dtype=np.int32, count=len(words))
        return out

    def hits(self, numbers: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, list[list[str]]]]:
        """(starts, length, rows of the table, items by row) of verified windows."""
        known = np.zeros(len(numbers) + 1, dtype=np.int64)
        np.cumsum(numbers > 0, out=known[1:])
        for length, factors, hashes, rows, held in self.tables:
            if len(numbers) < length:
                continue
            starts = np.flatnonzero(known[length:] - known[:-length] == length)
            value = np.zeros(len(starts), dtype=np.uint64)
            for j in range(length):
                value += numbers[starts + j].astype(np.uint64) * factors[j]
            at = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
            same = hashes[at] == value
            starts, at = starts[same], at[same]
            true = (numbers[starts[:, None] + np.arange(length)] == rows[at]).all(1)
            yield starts[true], length, at[true], held


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    """Sorted disjoint spans as a flat list of starts and ends."""
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _scan(windows: WindowSet, text: pa.Array, spans: list, items: list) -> pa.Array:
    data, offsets = byte_view(text)
    n_words, numbers, size, first = [], [], 0, 0
    spans, items = [s or [] for s in spans], [i or [] for i in items]

    def look(upto: int) -> None:
        if not numbers:
            return
        ends = np.cumsum([len(x) for x in numbers])
        for starts, length, at, held in windows.hits(np.concatenate(numbers)):
            docs = np.searchsorted(ends, starts, side="right")
            for doc in np.unique(docs):
                own = docs == doc
                base, k = int(ends[doc] - len(numbers[doc])), first + int(doc)
                marks = [(int(s) - base, int(s) - base + length) for s in starts[own]]
                spans[k] = _merged([*zip(spans[k][::2], spans[k][1::2], strict=True), *marks])
                items[k] = sorted({*items[k], *(i for w in np.unique(at[own]) for i in held[w])})

    for k in range(len(offsets) - 1):
        words = bytes(data[offsets[k] : offsets[k + 1]]).translate(WORDS).split()
        n_words.append(len(words))
        numbers.append(windows.numbers(words))
        size += len(words)
        if size >= CHUNK_WORDS:
            look(k + 1)
            numbers, size, first = [], 0, k + 1
    look(len(offsets) - 1)
    return pa.StructArray.from_arrays(
        [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
        ["n_words", "spans", "items"],
    )


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, math.ceil(size / block_bytes))
    for b in range(count):
        # By hash, hence near block_bytes each.
        own = rows if count == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == b)
        yield [(r.item, r.text.encode()) for r in own.toLocalIterator()]


def _scanner(shared: Broadcast):
    @F.arrow_udf(FOUND)
    @lean
    def scan(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans, ids in parts:
            yield _scan(shared.value, texts, spans.to_pylist(), ids.to_pylist())

    return scan


def find_benchmark_text(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    name: str = "found",
) -> DataFrame:
    """Add a struct ``name``: the number of words, the hit word spans and the items.

    ``spans`` is a flat list of starts and ends (in words, disjoint, ascending);
    ``items`` are the ids, as sorted strings, of the items with a window in the
    text. NULL and empty texts have no words and no hits. An item without text
    hits nothing; one without id marks words but isn't listed. Equal windows
    count for each of their items, and rows that repeat give equal results. A
    column that is already called ``name`` is replaced, all others stay.
    """
    ready(docs.sparkSession)
    empty = F.lit(None).cast("array<int>"), F.lit(None).cast("array<string>")
    out, blocks = docs, 0
    for items in _blocks(benchmark, item, item_text, block_bytes):
        scan = _scanner(docs.sparkSession.sparkContext.broadcast(WindowSet(items, window)))
        if blocks:
            out = settle(out)
        before = (F.col(f"`{name}`.spans"), F.col(f"`{name}`.items")) if blocks else empty
        out = out.withColumn(name, scan(F.col(f"`{text}`"), *before))
        blocks += 1
    return out


def hit_words(name: str = "found"):
    """The number of words inside the spans."""
    places = F.sequence(F.lit(0), F.size(f"{name}.spans") - 2, F.lit(2))
    lengths = F.transform(places, lambda i: F.col(f"{name}.spans")[i + 1] - F.col(f"{name}.spans")[i])
    total = F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.when(F.size(f"{name}.spans") > 0, total).otherwise(F.lit(0).cast("bigint"))


def is_contaminated(name: str = "found"):
    """At least one word in twenty is benchmark text."""
    hits = hit_words(name)
    return (hits > 0) & (20 * hits >= F.col(f"{name}.n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, unchanged; empty ones stay."""
    name = "_benchmark_text"
    return find_benchmark_text(docs, benchmark, name=name, **options).where(~is_contaminated(name)).select(*[f"`{c}`" for c in docs.columns])


def cut_benchmark_text(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """All documents, their texts without the hit spans (from first to last hit word)."""
    name, words = "_benchmark_text", re.compile(rb"[0-9a-z\x80-\xff]+")

    @F.arrow_udf("string")
    def cut(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in parts:
            out = texts.to_pylist()
            for k, marks in enumerate(spans.to_pylist()):
                if marks:
                    raw = out[k].encode()
                    places = [m.span() for m in words.finditer(raw.translate(WORDS))]
                    kept, upto = [], 0
                    for start, end in zip(marks[::2], marks[1::2], strict=True):
                        kept.append(raw[upto : places[start][0]])
                        upto = places[end - 1][1]
                    out[k] = b"".join([*kept, raw[upto:]]).decode()
            yield pa.array(out, pa.string())

    found = find_benchmark_text(docs, benchmark, text=text, name=name, **options)
    shown = [cut(F.col(f"`{text}`"), F.col(f"{name}.spans")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return found.select(*shown)


_SPLIT = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

CHECK = f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SPLIT} AS w FROM benchmark),
b_at AS (SELECT item, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i
  FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS text FROM b_at),
d_at AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows)
  WHERE len(w) >= n),
hits AS (SELECT doc_id, i, n, item FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS text FROM d_at)
  JOIN windows USING (n, text)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op1_decontaminate", CHECK)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark text in every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = find_benchmark_text(docs, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "found.n_words",
        hit_words().alias("n_hit"),
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )
