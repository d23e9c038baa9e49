"""Operators 8 and 10: token counts by section, and token ids in compact binary files.

``Encoder`` gives exactly the ids and offsets of the tokenizers library for whole
texts. A byte-level tokenizer looks at each stretch from a space to the next on its
own, so equal stretches are encoded once and remembered by a worker; texts of any other kind
of tokenizer go to the library as they are.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyscope.llm.common import query, ready, table
from tallyscope.session import checkpoint_root, settle

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Pieces after which a worker forgets them, about 40 bytes each.
REMEMBERED = 1_000_000
SLICE_BYTES = 2 << 20
LIBRARY_BATCH = 4_096

#: A text of these only, without two of them side by side that white space or marks make one.
_PLAIN = re.compile(r"[\w ,.\n]*")
_NEIGHBOURS = ("  ", " \n", "\n ", "\n\n", " ,", " .", "\n,", "\n.", ",,", "..", ",.", ".,")
_RUN = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")
_MARK = re.compile(r"([A-Za-z])([!-&(-/:-@\[-`{-~])")


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_SEPARATORS = np.zeros(256, dtype=bool)
_SEPARATORS[[0x20, 0x2C, 0x2E, 0x0A]] = True


@cache
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        every = np.full(length, base, dtype=np.uint64)
        every[0] = 1
        out.append(np.cumprod(every, dtype=np.uint64))
    return out[0], out[1]


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every stretch of bytes, from one running sum over all of them."""
    power, inverse = _powers(1 << max(20, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return (sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` with these starts and sizes, one after the other."""
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


class Pieces:
    """Coded pieces in flat arrays, found by hash and checked by their bytes."""

    def __init__(self, kind: np.dtype):
        self.hashes, self.rows = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        self.bytes, self.byte_ends = np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
        self.ids, self.id_ends = np.empty(0, dtype=kind), np.zeros(1, dtype=np.int64)

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 for unknown ones."""
        if not len(self):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
        return np.where(self.hashes[at] == hashes, self.rows[at], -1)

    def add(self, hashes: np.ndarray, texts: list[bytes], ids: list[bytes]) -> None:
        """Further pieces in rising order of their hashes."""
        at = np.searchsorted(self.hashes, hashes)
        self.rows = np.insert(self.rows, at, len(self) + np.arange(len(hashes)))
        self.hashes = np.insert(self.hashes, at, hashes)
        width = self.ids.itemsize
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(texts), dtype=np.uint8)])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), dtype=self.ids.dtype)])
        self.byte_ends = np.concatenate([self.byte_ends, self.byte_ends[-1] + np.cumsum([len(t) for t in texts])])
        self.id_ends = np.concatenate([self.id_ends, self.id_ends[-1] + np.cumsum([len(i) // width for i in ids])])


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids and character spans of whole texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks in parallel
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        before = parts.get("pre_tokenizer") or {}
        added = {t["id"]: t["content"] for t in parts["added_tokens"]}
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"]) for t in parts["added_tokens"])
        # Then a space after a character that is no white space always begins a new stretch.
        self.by_stretch = (
            before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and not parts.get("normalizer")
            and not parts.get("truncation")
            and plain
        )
        size = self.library.get_vocab_size()
        self.kind = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        # A byte-level token is written with one character per byte.
        self.lengths = np.array(
            [len(added[i].encode()) if i in added else len(self.library.id_to_token(i) or "") for i in range(size)], dtype=np.int64
        )
        self.added = list(added.values())
        self.known = Pieces(self.kind)

    def _marked(self, text: str) -> tuple[int, str]:
        """How a text is cut into pieces that the tokenizer treats each for itself.

        0: before each space, comma, full stop and line feed, and after a line feed;
        1: where a NUL was put in; 2: not at all.
        """
        if _PLAIN.fullmatch(text) and "_" not in text and not any(x in text for x in _NEIGHBOURS):
            return 0, text  # words, and single marks and line feeds that follow a word
        if "\0" in text or any(x in text for x in self.added):
            return 2, text
        # Letters end before a mark (but an apostrophe), whatever follows.
        marked = _MARK.sub("\\1\0\\2", text)
        return 1, _CUT.sub("\0 ", marked) if _RUN.search(text) else marked.replace(" ", "\0 ")

    def _encode(self, new: list[str]) -> list[bytes]:
        """Ids of pieces. Those from a space to a character that is none go to the library many in one text."""
        encode, width = self.library.encode_batch_fast, self.kind.itemsize
        out: list[bytes] = [b""] * len(new)
        chained = [k for k, w in enumerate(new) if len(w) > 1 and w[0] == " " and not w[-1].isspace()]
        for k in range(0, len(chained), LIBRARY_BATCH):
            part = chained[k : k + LIBRARY_BATCH]
            words = [new[j] for j in part]
            ids = np.array(encode(["".join(words)], add_special_tokens=False)[0].ids, dtype=self.kind)
            ends = np.cumsum([len(w.encode()) for w in words])
            cuts = (width * np.searchsorted(np.cumsum(self.lengths[ids]), ends, side="right")).tolist()
            raw = ids.tobytes()
            for j, a, b in zip(part, [0, *cuts], cuts, strict=False):
                out[j] = raw[a:b]
        chosen = set(chained)
        single = [k for k in range(len(new)) if k not in chosen]
        for k in range(0, len(single), LIBRARY_BATCH):
            part = single[k : k + LIBRARY_BATCH]
            for j, e in zip(part, encode([new[j] for j in part], add_special_tokens=False), strict=True):
                out[j] = np.array(e.ids, dtype=self.kind).tobytes()
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in found]

    def _by_pieces(self, texts: list[str], plain: bool) -> list[bytes]:
        """The ids of texts that are cut in one of the two ways; every distinct piece is looked up once."""
        raw = [t.encode() for t in texts]
        text_ends = np.cumsum([len(r) for r in raw])
        joined = b"".join(raw)
        data = np.frombuffer(joined, dtype=np.uint8)
        if not len(data):
            return [b""] * len(texts)
        first = np.zeros(len(data) + 1, dtype=bool)
        first[0] = True
        first[text_ends] = True
        if plain:
            first[:-1] |= _SEPARATORS[data]
            first[1:] |= data == 0x0A
            bounds = np.flatnonzero(first)
            starts, ends = bounds[:-1], bounds[1:]
        else:
            first[1:] |= data == 0
            bounds = np.flatnonzero(first)
            starts, ends = bounds[:-1], bounds[1:]
            ends = ends - (data[ends - 1] == 0)  # without the mark itself
        sizes = ends - starts
        hashes, at, which = np.unique(piece_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.known = Pieces(self.kind)
        rows = self.known.find(hashes)
        # Equal hashes must mean equal bytes, here and with what is known.
        fine = (sizes[at][which] == sizes).all() and (gather(data, starts[at][which], sizes) == gather(data, starts, sizes)).all()
        hit = np.flatnonzero(rows >= 0)
        begin = self.known.byte_ends[rows[hit]]
        held = self.known.byte_ends[rows[hit] + 1] - begin
        fine = fine and (held == sizes[at[hit]]).all()
        if not (fine and (gather(self.known.bytes, begin, held) == gather(data, starts[at[hit]], held)).all()):
            return self._whole([t if plain else t.replace("\0", "") for t in texts])
        new = np.flatnonzero(rows < 0)
        if len(new):
            pieces = [joined[a:b] for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)]
            self.known.add(hashes[new], pieces, self._encode([p.decode() for p in pieces]))
            rows = self.known.find(hashes)
        row = rows[which]
        begin = self.known.id_ends[row]
        counts = self.known.id_ends[row + 1] - begin
        ids = gather(self.known.ids, begin, counts)
        upto = np.concatenate([[0], np.cumsum(counts)])
        cuts = upto[np.searchsorted(starts, text_ends)] * self.kind.itemsize
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip([0, *cuts.tolist()], cuts.tolist(), strict=False)]

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of ``kind``."""
        if not self.by_stretch:
            return self._whole(texts)
        marked = [self._marked(t) for t in texts]
        out: list[bytes] = [b""] * len(texts)
        for way in range(3):
            here = [k for k, (w, _) in enumerate(marked) if w == way]
            chosen = [marked[k][1] for k in here]
            if here:
                for k, raw in zip(here, self._whole(chosen) if way == 2 else self._by_pieces(chosen, way == 0), strict=True):
                    out[k] = raw
        return out

    def spans(self, texts: list[str]) -> list[np.ndarray]:
        """(start, end) in characters of every token of each text.

        A token that holds a part of a character spans that character.
        """
        if not self.by_stretch:
            found = self.library.encode_batch(texts, add_special_tokens=False)
            return [np.array(e.offsets, dtype=np.int64).reshape(-1, 2) for e in found]
        out = []
        for text, raw in zip(texts, self.ids(texts), strict=True):
            sizes = self.lengths[np.frombuffer(raw, dtype=self.kind)]
            ends = np.cumsum(sizes)
            if not text.isascii():
                data = np.frombuffer(text.encode(), dtype=np.uint8)
                character = np.cumsum((data & 0xC0) != 0x80) - 1
                out.append(np.stack([character[ends - sizes], character[ends - 1] + 1], axis=1))
            else:
                out.append(np.stack([ends - sizes, ends], axis=1))
        return out


@cache
def encoder(path: str) -> Encoder:
    """One per worker."""
    return Encoder(path)


def slices(texts: list[str]) -> Iterator[slice]:
    """Consecutive texts of about ``SLICE_BYTES`` characters."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= SLICE_BYTES:
            yield slice(first, k + 1)
            first, size = k + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


# ------------------------------------------------------- 8: counts by section


def line_bounds(text: str) -> np.ndarray:
    """Starts of the lines of a text and its end; a line holds its line feed."""
    ends = [m.end() for m in re.finditer("\n", text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return np.array([0, *ends], dtype=np.int64)


def attribute(spans: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Tokens per section. A token that crosses sections belongs to the one with most
    of its characters, to the earlier one of equals."""
    sections = len(bounds) - 1
    first = np.searchsorted(bounds, spans[:, 0], side="right") - 1
    last = np.searchsorted(bounds, spans[:, 1] - 1, side="right") - 1
    home = np.clip(first, 0, sections - 1)
    for k in np.flatnonzero(last > first):
        start, end = spans[k]
        held = [min(end, bounds[s + 1]) - max(start, bounds[s]) for s in range(first[k], last[k] + 1)]
        home[k] = first[k] + int(np.argmax(held))
    return np.bincount(home, minlength=sections)


def section_token_counts(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section, start, n_chars, n_tokens), one row per line of every text.

    Each whole text is encoded once and its token spans are joined to the spans of
    its lines, so the counts of a text add up to those of the whole. Texts without
    a line feed are one section; NULL and empty texts have one section of no
    characters and no tokens. Rows that repeat are counted each for itself; other
    columns are ignored.
    """
    ready(docs.sparkSession)

    @F.arrow_udf("array<struct<section:int,start:bigint,n_chars:bigint,n_tokens:bigint>>")
    def count(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = encoder(path)
        for column in parts:
            texts = column.fill_null("").to_pylist()
            numbers, starts, chars, counts, sizes = [], [], [], [], [0]
            for part in slices(texts):
                for t, spans in zip(texts[part], tokens.spans(texts[part]), strict=True):
                    bounds = line_bounds(t)
                    numbers.append(np.arange(len(bounds) - 1, dtype=np.int32))
                    starts.append(bounds[:-1])
                    chars.append(np.diff(bounds))
                    counts.append(attribute(spans, bounds))
                    sizes.append(len(bounds) - 1)
            if not texts:
                yield pa.array([], _SECTIONS)
                continue
            rows = pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in (numbers, starts, chars, counts)], fields=list(_SECTIONS.value_type))
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), rows)

    found = docs.select(F.col(f"`{key}`").alias(key), F.explode(count(F.col(f"`{text}`"))).alias("s"))
    return found.select(key, "s.*")


_SECTIONS = pa.list_(
    pa.struct([("section", pa.int32()), ("start", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64())])
)


@query("op8_token_counts")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every line of every document."""
    return section_token_counts(table(spark, folder, "documents"), vocabulary())


# ---------------------------------------------------------- 10: binary output

MAGIC = b"RANKVB01"
#: Tokens after which a file is closed at the end of the document.
FILE_TOKENS = 4_000_000
CODE_CHUNK = 1 << 20  # a multiple of 4

#: For every control byte the lengths, in bytes, of its four numbers.
LENGTHS = 1 + ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3)


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes (two bits per number) and little-endian bytes of 1 to 4 per number."""
    controls, data = [], []
    for k in range(0, len(numbers), CODE_CHUNK):
        x = numbers[k : k + CODE_CHUNK].astype(np.uint32)
        extra = (x > 0xFF).astype(np.uint8) + (x > 0xFFFF) + (x > 0xFFFFFF)
        padded = np.zeros(-(-len(x) // 4) * 4, dtype=np.uint8)
        padded[: len(x)] = extra
        controls.append((padded[::4] | padded[1::4] << 2 | padded[2::4] << 4 | padded[3::4] << 6).tobytes())
        ends = np.cumsum(extra + np.uint8(1), dtype=np.int64)
        out = np.empty(int(ends[-1]), dtype=np.uint8)
        out[ends - extra - 1] = x & 0xFF
        for byte in (1, 2, 3):
            long = np.flatnonzero(extra >= byte)
            if not len(long):
                break
            out[ends[long] - extra[long] + (byte - 1)] = (x[long] >> (8 * byte)) & 0xFF
        data.append(out.tobytes())
    return b"".join(controls), b"".join(data)


def unpack(controls: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The numbers again: lengths from the table, then a gather of their bytes."""
    out, at = np.empty(count, dtype=np.uint32), 0
    for k in range(0, count, CODE_CHUNK):
        n = min(CODE_CHUNK, count - k)
        lengths = LENGTHS[controls[k // 4 : (k + n + 3) // 4]].ravel()[:n]
        ends = at + np.cumsum(lengths)
        starts, part = ends - lengths, out[k : k + n]
        part[:] = data[starts]
        for byte in (1, 2, 3):
            long = np.flatnonzero(lengths > byte)
            if not len(long):
                break
            part[long] |= data[starts[long] + byte].astype(np.uint32) << np.uint32(8 * byte)
        at = int(ends[-1])
    return out


def encode_file(keys: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    """A self-contained file: its ids by falling frequency, keys and sizes of its documents, coded ranks."""
    counts = np.bincount(ids)
    by_rank = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    ranks = np.zeros(len(counts), dtype=np.uint32)
    ranks[by_rank] = np.arange(len(by_rank))
    controls, data = pack(ranks[ids])
    nulls = np.array([k is None for k in keys], dtype=np.uint8)
    head = struct.pack("<8sQQQQ", MAGIC, len(keys), len(ids), len(by_rank), len(data))
    named = np.array([0 if k is None else k for k in keys], dtype="<i8")
    return b"".join([head, by_rank.astype("<u4").tobytes(), nulls.tobytes(), named.tobytes(), np.array(sizes, dtype="<u8").tobytes(), controls, data])


def decode_file(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(keys, sizes, ids) of a file."""
    magic, docs, tokens, ranks, size = struct.unpack_from("<8sQQQQ", raw)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = struct.calcsize("<8sQQQQ")

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, dtype=kind, count=count, offset=at)
        at += out.nbytes
        return out

    by_rank, nulls, named, sizes = take("<u4", ranks), take("u1", docs), take("<i8", docs), take("<u8", docs)
    controls, data = take("u1", -(-tokens // 4)), take("u1", size)
    keys = [None if null else k for null, k in zip(nulls.tolist(), named.tolist(), strict=True)]
    return keys, sizes.astype(np.int64), by_rank[unpack(controls, data, tokens)]


def write_token_files(
    docs: DataFrame, folder: str, path: str, *, key: str = "doc_id", text: str = "text", end_id: int = END_ID, file_tokens: int = FILE_TOKENS
) -> DataFrame:
    """Encode every whole text, add ``end_id``, and write files in ascending key order.

    Returns the manifest: part and seq (the order of the files), file, n_docs and
    n_tokens. Only files in it count; a task that is run again writes new ones.
    Rows without a key come first, NULL texts are empty, rows that repeat a key
    stand next to each other. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    ready(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        tokens, context, seq = encoder(path), TaskContext.get(), 0
        end = np.array([end_id], dtype=tokens.kind).tobytes()
        keys, sizes, coded, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal keys, sizes, coded, size, seq
            name = f"{root}/part-{context.partitionId():06d}-{seq:06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.tok"
            with store.open_output_stream(name) as out:
                out.write(encode_file(keys, sizes, np.frombuffer(b"".join(coded), dtype=tokens.kind)))
            row = [context.partitionId(), seq, name, len(keys), size]
            keys, sizes, coded, size, seq = [], [], [], 0, seq + 1
            return pa.RecordBatch.from_pylist([dict(zip(_MANIFEST.names, row, strict=True))], schema=_MANIFEST)

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).fill_null("").to_pylist()
            for part in slices(texts):
                for name, ids in zip(names[part], tokens.ids(texts[part]), strict=True):
                    keys.append(name)
                    coded.append(ids + end)
                    sizes.append(len(coded[-1]) // tokens.kind.itemsize)
                    size += sizes[-1]
                    if size >= file_tokens:
                        yield close()
        if keys:
            yield close()

    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text"))
    order = F.col("key").asc_nulls_first()
    return settle(rows.repartitionByRange(order).sortWithinPartitions(order).mapInArrow(write, _MANIFEST_DDL))


_MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
_MANIFEST_DDL = "part int, seq int, file string, n_docs bigint, n_tokens bigint"


def read_token_files(manifest: DataFrame, folder: str, *, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document in the files of a manifest."""
    ready(manifest.sparkSession)
    # One row per file.
    earlier = Window.partitionBy(F.lit(0)).orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("file", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("first"))
    files = max(1, min(manifest.count(), 10_000))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(name) as f:
                    keys, sizes, ids = decode_file(f.read())
                ends = np.cumsum(sizes)
                raw, upto = memoryview(ids.astype("<u4").tobytes()), (4 * ends).tolist()
                sums = [zlib.crc32(raw[a:b]) for a, b in zip([0, *upto], upto, strict=False)]
                columns = [pa.array(keys, pa.int64()), pa.array(first + ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "start", "n_tokens", "ids_crc32"])

    out = starts.repartition(files).mapInArrow(read, "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return out.withColumnRenamed("key", key)


@query("op10_token_files")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document, written to files and read back."""
    out = f"{checkpoint_root(spark)}/tokens-{uuid.uuid4().hex}"
    out = out if "://" in out or out.startswith("file:") else f"file://{out}"
    manifest = write_token_files(table(spark, folder, "documents"), out, vocabulary())
    return read_token_files(manifest, out)
