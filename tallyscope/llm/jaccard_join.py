"""Operator 9: Jaccard join of word n-gram sets over prefix trees.

1. Equal texts become one class (a hash aggregate).
2. Candidates. Sets of similar size that reach the threshold differ in at most k
   elements. Cut into more than k parts by element hash, at least one part is equal
   in both, so documents that share a part's signature are candidates; all pairs
   that can link are found. A task forwards one row per signature and turns the
   others into edges at once, so a signature that many documents share stays small.
3. Connected candidates form groups; a large group is cut into tiles and each pair
   of tiles is one unit of work.
4. A unit stores its sets, in one global order of the elements, in a prefix tree.
   All sets walk the tree at once: the overlap with a node's path is found once for
   all sets below it, and a walker leaves a subtree as soon as the remaining lengths
   can't reach the overlap that the threshold asks for, or when all sets below are
   of its class already.
5. Links become components.

The global order is that of the 64-bit element hashes: fixed, known to every task
and the same at every size, so no pass over the corpus is needed to make it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions.groups import attach, drop_keys, is_small
from tallyscope.llm.common import LOWER, byte_view, lean, mix, query, ready, table
from tallyscope.llm.components import connected_components, edge_batch
from tallyscope.session import settle

WORDS = 3
#: 100 * intersection >= 90 * union.
PERCENT = 90
CHUNK_BYTES = 512 << 10
TILE_SETS, TILE_ELEMENTS = 400, 2_000_000
#: Elements of a path between two looks at the bounds.
STRIDE = 48

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FACTOR = np.uint64(0x100000001B3)
#: Modulo 2^64 every odd number has an inverse.
_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_LETTERS = mix(np.arange(1, 257, dtype=np.uint64))


@cache
def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    powers, back = np.ones(size, dtype=np.uint64), np.ones(size, dtype=np.uint64)
    np.cumprod(np.full(size - 1, _FACTOR), out=powers[1:])
    np.cumprod(np.full(size - 1, _INVERSE), out=back[1:])
    return powers, back


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``size`` powers of the factor and of its inverse; kept for usual sizes."""
    table = _power_table(CHUNK_BYTES + 1) if size <= CHUNK_BYTES + 1 else _power_table.__wrapped__(size)
    return table[0][:size], table[1][:size]


def word_hashes(data: memoryview, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word and the number of words before each row.

    One running polynomial over all bytes; a word's hash is the difference of two
    of its values, shifted back to the word's start.
    """
    low, high = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(bytes(data[low:high]).translate(LOWER), dtype=np.uint8)
    inside = ~_SPACE[raw]
    previous = np.empty_like(inside)
    previous[:1], previous[1:] = False, inside[:-1]
    edges = offsets[:-1] - low
    previous[edges[edges < len(raw)]] = False
    starts = np.flatnonzero(inside & ~previous)
    following = np.zeros_like(inside)
    following[:-1] = inside[1:] & previous[1:]
    ends = np.flatnonzero(inside & ~following) + 1
    powers, back = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_LETTERS[raw] * powers[:-1], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(starts, offsets - low)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of the word n-grams of each text.

    A text of fewer words is one n-gram; one without words has none.
    """
    data, offsets = byte_view(texts)
    out: list[np.ndarray] = []
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1)
        hashes, at = word_hashes(data, offsets[first : last + 1])
        grams = np.zeros(max(0, len(hashes) - words + 1), dtype=np.uint64)
        for j in range(words):
            grams = mix(grams + hashes[j : j + len(grams)])
        for start, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if end - start >= words:
                out.append(np.unique(grams[start : end - words + 1]))
            elif end > start:
                whole = np.zeros(1, dtype=np.uint64)
                for h in hashes[start:end]:
                    whole = mix(whole + h)
                out.append(mix(whole + np.uint64(end - start)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
        first = last
    return out


def apart(a: int, b: int, percent: int) -> int:
    """The most elements in which linked sets of these sizes can differ."""
    return (100 - percent) * (a + b) // (100 + percent)


def part_counts(limit: int) -> list[int]:
    """Numbers of parts: each about half as large again as the one before."""
    counts = [2]
    while counts[-1] < limit:
        counts.append(counts[-1] * 3 // 2)
    return counts


def cuts(size: int, percent: int, counts: list[int]) -> list[tuple[int, int]]:
    """(parts, most differing elements) under which a set of this size is cut."""
    least, most = -(-size * percent // 100), size * 100 // percent
    low, high = apart(size, least, percent), apart(size, most, percent)
    if high == 0:
        return [(1, 0)]  # only equal sets link
    lower = next(c for c in counts if c > low)
    upper = next(c for c in counts if c > high)
    return [(c, min(high, c - 1)) for c in counts if lower <= c <= upper]


def signatures(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of the set) of every part under every cut of every set.

    Empty parts are left out, unless a set has so many of them that all its equal
    parts could be empty ones.
    """
    sizes = [len(s) for s in sets]
    counts = part_counts(apart(max(sizes, default=0), max(sizes, default=0) * 100 // percent, percent) + 2)
    values, owners, parts, bases, slack = [], [], [], [], []
    known: dict[int, list[tuple[int, int]]] = {}
    upto = 0
    for k, s in enumerate(sets):
        for count, most in known.setdefault(len(s), cuts(len(s), percent, counts)) if len(s) else []:
            values.append(s)
            owners.append(k)
            parts.append(count)
            bases.append(upto)
            slack.append(count - most)
            upto += count
    if not values:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    lengths = [len(v) for v in values]
    elements = np.concatenate(values)
    count_of = np.repeat(np.array(parts, dtype=np.uint64), lengths)
    part = ((mix(elements + np.uint64(7)) >> np.uint64(20)) % count_of).astype(np.int64) + np.repeat(bases, lengths)
    # A part's signature is a sum over its elements, in three exact pieces.
    scattered = mix(elements + np.uint64(11))
    signature = np.zeros(upto, dtype=np.uint64)
    for piece in range(3):
        bits = ((scattered >> np.uint64(21 * piece)) & np.uint64(0x1FFFFF)).astype(np.float64)
        signature = mix(signature + np.bincount(part, weights=bits, minlength=upto).astype(np.uint64))
    filled = np.bincount(part, minlength=upto) > 0
    own = np.repeat(np.arange(len(parts)), parts)
    number = np.arange(upto) - np.repeat(bases, parts)
    signature = mix(signature + number.astype(np.uint64) * np.uint64(1 << 32) + np.repeat(np.array(parts, dtype=np.uint64), parts))
    empty = np.bincount(own, weights=~filled, minlength=len(parts))
    kept = filled | (empty >= np.array(slack))[own]
    return signature[kept], np.array(owners)[own[kept]]


def _slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive rows of about ``CHUNK_BYTES``, so that a task's memory doesn't depend on the batch."""
    _, offsets = byte_view(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1)
        yield first, texts.slice(first, last - first)
        first = last


def _candidate_rows(percent: int, words: int):
    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: a signature and the smallest document that has it; 1: a candidate edge; 2: a set's size."""
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            sizes, found = [], [(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))]
            for first, texts in _slices(batch.column(1)):
                sets = shingle_sets(texts, words)
                sizes += [len(s) for s in sets]
                signature, owner = signatures(sets, percent)
                found.append((signature, ids[first + owner]))
            sizes = np.array(sizes, dtype=np.int64)
            signature, doc = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((doc, signature))
            signature, doc = signature[order].view(np.int64), doc[order]
            head = np.ones(len(doc), dtype=bool)
            head[1:] = signature[1:] != signature[:-1]
            least = doc[head][np.cumsum(head) - 1] if len(doc) else doc
            far = least != doc
            pairs = np.unique(np.stack([doc[far], least[far]]), axis=1)
            columns = [
                np.concatenate([np.zeros(head.sum(), np.int8), np.ones(pairs.shape[1], np.int8), np.full(len(ids), 2, np.int8)]),
                np.concatenate([signature[head], pairs[0], ids]),
                np.concatenate([doc[head], pairs[1], sizes]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "a", "b"])

    return rows


@lean
def _same_signature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (signature, document) to edges from the first document of a signature."""
    last, first = None, None
    for batch in batches:
        signature, doc = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(signature):
            continue
        head = np.ones(len(doc), dtype=bool)
        head[1:] = signature[1:] != signature[:-1]
        least = doc[head][np.cumsum(head) - 1]
        if signature[0] == last:
            least[signature == last] = first
        last, first = signature[-1], least[-1]
        far = least != doc
        pairs = np.unique(np.stack([doc[far], least[far]]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


class Node:
    """A path of elements that the sets below (low to high, in tree order) share."""

    __slots__ = ("path", "depth", "children", "low", "high")

    def __init__(self, path: np.ndarray, depth: int, low: int):
        self.path, self.depth, self.low, self.high = path, depth, low, low + 1
        self.children: list[Node] = []


def build_tree(sets: list[np.ndarray]) -> Node:
    """The prefix tree of sets that are in lexicographic order; only the last child can grow."""
    root = Node(np.zeros(0, dtype=np.int64), 0, 0)
    for k, s in enumerate(sets):
        node, at = root, 0
        while True:
            if not node.children and node is not root:  # the set that ends here becomes a child of its own
                node.children.append(Node(s[:0], at, node.low))
            node.high = k + 1
            last = node.children[-1] if node.children else None
            if last is None or at == len(s) or not len(last.path) or last.path[0] != s[at]:
                node.children.append(Node(s[at:], at, k))
                break
            n = min(len(last.path), len(s) - at)
            differs = np.flatnonzero(last.path[:n] != s[at : at + n])
            n = int(differs[0]) if len(differs) else n
            if n < len(last.path):
                upper = Node(last.path[:n], at, last.low)
                upper.high, upper.children = last.high, [last]
                last.path, last.depth = last.path[n:], at + n
                node.children[-1] = last = upper
            node, at = last, at + n
    return root


class Walkers:
    """All sets of a unit walking its tree at once, each with the overlap so far."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.count = percent, len(sets)
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        elements = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        self.width = int(elements.max()) + 1
        # Walkers by element, and every walker's elements in order.
        order = np.argsort(elements, kind="stable")
        self.by_element = owner[order]
        self.first = np.searchsorted(elements[order], np.arange(self.width + 1))
        self.keys = owner * self.width + elements
        self.starts = np.cumsum(self.sizes) - self.sizes
        #: The class of each set; sets that links reach have equal numbers.
        self.label = np.arange(len(sets))

    def shared(self, path: np.ndarray) -> np.ndarray:
        """How many elements of a path each set has."""
        counts = self.first[path + 1] - self.first[path]
        at = np.repeat(self.first[path] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return np.bincount(self.by_element[at], minlength=self.count)

    def walk(self, node: Node, who: np.ndarray, overlap: np.ndarray) -> None:
        stack = [(node, who, overlap)]
        while stack:
            node, who, overlap = stack.pop()
            below = self.sizes[node.low : node.high]
            shortest, longest = int(below.min()), int(below.max())
            # A pair is met at its earlier set; other walkers than those of the subtree's class go on.
            go = who > node.low
            labels = self.label[node.low : node.high]
            if (labels == labels[0]).all():
                go &= self.label[who] != labels[0]
            size = self.sizes[who]
            go &= (longest * 100 >= size * self.percent) & (shortest * self.percent <= size * 100)
            who, overlap = who[go], overlap[go]
            for k in range(0, len(node.path), STRIDE):
                if not len(who):
                    break
                path = node.path[k : k + STRIDE]
                overlap = overlap + self.shared(path)[who]
                passed = np.searchsorted(self.keys, who * self.width + path[-1], side="right") - self.starts[who]
                rest = np.minimum(self.sizes[who] - passed, longest - node.depth - k - len(path))
                # The overlap that the shortest set below would need at least.
                needed = -(-self.percent * (self.sizes[who] + shortest) // (100 + self.percent))
                go = overlap + rest >= needed
                who, overlap = who[go], overlap[go]
            if not len(who):
                continue
            if not node.children:
                own = node.low
                linked = who[100 * overlap >= self.percent * (self.sizes[who] + self.sizes[own] - overlap)]
                for label in np.unique(self.label[linked]):
                    self.label[self.label == label] = self.label[own]
            stack += [(child, who, overlap) for child in reversed(node.children)]


def join_sets(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """A class number for each of the non-empty sets; sets that links reach have equal ones."""
    ranks = np.unique(np.concatenate(sets), return_inverse=True)[1]
    parts = np.split(ranks, np.cumsum([len(s) for s in sets])[:-1])
    order = sorted(range(len(sets)), key=lambda k: parts[k].astype(">u4").tobytes())
    parts = [parts[k] for k in order]
    walkers = Walkers(parts, percent)
    walkers.walk(build_tree(parts), np.arange(len(parts)), np.zeros(len(parts), dtype=np.int64))
    out = np.empty(len(sets), dtype=np.int64)
    out[order] = walkers.label
    return out


def _unit_links(percent: int):
    @lean
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, ids, sets = None, [], []

        def finish() -> pa.RecordBatch:
            heads: dict[int, int] = {}
            classes = join_sets(sets, percent).tolist() if len(sets) > 1 else []
            pairs = [(i, head) for i, c in zip(ids, classes, strict=False) if (head := heads.setdefault(c, i)) != i]
            return edge_batch([i for i, _ in pairs], [head for _, head in pairs])

        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for key, doc, raw in zip(keys, batch.column(3).to_pylist(), batch.column(4), strict=True):
                if key != unit:
                    yield finish()
                    unit, ids, sets = key, [], []
                ids.append(doc)
                sets.append(np.frombuffer(raw.as_buffer(), dtype=np.uint64))
        yield finish()

    return links


def _verified(reps: DataFrame, groups: DataFrame, percent: int, words: int) -> DataFrame:
    """Links, as a forest per unit, among the documents of each candidate group."""
    # A group of documents and its number of tiles.
    n_tiles = F.ceil(F.greatest(F.count(F.lit(1)) / TILE_SETS, F.sum("size") / TILE_ELEMENTS)).cast("int")
    tiles = settle(groups.groupBy("component").agg(n_tiles.alias("tiles")))
    # Each document is in as many units as its group has tiles, less itself.
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    placed = settle(attach(groups, tiles, "component").withColumn("tile", tile).select("node", "component", "tiles", "tile"))

    @F.arrow_udf("binary")
    @lean
    def packed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array([s.tobytes() for s in shingle_sets(texts, words)], pa.binary())

    renamed = placed.withColumnRenamed("node", "_id")
    side = F.broadcast(renamed) if is_small(renamed) else renamed
    sets = reps.join(side, "_id").withColumn("_set", packed("_text")).drop("_text")
    others = F.sequence(F.lit(0), F.col("tiles") - 1)
    others = F.when(F.col("tiles") > 1, F.filter(others, lambda j: j != F.col("tile"))).otherwise(others)
    units = sets.withColumn("_j", F.explode(others)).select(
        "component", F.least("tile", "_j").alias("_low"), F.greatest("tile", "_j").alias("_high"), "_id", "_set"
    )
    unit = ["component", "_low", "_high"]
    return units.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(_unit_links(percent), "a bigint, b bigint")


def jaccard_classes(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """(key, n_shingles, component_id), one row per row of ``docs``.

    Documents link when the Jaccard coefficient of their sets of ``words``-word
    n-grams is ``percent`` hundredths or more; a class is what links reach, named by
    its smallest key. Words are what stands between ASCII white space, A-Z in lower
    case. A text of fewer words is one n-gram; NULL, empty and blank texts have
    none, link with nothing and stand alone. Rows that repeat a key and its text are
    one document; each other text of a key is a document of its own, whose class is
    also named by the smallest key in it. A row without a key gets its set's size and
    the class of its text, if a row with a key has that text, else NULL. Other columns
    are ignored. Sets are compared by 64-bit hashes of their elements.
    """
    found = _classes(docs, key, text, words, percent)
    return found.drop("_hash")


def _nodes(members: DataFrame) -> tuple[DataFrame, bool]:
    """Add ``_node``: the id, or a number below all of 62 bits for further texts of an id; and whether there are such."""
    texts = members.where("_id IS NOT NULL").groupBy("_id").agg(F.min("_hash").alias("_first"), F.max("_hash").alias("_last"))
    several = settle(texts.where("_first <> _last").select("_id", "_first"))
    if several.isEmpty():
        return members.withColumn("_node", F.col("_id")), False
    further = F.lit(-(1 << 62)) - F.pmod(F.xxhash64("_id", "_hash"), F.lit(1 << 61))
    own = F.when(F.col("_first").isNull() | (F.col("_first") == F.col("_hash")), F.col("_id")).otherwise(further)
    return attach(members, several, "_id").withColumn("_node", own).drop("_first"), True


def _classes(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """The result of ``jaccard_classes`` with each row's ``_hash``, the checksum of its text."""
    ready(docs.sparkSession)
    # Equal texts first: one representative each, the smallest key.
    known = docs.select(F.col(f"`{key}`").cast("bigint").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    known = known.withColumn("_hash", F.md5(F.col("_text").cast("binary")))
    members = settle(known.select("_id", "_hash"))
    members, several = _nodes(members)
    # Rows without a key stand for a text only if no other row has it.
    least = F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "_node")))
    classes = members.groupBy("_hash").agg(least.alias("_least"), F.count(F.lit(1)).alias("_n"))
    repeated = settle(classes.where("_n > 1").select("_hash", F.col("_least._node").alias("_first"), F.col("_least._id").alias("_first_id")))
    # All rows whose text has an earlier row; the others stand for their text.
    members = attach(members, repeated, "_hash").withColumn("_rep", F.coalesce("_first", "_node")).withColumn("_rep_id", F.coalesce("_first_id", "_id"))
    members = members.drop("_first", "_first_id")
    copies = settle(members.where("_node <> _rep").select("_node"))
    known = _with_nodes(known, members) if several else known.withColumn("_node", F.col("_id"))
    reps = drop_keys(known.where(F.col("_id").isNotNull()).select("_node", "_text"), copies, "_node").select(F.col("_node").alias("_id"), "_text")

    rows = settle(reps.mapInArrow(_candidate_rows(percent, words), "kind tinyint, a bigint, b bigint"))
    shared = (
        rows.where("kind = 0").select("a", "b").repartition("a").sortWithinPartitions("a", "b")
        .mapInArrow(_same_signature, "a bigint, b bigint")
    )
    sizes = rows.where("kind = 2").groupBy(F.col("a").alias("_rep")).agg(F.max("b").alias("n_shingles"))
    # Settled, so that a task never feeds one Python worker from another.
    candidates = connected_components(rows.where("kind = 1").select("a", "b").union(settle(shared)))
    candidates = candidates.join(sizes.withColumnRenamed("n_shingles", "size"), F.col("node") == F.col("_rep")).drop("_rep")
    links = connected_components(settle(_verified(reps, settle(candidates), percent, words)))
    if several:
        links = _named_by_id(links, members)

    found = sizes.join(links, F.col("_rep") == F.col("node"), "left").drop("node")
    out = attach(members.where(F.col("_rep").isNotNull()), settle(found), "_rep")
    blank = F.coalesce(F.col("n_shingles"), F.lit(0)) == 0
    own = F.when(blank, F.col("_id")).otherwise(F.coalesce("component", "_rep_id"))
    named = out.select(F.col("_id").alias(key), F.coalesce("n_shingles", F.lit(0)).alias("n_shingles"), own.alias("component_id"), "_hash")
    # Texts that only rows without a key have.
    rest = members.where(F.col("_rep").isNull()).select("_hash")
    return named if rest.isEmpty() else named.union(_without_key(docs, text, members, key, words))


def _with_nodes(known: DataFrame, members: DataFrame) -> DataFrame:
    """The nodes of ``members`` for the rows with their texts, by id and text."""
    row = F.concat_ws(":", F.col("_id").cast("string"), "_hash")
    further = settle(members.where("_node <> _id").select(row.alias("_row"), "_node").distinct())
    joined = attach(known.withColumn("_row", row), further, "_row")
    return joined.withColumn("_node", F.coalesce("_node", "_id")).drop("_row")


def _named_by_id(links: DataFrame, members: DataFrame) -> DataFrame:
    """Components named by the smallest id among their nodes instead of the smallest node."""
    ids = settle(members.where("_node <> _id").select(F.col("_node").alias("node"), "_id").distinct())
    named = settle(attach(links, ids, "node").withColumn("_id", F.coalesce("_id", "node")))
    least = settle(named.groupBy("component").agg(F.min("_id").alias("_least")))
    return attach(named, least, "component").select("node", F.col("_least").alias("component"))


def _without_key(docs: DataFrame, text: str, members: DataFrame, key: str, words: int) -> DataFrame:
    @F.arrow_udf("bigint")
    def size(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array([len(s) for s in shingle_sets(texts, words)], pa.int64())

    lone = settle(members.where(F.col("_rep").isNull()).select("_hash").distinct())
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias(key), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    rows = rows.where(F.col(f"`{key}`").isNull()).withColumn("_hash", F.md5(F.col("_text").cast("binary")))
    rows = attach(rows, lone.withColumn("_lone", F.lit(True)), "_hash").where("_lone")
    return rows.select(key, size("_text").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id"), "_hash")


_SETS = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, least(len(w), 3) AS n,
  unnest(range(1, len(w) - least(len(w), 3) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
"""

CHECK = f"""{_SETS}
-- Linked sets of a tenth less or more elements; a rare element is common to both.
f AS (SELECT s, count(*) AS f FROM s GROUP BY s HAVING count(*) > 1),
o AS (SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(f, 1), s) AS r
  FROM s JOIN n USING (doc_id) LEFT JOIN f USING (s)),
p AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM o a JOIN o b ON a.s = b.s AND a.doc_id < b.doc_id
  AND a.n * 100 >= b.n * {PERCENT} AND b.n * 100 >= a.n * {PERCENT}
  WHERE a.r <= a.n - ceil(a.n * {PERCENT} / 100) + 1 AND b.r <= b.n - ceil(b.n * {PERCENT} / 100) + 1),
i AS (SELECT a, b, count(*) AS i FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND x.s = y.s GROUP BY a, b),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * i >= {PERCENT} * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(c, doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


@query("op9_jaccard_join", CHECK)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of documents that share nine tenths of their three-word n-grams."""
    return jaccard_classes(table(spark, folder, "documents"))


def class_heads(docs: DataFrame, **options) -> DataFrame:
    """The document of each class with the smallest id, unchanged; of an id with several texts each by itself."""
    key, text = options.get("key", "doc_id"), options.get("text", "text")
    found = _classes(docs, key, text, options.get("words", WORDS), options.get("percent", PERCENT))
    marker = F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))
    losers = found.where(F.col(key) != F.col("component_id")).select(F.concat_ws(":", F.col(key).cast("string"), "_hash").alias("_class_row"))
    marked = docs.withColumn("_class_row", F.concat_ws(":", F.col(f"`{key}`").cast("bigint").cast("string"), marker))
    return drop_keys(marked, settle(losers), "_class_row").drop("_class_row")
