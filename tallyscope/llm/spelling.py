"""Operator 11: spelling variants by dense prefix-suffix tiles.

Two words differ by one inserted, deleted or replaced code point if and only if
their common prefix and suffix together reach the longer length less one. One of
the two then has half of that, so words that share the first or the last half meet
in a bucket. A bucket's words are rows of a matrix of code points; pairs of blocks
of such rows are compared column by column for all pairs at once. Large buckets
are cut in tiles that go to tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions.groups import attach
from tallyscope.llm.common import lean, query, ready, table
from tallyscope.session import settle

#: Runs of these are words (Latin letters up to U+00FF, with the two signs among them).
LETTERS = r"[A-Za-zÀ-ÿ]"
SHORTEST = 5
FEWEST = 3
#: One in so many (document, word) pairs loses a letter.
EVERY = 97
#: A form occurs so many times as often, at least.
RATIO = 2
#: Rows of a block; words, and letters of all of them, that a task compares at a time.
BLOCK = 256
TILE, TILE_LETTERS = 8_192, 1 << 20


def damaged(run: Column, key: Column) -> Column:
    """The run without one letter where its checksum with the document says so."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.char_length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % EVERY == 0, shorter).otherwise(run)


def word_counts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", damage: bool = True) -> DataFrame:
    """(word, n): words of ``SHORTEST`` letters or more that occur ``FEWEST`` times or more, A-Z in lower case.

    Every occurrence in every row counts, so rows that repeat count again. NULL and
    empty texts have no words; a NULL key is an empty one in the checksum.
    """
    runs = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"{LETTERS}{{{SHORTEST},}}"), F.lit(0))
    found = docs.select(F.col(f"`{key}`").alias("_key"), F.explode(runs).alias("_run"))
    # The fast way is right for ASCII; other capitals stay as they are.
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length("_run") == F.char_length("_run")
    lower = F.when(plain, F.lower("_run")).otherwise(F.translate("_run", letters, letters.lower()))
    word = lower.alias("_word")
    found = found.select("_key", word).select((damaged(F.col("_word"), F.col("_key")) if damage else F.col("_word")).alias("word"))
    counted = found.where(F.char_length("word") >= SHORTEST).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= FEWEST)


def _buckets(words: DataFrame) -> DataFrame:
    """Four rows per word: as one of the longer or the shorter words of a pair, by its first and by its last half."""
    length = F.char_length("word")
    # The longer word's length, and the half that is common to both at the start or the end.
    levels = F.explode(F.array(length, length + 1)).alias("level")
    rows = words.select("word", "n", levels).withColumn("half", F.floor(F.col("level") / 2).cast("int"))
    ends = F.array(
        F.struct(F.lit(False).alias("tail"), F.substring("word", F.lit(1), F.col("half")).alias("part")),
        F.struct(F.lit(True).alias("tail"), F.expr("right(word, half)").alias("part")),
    )
    rows = rows.select("word", "n", "level", F.explode(ends).alias("e"))
    return rows.select(F.xxhash64("level", "e.tail", "e.part").alias("bucket"), "level", "e.tail", "word", "n")


def common(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """For all pairs of rows the number of equal leading columns, up to ``most``."""
    equal = np.ones((len(a), len(b)), dtype=bool)
    out = np.zeros((len(a), len(b)), dtype=np.uint8 if most < 256 else np.int32)
    for k in range(min(most, a.shape[1])):
        equal &= a[:, k][:, None] == b[:, k][None, :]
        if not equal.any():
            break
        out += equal
    return out


class Matrix:
    """Words as code points, once from the start and once from the end, filled up with NUL."""

    def __init__(self, words: list[str]):
        self.lengths = np.array([len(w) for w in words], dtype=np.int32)
        width = int(self.lengths.max())
        self.start = np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)
        self.end = np.array([w[::-1] for w in words], dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)
        if self.start.max() <= 0xFFFF:
            self.start, self.end = self.start.astype(np.uint16), self.end.astype(np.uint16)

    def near(self, i: slice, j: slice, level: int, tail: bool) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``i`` and ``j`` of the pairs whose longer word has ``level`` letters and that differ by one edit.

        A pair with the first half in common counts there only, not once more by its last half.
        """
        half = level // 2
        a, b = self.lengths[i], self.lengths[j]
        fits = np.maximum(a[:, None], b[None, :]) == level
        # A word's end is NUL, which is no letter; with both at their end no more letters are equal.
        shorter = np.minimum(a[:, None], b[None, :])
        prefix = common(self.start[i], self.start[j], half if tail else level)
        suffix = common(self.end[i], self.end[j], level if tail else level - half)
        prefix, suffix = np.minimum(prefix, shorter), np.minimum(suffix, shorter)
        same_word = (prefix == level) if not tail else (suffix == level)
        wanted = (prefix < half) if tail else (prefix >= half)
        return np.nonzero(fits & wanted & ~same_word & (prefix.astype(np.int32) + suffix >= level - 1))


def pairs_within(words: list[str], groups: np.ndarray, level: int, tail: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i < j) of the near words of ``level``. ``groups`` are the numbers of their buckets, in order."""
    matrix, left, right = Matrix(words), [], []
    for i in range(0, len(words), BLOCK):
        last = groups[min(i + BLOCK, len(words)) - 1]
        for j in range(i, len(words), BLOCK):
            if last < groups[j]:  # no bucket reaches further
                break
            x, y = matrix.near(slice(i, i + BLOCK), slice(j, j + BLOCK), level, tail)
            keep = (x < y) if i == j else slice(None)
            left.append(x[keep] + i)
            right.append(y[keep] + j)
    return np.concatenate(left), np.concatenate(right)


def pairs_between(words: list[str], second: np.ndarray, level: int, tail: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of near words of ``level`` of which one is in the first tile and one in the second."""
    order, cut = np.argsort(second, kind="stable"), int((~second).sum())
    matrix, left, right = Matrix([words[k] for k in order]), [order[:0]], [order[:0]]
    for i in range(0, cut, BLOCK):
        for j in range(cut, len(words), BLOCK):
            x, y = matrix.near(slice(i, min(i + BLOCK, cut)), slice(j, j + BLOCK), level, tail)
            left.append(order[x + i])
            right.append(order[y + j])
    return np.concatenate(left), np.concatenate(right)


def best_of_each(words: list[str], counts: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, number of near words, the near word of largest count, ties the smallest) as positions."""
    rank = np.empty(len(words), dtype=np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    x, y = np.concatenate([x, y]), np.concatenate([y, x])
    order = np.lexsort((rank[y], -counts[y], x))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.diff(x, prepend=-1))
    return x[first], np.diff(np.append(first, len(x))), y[first]


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())])


#: What a unit is: a whole bucket, one tile of a large one, or two tiles of it.
WHOLE, ONE_TILE, TWO_TILES = 0, 1, 2


@lean
def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of each unit; rows come sorted by (level, tail, mode, bucket, lo, hi).

    Whole buckets of the same kind are compared together, up to about ``TILE`` words.
    """
    kind, unit, number, words, counts, groups, sides, letters = None, None, 0, [], [], [], [], 0

    def finish() -> pa.RecordBatch:
        level, tail, mode = kind
        known, second = np.array(counts, dtype=np.int64), np.array(sides)
        if mode == TWO_TILES:
            x, y = pairs_between(words, second, level, tail)
        else:
            x, y = pairs_within(words, np.array(groups), level, tail)
        x, n, y = best_of_each(words, known, x, y)
        names = pa.array(words, pa.string())
        columns = [names.take(pa.array(x)), pa.array(n.astype(np.int64)), names.take(pa.array(y)), pa.array(known[y])]
        return pa.RecordBatch.from_arrays(columns, schema=_NEAR)

    for batch in batches:
        for level, tail, mode, bucket, lo, hi, side, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            new = unit != (bucket, lo, hi)
            if (level, tail, mode) != kind or new and (mode != WHOLE or len(words) >= TILE or letters >= TILE_LETTERS):
                if len(words) > 1:
                    yield finish()
                kind, words, counts, groups, sides, letters = (level, tail, mode), [], [], [], [], 0
            if new:
                unit, number = (bucket, lo, hi), number + 1
            words.append(word)
            letters += len(word)
            counts.append(n)
            groups.append(number)
            sides.append(side)
    if len(words) > 1:
        yield finish()


def near_word_table(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of the words that have near words; form is the one of largest n, ties the smallest."""
    rows = _buckets(words)
    # Buckets beyond one task, and the number of tiles into which each is cut.
    tiles = F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum(F.char_length("word")) / TILE_LETTERS)).cast("int")
    large = settle(rows.groupBy("bucket").agg(tiles.alias("tiles")).where("tiles > 1"))
    rows = attach(rows, large, "bucket").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    # A word of a large bucket is in as many units as there are tiles.
    tile = F.pmod(F.xxhash64("word", F.lit(11)), F.col("tiles")).cast("int")
    units = rows.withColumn("_t", tile).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    mode = F.when(F.col("tiles") == 1, WHOLE).when(F.col("_t") == F.col("_o"), ONE_TILE).otherwise(TWO_TILES)
    units = units.select(
        "level", "tail", mode.alias("mode"), "bucket", F.least("_t", "_o").alias("lo"), F.greatest("_t", "_o").alias("hi"),
        (F.col("_t") > F.col("_o")).alias("side"), "word", "n",
    )
    spread = units.repartition("bucket", "lo", "hi").sortWithinPartitions("level", "tail", "mode", "bucket", "lo", "hi")
    found = spread.mapInArrow(_compare, "word string, n_near bigint, best string, best_n bigint")
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"),
        F.min_by(F.struct("best", "best_n"), F.struct(-F.col("best_n"), F.col("best"))).alias("_best"),
    ).select("word", "n_near", F.col("_best.best").alias("form"), F.col("_best.best_n").alias("form_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following ``form`` ends, by joining each word's last form to that form's.

    Counts at least double along the way, so paths are short; every round doubles the
    length that is covered.
    """
    now = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        longer = settle(attach(now, onward, "root").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if longer.where("_moved").isEmpty():
            return longer.select("word", "root")
        now = longer.select("word", "root")


def spelling_variants(docs: DataFrame, *, key: str = "doc_id", text: str = "text", damage: bool = True) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word of ``word_counts``.

    Words are near if one inserted, deleted or replaced code point makes them equal.
    ``form`` is a word's near word of largest n (ties: the smallest), if that is
    ``RATIO`` times the word's own or more, else NULL; ``root`` is where following
    forms ends, the word itself without one. NULL and empty texts, NULL keys and rows
    that repeat are as in ``word_counts``; other columns are ignored; an empty table
    gives an empty result. ``damage`` off counts the words as they stand.
    """
    ready(docs.sparkSession)
    words = settle(word_counts(docs, key=key, text=text, damage=damage))
    near = settle(near_word_table(words))
    joined = settle(words.join(near, "word", "left").withColumn("_right", F.coalesce(F.col("form_n") >= RATIO * F.col("n"), F.lit(False))))
    forms = joined.where("_right").select("word", "form")
    out = joined.join(_roots(forms), "word", "left")
    return out.select(
        "word",
        F.when(F.col("_right"), F.col("form")).alias("form"),
        F.coalesce("root", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(F.col("_right"), F.col("form_n")).alias("form_n"),
    )


# The checksum in SQL as in the shards' check; near words there by what one deletion leaves of each.
CHECK = f"""
WITH RECURSIVE t AS (SELECT i AS b, i AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM t WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS c FROM t WHERE k = 8),
o AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{5,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
d AS (SELECT doc_id, w, count(*) AS n FROM o GROUP BY doc_id, w),
h AS (SELECT w, n, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(doc_id || ':' || w)), '..'),
  lambda x: CAST('0x' || x AS BIGINT)), lambda a, x: xor(a >> 8, c[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM d, crc),
s AS (SELECT CASE WHEN h % {EVERY} = 0 THEN w[:CAST(h % length(w) AS INTEGER)] || w[CAST(h % length(w) AS INTEGER) + 2:] ELSE w END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {FEWEST}),
cut AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM w, unnest(range(1, length(word) + 1)) r(i)),
pairs AS (SELECT a.word AS a, b.word AS b FROM cut a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM cut a JOIN w b ON a.rest = b.word
  UNION SELECT a.word, b.word FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word),
near AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY w.n DESC, b) AS form, max(w.n) AS form_n
  FROM pairs JOIN w ON b = w.word GROUP BY a),
f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {RATIO} * n THEN form END AS form,
  CASE WHEN form_n >= {RATIO} * n THEN form_n END AS form_n FROM w LEFT JOIN near USING (word)),
p AS (SELECT word, word AS root, form AS onward FROM f
  UNION ALL SELECT p.word, p.onward, f.form FROM p JOIN f ON f.word = p.onward)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN p ON p.word = f.word AND p.onward IS NULL
"""


@query("op11_spelling_variants", CHECK)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents with their more frequent spelling and where these lead."""
    return spelling_variants(table(spark, folder, "documents"))
