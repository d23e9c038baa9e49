"""Operator 7: language of a text by multinomial naive Bayes over hashed character n-grams.

Learning counts the n-grams of a bounded sample of labelled texts (``sample`` rows per
language by a hash of the key, all rows where there are fewer). The matrix of log
probabilities, buckets x languages, is broadcast; its size is fixed by the number of
buckets and of languages. Scoring takes the rows of the matrix for all n-grams of a
batch of whole texts and adds them up by text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.common import lean, query, ready, table

BUCKET_BITS = 15
LENGTHS = (1, 2, 3)
SAMPLE = 8_000
SMOOTHING = 0.5
CHUNK = 100_000
UNDETERMINED = "und"
#: Below this posterior probability a language filter rejects.
MIN_SCORE = 0.3
RESULT = "struct<lang:string,score:double>"

_SPACE = ord(" ")


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x10000)), dtype=bool, count=0x10000)


class Grams:
    """Bucket numbers of the character n-grams of texts; anything but letters counts as a space."""

    def __init__(self, bits: int = BUCKET_BITS, lengths: tuple[int, ...] = LENGTHS):
        self.shift, self.lengths, self.letters = np.uint32(32 - bits), lengths, _letters()

    def buckets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(buckets, text of each bucket, whether each text has a letter)."""
        lowered = [t.lower() for t in texts]
        sizes = np.fromiter(map(len, lowered), dtype=np.int64, count=len(texts)) + 2
        points = np.frombuffer("".join(f" {t} " for t in lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = self.letters[np.minimum(points, 0xFFFF)]
        if len(points) and points.max() > 0xFFFF:
            high = points > 0xFFFF
            letter[high] = [chr(p).isalpha() for p in points[high]]
        points = np.where(letter, points, np.uint32(_SPACE))
        owner = np.repeat(np.arange(len(texts)), sizes)
        upto = np.zeros(len(points) + 1, dtype=np.int64)
        np.cumsum(letter, out=upto[1:])
        found, owners = [], []
        for n in self.lengths:
            places = len(points) - n + 1
            if places <= 0:
                continue
            value = np.full(places, n, dtype=np.uint32)
            for j in range(n):
                value = (value ^ points[j : j + places]) * np.uint32(0x01000193)
                value ^= value >> np.uint32(15)
            # Inside one text, and with a letter.
            use = (owner[:places] == owner[n - 1 :]) & (upto[n:] > upto[:-n])
            found.append((value[use] * np.uint32(0x9E3779B1)) >> self.shift)
            owners.append(owner[:places][use])
        has_letter = np.bincount(owner, weights=letter, minlength=len(texts)) > 0
        empty = np.zeros(0, dtype=np.int64)
        return np.concatenate([empty.astype(np.uint32), *found]), np.concatenate([empty, *owners]), has_letter


@dataclass
class LanguageModel:
    languages: list[str]
    #: buckets x languages
    log_probability: np.ndarray
    log_prior: np.ndarray


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts of about ``CHUNK`` characters in all."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= CHUNK:
            yield group
            group, size = [], 0
    if group:
        yield group


def learn(labelled: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """Count the n-grams of a bounded sample of the rows whose ``lang`` and ``text`` are not NULL.

    ``sample`` bounds the expected rows per language. Without labelled rows the
    model has no language, and every prediction is undetermined.
    """
    spark = labelled.sparkSession
    ready(spark)
    rows = labelled.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    size = 1 << BUCKET_BITS
    if not languages:
        return LanguageModel([], np.zeros((size, 0)), np.zeros(0))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / n))])[F.col("lang")]
    place = F.pmod(F.xxhash64(F.lit("learn"), "_id"), F.lit(1 << 30)).cast("double") / (1 << 30)
    chosen = rows.where(place < share).select("lang", "text")

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = Grams(), {}
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(k, []).append(t)
            for k, texts in by_lang.items():
                for group in _chunks(texts):
                    seen = np.bincount(grams.buckets(group)[0], minlength=size)
                    total[k] = total[k] + seen if k in total else seen
        for k, seen in total.items():
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k] * len(at), pa.string()), "bucket": at, "n": seen[at]})

    # A row per language and bucket at most.
    summed = chosen.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    matrix = np.full((size, len(languages)), SMOOTHING)
    seen = summed.toPandas()
    matrix[seen["bucket"].to_numpy(), [languages.index(k) for k in seen["lang"]]] += seen["n"].to_numpy()
    prior = np.log([counts[k] for k in languages]) - np.log(sum(counts.values()))
    return LanguageModel(languages, np.log(matrix) - np.log(matrix.sum(0)), prior)


def scorer(spark: SparkSession, model: LanguageModel):
    """A column function: text to struct (lang, score)."""
    ready(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    @lean
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, grams = shared.value, Grams()
        for texts in parts:
            langs, scores = [], []
            for group in _chunks(texts.fill_null("").to_pylist()):
                a, b = classify(model, grams, group)
                langs += a
                scores.append(b)
            values = np.concatenate([np.zeros(0), *scores])
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(values)], ["lang", "score"])

    return score


def classify(model: LanguageModel, grams: Grams, texts: list[str]) -> tuple[list[str], np.ndarray]:
    buckets, owner, has_letter = grams.buckets(texts)
    total = np.empty((len(texts), len(model.languages)))
    for j in range(len(model.languages)):
        column = np.ascontiguousarray(model.log_probability[:, j])
        total[:, j] = np.bincount(owner, weights=column[buckets], minlength=len(texts)) + model.log_prior[j]
    if not model.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    best = total.argmax(1)
    posterior = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    langs = [model.languages[i] if ok else UNDETERMINED for i, ok in zip(best, has_letter, strict=True)]
    return langs, np.where(has_letter, posterior, 0.0)


def held_out(key: str = "doc_id") -> Column:
    """One document in four is kept out of learning, by a checksum of its id."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % 4 == 2, F.lit(False))


def learn_from_documents(docs: DataFrame) -> LanguageModel:
    """Learn from the labelled rows that are not held out; rows without a key aren't used."""
    return learn(docs.where(~held_out() & F.col("doc_id").isNotNull()))


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text", name: str = "language") -> DataFrame:
    """Add a struct ``name`` of the predicted language and its posterior probability.

    NULL, empty texts and texts without a letter are ``und`` with score 0; equal
    texts get equal results, and the whole text counts. A column that is already
    called ``name`` is replaced, all others stay.
    """
    return docs.withColumn(name, scorer(docs.sparkSession, model)(F.col(f"`{text}`")))


def keep_known_language(docs: DataFrame, model: LanguageModel, *, text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The documents with a determined language of at least ``min_score``, unchanged."""
    name = "_language"
    found = identify(docs, model, text=text, name=name)
    sure = (F.col(f"{name}.lang") != UNDETERMINED) & (F.col(f"{name}.score") >= min_score)
    return found.where(sure).select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op7_language")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out."""
    docs = table(spark, folder, "documents")
    found = identify(docs.select("doc_id", "text"), learn_from_documents(docs))
    return found.select(
        "doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score")
    )
