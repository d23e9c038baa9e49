"""Operator 3: mix sources to target weights by Poisson replication.

A source's repetition rate is its target share of the mixture over its share of the
corpus. Each document gets a uniform number from a hash of its id and a seed; the
inverse of the Poisson distribution with that rate turns it into a number of copies.
Copies are dealt out and sorted by a hash, which shuffles the whole corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyscope.functions.groups import attach, one_row
from tallyscope.llm.common import query, table
from tallyscope.session import settle

SEED = "mix-1"
HEX = 13  # digits of a hash that a double holds exactly


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, HEX), 16, 10).cast("double") / F.lit(float(16**HEX))


def source_sizes(docs: DataFrame, source: str, size: Column) -> DataFrame:
    """Total size by source; a missing source is a source of its own."""
    return docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum(size.cast("bigint")).alias("size"))


def tempered_weights(sizes: DataFrame, exponent: float = 0.5) -> DataFrame:
    """Weights in proportion to a power of the size; below 1 this lifts small sources."""
    return sizes.select("source", F.pow(F.col("size").cast("double"), F.lit(exponent)).alias("weight"))


def repetition_rates(sizes: DataFrame, weights: DataFrame, budget: float = 1.0) -> DataFrame:
    """Mean copies per document by source, for ``budget`` times the corpus in all.

    Sources without a weight, or without size, have rate 0; weights need not add up to 1.
    """
    wanted = weights.groupBy(F.col("source").alias("_source")).agg(F.sum("weight").alias("weight"))
    joined = sizes.join(wanted, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    joined = settle(joined.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).cast("double")))
    all_ = one_row(joined.where("size > 0").agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")))
    share = F.try_divide(F.col("weight"), all_["weight"])
    rate = F.try_divide(share * budget * all_["size"].cast("double"), F.col("size").cast("double"))
    return joined.select("source", "size", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """Add the cumulative Poisson probabilities of 0, 1, 2 ... copies as an array.

    In logarithms, so that large rates do not underflow; the table ends where the
    tail is below what a double resolves.
    """
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    k = F.col("_k").cast("double")
    upto = Window.partitionBy("source", "rate").orderBy("_k")
    steps = (
        rates.where("rate > 0")
        .withColumn("_k", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("_ln", F.sum(F.log(F.greatest(k, F.lit(1.0)))).over(upto))
        .withColumn("_p", F.exp(k * F.log("rate") - F.col("rate") - F.col("_ln")))
        .withColumn("_c", F.sum("_p").over(upto))
    )
    pairs = F.array_sort(F.collect_list(F.struct("_k", "_c")))
    return steps.groupBy("source", "rate").agg(F.transform(pairs, lambda x: x["_c"]).alias("_table"))


def mix_sources(
    docs: DataFrame,
    weights: DataFrame | None = None,
    *,
    key: str = "doc_id",
    source: str = "source",
    size: Column | None = None,
    budget: float = 1.0,
    seed: str = SEED,
    copy: str = "copy",
) -> DataFrame:
    """Each document as often as its source's rate asks for, in random order.

    ``weights`` has the columns source and weight (default: square roots of the
    sizes); ``size`` is what weights are measured in (default: UTF-8 bytes). Adds
    ``copy`` (from 1; a column of that name is replaced). A document's number of
    copies depends only on its key, the seed and the rate; rows that repeat a key
    get equal numbers. A missing source is mixed as a source of its own, and a
    missing key counts as an empty one. An empty table gives an empty one.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1 if size is None else size
    # A source's key as text that NULL has too, as joins drop NULL.
    named = F.concat(F.col(f"`{source}`").isNull().cast("string"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")))
    sizes = settle(source_sizes(docs, source, size))
    rates = repetition_rates(sizes, tempered_weights(sizes) if weights is None else weights, budget)
    tables = poisson_tables(rates).select(
        F.concat(F.col("source").isNull().cast("string"), F.coalesce(F.col("source").cast("string"), F.lit(""))).alias("_mix"),
        "_table",
    )
    kept = [c for c in docs.columns if c != copy]
    rows = attach(docs.select(*[F.col(f"`{c}`") for c in kept], named.alias("_mix")), settle(tables), "_mix")
    rows = rows.withColumn("_u", uniform(seed, F.col(f"`{key}`")))
    count = F.size(F.filter("_table", lambda c: c <= F.col("_u")))
    copies = rows.where(F.col("_table").isNotNull()).withColumn("_n", count).where("_n > 0")
    copies = copies.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("_n"))))
    dealt = copies.withColumn("_deal", F.xxhash64(F.lit(seed), F.col(f"`{key}`"), F.col(copy)))
    return dealt.repartition("_deal").sortWithinPartitions("_deal").select(*[F.col(f"`{c}`") for c in kept], copy)


CHECK = f"""
WITH RECURSIVE d AS (SELECT doc_id, text, source, strlen(coalesce(text, '')) + 1 AS size,
  CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, {HEX}) AS BIGINT) / pow(16, {HEX}) AS u
  FROM documents),
s AS (SELECT source, sum(size) AS size, pow(CAST(sum(size) AS DOUBLE), 0.5) AS weight FROM d GROUP BY source),
r AS (SELECT source, weight / sum(weight) OVER () * CAST(sum(size) OVER () AS DOUBLE) / CAST(size AS DOUBLE) AS rate
  FROM s),
c AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS upto FROM r
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), upto + p * rate / (k + 1) FROM c
  WHERE k < rate + 12 * sqrt(rate) + 30),
n AS (SELECT doc_id, text, source, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM d.source AND c.upto <= d.u) AS n
  FROM d)
SELECT doc_id, source, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy, text FROM n
"""


@query("op3_mixture", CHECK)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus mixed so that a source's bytes go with the square root of its size."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    mixed = mix_sources(docs, copy="copy")
    return mixed.select("doc_id", "source", "copy", "text")
