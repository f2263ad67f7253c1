"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panemill.llm.common import keep_columns, table

#: Target shares of the mix; ``OTHER`` stands for all sources that are not named.
WEIGHTS = {f"src{i}": 3.0 if i == 0 else 2.0 if i < 8 else 1.0 for i in range(20)}
OTHER = "*"
OTHER_WEIGHT = 1.0
#: The mix is as large as so many passes over the whole input.
EPOCHS = 1.5
SEED = "mix-1"
ADDED = ("copy", "shuffle_key")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the hash of some values: 52 bits of md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, group: Column, weights: Mapping[str, float], *, epochs: float) -> DataFrame:
    """Mean repetitions for each group of ``weights``: (group, rate).

    The size of a document is its UTF-8 bytes and one more for its end. The rate of a group is what takes it from its
    own size to its weight's share of ``epochs`` times the whole size; weights of absent groups are shared out. It is null
    where all weights are 0.
    The result has no more rows than ``weights``.
    """
    spark = docs.sparkSession
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("bigint") + 1
    totals = docs.groupBy(group.alias("group")).agg(F.sum(size).cast("double").alias("size"))
    # rows of literals: a list would go through Python workers, which then stay in each executor's memory
    asked = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("group"), F.lit(float(w)).alias("weight")) for k, w in weights.items()])))
    sized = totals.join(F.broadcast(asked), "group")
    every = Window.partitionBy()  # as many rows as there are weights
    return sized.select("group", (F.try_divide("weight", F.sum("weight").over(every)) * F.lit(float(epochs)) * F.sum("size").over(every) / F.col("size")).alias("rate"))


def poisson_steps(rates: DataFrame) -> DataFrame:
    """The distribution function of each rate over ``first``, first + 1, ... copies as an array: (group, first, steps).

    It begins and ends where what is left out is below the grain of ``uniform``: a rate has some 20 of its square roots of
    steps, so that a tiny source that is repeated millions of times has some ten thousand. Steps are shares of their own
    sum, by quotients of neighbours: no step is lost to large numbers. A rate of 0 has no steps.
    """
    ends = [F.expr(f"CAST(greatest({x}, 0) AS BIGINT)") for x in ("floor(rate - 10 * sqrt(rate) - 30)", "ceil(rate + 10 * sqrt(rate) + 30)")]
    counts = rates.where("rate > 0").withColumn("first", ends[0]).withColumn("k", F.explode(F.sequence(ends[0], ends[1])))
    own, upto = Window.partitionBy("group"), Window.partitionBy("group").orderBy("k")
    quotient = F.when(F.col("k") > F.col("first"), F.log(F.col("rate") / F.col("k"))).otherwise(0.0)
    logs = counts.withColumn("log", F.sum(quotient).over(upto))
    shares = logs.withColumn("share", F.exp(F.col("log") - F.max("log").over(own)))
    sums = shares.withColumn("below", F.sum("share").over(upto) / F.sum("share").over(own))
    return sums.groupBy("group", "first").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "below"))), lambda s: s["below"]).alias("steps"))


def poisson_mix(docs: DataFrame, weights: Mapping[str, float], *, other_weight: float = OTHER_WEIGHT, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """Repeat each row of ``docs`` (doc_id, text, source, ...) by a Poisson count and shuffle all copies globally.

    The count inverts the Poisson distribution of the source's rate at a uniform number from a hash of ``seed`` and
    doc_id, so that a rerun of a lost task draws the same. Columns: those of ``docs``, ``copy`` (from 1) and
    ``shuffle_key``; rows are ordered by shuffle_key over all partitions. Columns of these two names in the input
    give way. Null and unnamed sources share ``other_weight``; a weight of 0 drops its source; null text counts as
    empty; rows with one id get the same count; a null id counts as the text ``null``; an empty table stays empty, and
    so does a mix whose sources all have weight 0. Negative weights raise ValueError. Texts are never looked into, whatever
    their length. A tiny source with a large weight is repeated as often as that takes; the numbers of one document's copies
    are one array until they are dealt, so that a rate should stay below some hundred million.

    A hot source costs nothing extra: its size is summed before the shuffle, its rate comes with a broadcast of at most
    len(weights) + 1 rows (and some 20 square roots of the rate in steps), and the copies are dealt by a hash.
    """
    weights = {**weights, OTHER: other_weight}
    if min(weights.values()) < 0 or epochs < 0:
        raise ValueError("weights and epochs are not negative")
    named = [k for k in weights if k != OTHER]
    group = F.coalesce(F.when(F.col("source").isin(named), F.col("source")), F.lit(OTHER))
    steps = poisson_steps(source_rates(docs, group, weights, epochs=epochs))
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), group.alias("group"), ident.alias("ident"), uniform(F.lit(seed), ident).alias("u"))
    drawn = rows.join(F.broadcast(steps), "group").withColumn("n", F.col("first") + F.size(F.filter("steps", lambda s: s <= F.col("u"))))
    copies = drawn.where("n > 0").select("row", "ident", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("ident"), F.col("copy")).cast("binary"))
    return copies.select(*keep_columns(docs, ADDED, "row"), "copy", key.alias("shuffle_key")).orderBy("shuffle_key")


def op1_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = poisson_mix(table(spark, sf_dir, "documents"), WEIGHTS)
    return mixed.select("doc_id", "source", "text", "copy", "shuffle_key")


SQL = f"""
WITH w(g, weight) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in {**WEIGHTS, OTHER: OTHER_WEIGHT}.items())}),
d AS (
  SELECT doc_id, source, text, strlen(coalesce(text, '')) + 1 AS size,
    CASE WHEN source IN (SELECT g FROM w WHERE g <> '{OTHER}') THEN source ELSE '{OTHER}' END AS g,
    CAST('0x' || substr(md5('{SEED}:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM documents),
t AS (SELECT g, CAST(sum(size) AS DOUBLE) AS size FROM d GROUP BY g),
r AS (SELECT g, weight / sum(weight) OVER () * {EPOCHS} * sum(size) OVER () / size AS rate FROM t JOIN w USING (g)),
k AS (SELECT g, rate, unnest(range(0, CAST(ceil(rate + 10 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM r WHERE rate > 0),
p AS (SELECT g, k, exp(-rate + k * ln(rate) - sum(ln(greatest(k, 1))) OVER (PARTITION BY g ORDER BY k)) AS p FROM k),
c AS (SELECT g, k, sum(p) OVER (PARTITION BY g ORDER BY k) AS below FROM p),
n AS (SELECT doc_id, source, text, unnest(range(1, 1 + (SELECT count(*) FROM c WHERE c.g = d.g AND c.below <= d.u))) AS copy FROM d)
SELECT doc_id, source, text, copy, md5('{SEED}:' || doc_id || ':' || copy) AS shuffle_key FROM n"""
