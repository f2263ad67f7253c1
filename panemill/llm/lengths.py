"""Exact histogram of encoded lengths; its suffix sums answer every context limit."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panemill.llm.common import table, written
from panemill.llm.tokens import tokenizer_path, word_encoder

#: Lengths whose sums are carried together.
SPAN = 1024


def encoded_lengths(docs: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """(n_tokens) of each document's whole text; null and empty texts have length 0.

    Repeated rows count each; extra columns are left out; an empty table gives no rows. A very long text is encoded as a
    whole by one task, which holds its bytes and ids.
    """
    path = tokenizer or tokenizer_path()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(0), "").cast(pa.large_binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([len(x) // 4 for x in encoder.ids(texts)], pa.int64())], names=["n_tokens"])

    return docs.select("text").mapInArrow(measure, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """From (n_tokens) one row per length: the histogram and its sums.

    Columns: n_tokens; n_docs of this length; docs_at_least and tokens_at_least (sums over this length and all above);
    total_docs, total_tokens; truncated_tokens (the total if each document is cut at n_tokens); quantile (the share
    of documents not longer than n_tokens). Null lengths are left out; an empty table gives no rows.

    The first step counts before it shuffles. Sums then run within spans of 1,024 lengths, each in its own group,
    and over the spans, of which there is one for each 1,024 tokens of the longest document.
    """
    counts = lengths.where("n_tokens is not null").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")).withColumn("span", F.expr(f"n_tokens div {SPAN}"))
    counts = written(counts, "lengths")  # both sums read it: the texts are encoded once
    spans = counts.groupBy("span").agg(F.sum("n_docs").alias("span_docs"), F.sum(F.expr("n_docs * n_tokens")).alias("span_tokens"))
    above, every = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    spans = spans.select("span", *[F.coalesce(F.sum(f"span_{x}").over(above), F.lit(0)).alias(f"{x}_above") for x in ("docs", "tokens")], *[F.sum(f"span_{x}").over(every).alias(f"total_{x}") for x in ("docs", "tokens")])
    down = Window.partitionBy("span").orderBy(F.desc("n_tokens"))
    inner = counts.select("span", "n_tokens", "n_docs", F.sum("n_docs").over(down).alias("docs_here"), F.sum(F.expr("n_docs * n_tokens")).over(down).alias("tokens_here"))
    joined = inner.join(spans, "span").select("n_tokens", "n_docs", (F.col("docs_here") + F.col("docs_above")).alias("docs_at_least"), (F.col("tokens_here") + F.col("tokens_above")).alias("tokens_at_least"), "total_docs", "total_tokens")
    return joined.select("*", F.expr("total_tokens - tokens_at_least + docs_at_least * n_tokens").alias("truncated_tokens"), F.expr("(total_docs - docs_at_least + n_docs) / total_docs").alias("quantile"))


def context_totals(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """For each limit: docs_over (longer ones), truncated_tokens (each cut at the limit), tokens_lost, tokens_fitting
    (of the documents that fit). Limits may lie between lengths; one that is named twice has one row; without limits there
    are no rows; an empty histogram gives zeros."""
    limits = sorted({int(x) for x in limits})
    asked = histogram.sparkSession.createDataFrame([(x,) for x in limits], "context_limit long")
    sums = [F.sum(x) for x in ("n_docs", "docs_over", "truncated", "fitting", "tokens")]
    names = ("docs", "docs_over", "truncated_tokens", "tokens_fitting", "tokens")
    each = histogram.select("n_tokens", "n_docs").withColumn("context_limit", F.explode(F.array(*[F.lit(x) for x in limits]).cast("array<long>")))
    each = each.select("context_limit", "n_docs", F.when(F.expr("n_tokens > context_limit"), F.col("n_docs")).otherwise(0).alias("docs_over"), F.expr("n_docs * least(n_tokens, context_limit)").alias("truncated"), F.when(F.expr("n_tokens <= context_limit"), F.expr("n_docs * n_tokens")).otherwise(0).alias("fitting"), F.expr("n_docs * n_tokens").alias("tokens"))
    found = each.groupBy("context_limit").agg(*[s.alias(n) for s, n in zip(sums, names, strict=True)])
    filled = asked.join(found, "context_limit", "left").na.fill(0)
    return filled.withColumn("tokens_lost", F.col("tokens") - F.col("truncated_tokens"))


def length_quantiles(histogram: DataFrame, shares: Sequence[float]) -> DataFrame:
    """The least length at or below which at least each share of the documents lies: (share, n_tokens), once for each."""
    asked = histogram.withColumn("share", F.explode(F.array(*[F.lit(x) for x in sorted({float(x) for x in shares})]).cast("array<double>")))
    return asked.where("quantile >= share").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def op6_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(encoded_lengths(table(spark, sf_dir, "documents")))
