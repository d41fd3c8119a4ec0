"""Exact token counts for every context limit, from a histogram of encoded lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TOKENIZER, shared_dir, table, token_lengths, written


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """(length, n_docs, docs_from, tokens_from, docs_total, tokens_total, truncated) by distinct length.

    ``docs_from`` and ``tokens_from`` are suffix sums: documents at least so long, and
    their tokens.  ``truncated`` is the number of tokens left where every document is cut
    to this length.  Null lengths (null texts) are left out; empty texts have length 0.
    Equal lengths are one row; an empty table gives none.  Only the histogram, with as
    many rows as there are different lengths, is in one place.
    """
    return length_histogram_of(lengths.groupBy(F.col(length_col).alias("n_tokens")).count())


def truncated_total(histogram: DataFrame, limits: DataFrame, limit_col: str = "limit") -> DataFrame:
    """(limit, truncated, docs_cut) for any limits, exactly; null limits are left out and negative ones count as 0.

    A limit takes the suffix sums of the next greater length, in one ordered pass over
    lengths and limits; equal limits are one row.  Without a longer document nothing is
    cut; an empty histogram has totals of 0.
    """
    asked = limits.select(F.greatest(F.col(limit_col).cast("long"), F.lit(0).cast("long")).alias("limit")).where(F.col(limit_col).isNotNull()).distinct()
    h = histogram.select("length", F.struct("docs_from", "tokens_from").alias("next"), "tokens_total")
    both = h.select(F.col("length").alias("at"), "next", "tokens_total", F.lit(0).alias("asks")).unionByName(asked.select(F.col("limit").alias("at"), F.lit(None).cast(h.schema["next"].dataType).alias("next"), F.lit(None).cast("long").alias("tokens_total"), F.lit(1).alias("asks")))
    # a length equal to the limit comes before it, so what follows is longer
    after = Window.orderBy("at", "asks").rowsBetween(1, Window.unboundedFollowing)
    seen = both.withColumn("then", F.first("next", ignorenulls=True).over(after)).withColumn("total", F.max("tokens_total").over(Window.partitionBy())).where("asks = 1")
    cut = F.col("total") - F.coalesce("then.tokens_from", F.lit(0)) + F.coalesce("then.docs_from", F.lit(0)) * F.col("at")
    return seen.select(F.col("at").alias("limit"), F.coalesce(cut, F.lit(0)).alias("truncated"), F.coalesce("then.docs_from", F.lit(0)).alias("docs_cut"))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length that at least this share of documents doesn't exceed; none if there are no documents."""
    asked = histogram.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    reach = F.expr("docs_total - docs_from + n_docs >= share * docs_total")
    return histogram.crossJoin(F.broadcast(asked)).where(reach).groupBy("share").agg(F.min("length").alias("length"))


def token_histogram(docs: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """The histogram of docs, whole texts encoded, with equal lengths summed before anything moves."""
    lengths = token_lengths(docs.select(F.lit(0).alias("id"), text_col), "id", text_col, tokenizer)
    counts = written(lengths.groupBy("n_tokens").count(), f"{shared_dir(docs.sparkSession)}/histogram")
    return length_histogram_of(counts)


def length_histogram_of(counts: DataFrame) -> DataFrame:
    """length_histogram of rows (n_tokens, count)."""
    up = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    by = counts.where("n_tokens IS NOT NULL").groupBy(F.col("n_tokens").cast("long").alias("length")).agg(F.sum("count").alias("n_docs"))
    out = by.withColumn("docs_from", F.sum("n_docs").over(up)).withColumn("tokens_from", F.sum(F.expr("n_docs * length")).over(up))
    out = out.withColumn("docs_total", F.sum("n_docs").over(whole)).withColumn("tokens_total", F.sum(F.expr("n_docs * length")).over(whole))
    return out.withColumn("truncated", F.expr("tokens_total - tokens_from + docs_from * length"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of the whole documents table.

    Null texts are left out, empty ones have length 0, long ones are encoded whole;
    repeated rows count each, equal lengths are one row, an empty table gives none, and
    other columns are not read.
    """
    return token_histogram(table(spark, sf_dir, "documents"))
