"""The shape of an annotated corpus: how many entities, pairs and positives its sentences have, and how pairs stand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spans as P
from ..functions import text as X
from ..functions.stats import index_quantiles, share


def sentence_shape(sents: DataFrame, n_entities: str = "n_entities", n_positive: str = "n_positive", text: str = "text") -> DataFrame:
    """Counters of sentences by register in one pass."""
    e, p = F.col(n_entities), F.col(n_positive)
    pairs = F.expr(f"{n_entities} * ({n_entities} - 1) div 2")
    return sents.groupBy("register").agg(F.count("*").alias("sentences"), F.sum(pairs).alias("pairs"), F.sum(p).alias("positives"), share(F.sum(p), F.sum(pairs)).alias("positive_rate"), share(F.sum(pairs), F.count_if(e >= 2)).alias("pairs_per_multi_sentence"), F.count_if(e >= 2).alias("multi"), F.count_if((e >= 2) & (p == 0)).alias("multi_without_positive"), F.count_if(F.col(text).rlike(X.ANAPHORA)).alias("anaphora"), F.count_if(F.col(text).rlike(X.AFOREMENTIONED)).alias("aforementioned"))


def entity_distribution(sents: DataFrame, least: int = 0, n_entities: str = "n_entities") -> DataFrame:
    """(n_entities, sentences, share) of sentences with at least so many entities."""
    c = sents.where(F.col(n_entities) >= least).groupBy(F.col(n_entities).alias("n_entities")).agg(F.count("*").alias("sentences"))
    total = c.agg(F.sum("sentences").alias("total"))
    return c.crossJoin(F.broadcast(total)).select("n_entities", "sentences", (F.col("sentences") / F.col("total")).alias("share"))


def length_quantiles(sents: DataFrame, text: str = "text", by: list[str] | None = None) -> DataFrame:
    """Median and ninth decile of words by sorted index, and the most."""
    w = sents.select(*(by or []), X.n_words(F.col(text)).alias("words"))
    return index_quantiles(w, "words", {"median": 0.5, "p90": 0.9, "most": 1.0}, by)


def pair_structure(pairs: DataFrame) -> DataFrame:
    """(primary, label, n, median_gap): pairs need gap text, group1/2, degree1/2 and a label."""
    flags = P.pair_flags(F.col("gap"), F.col("group1"), F.col("group2"), F.col("degree1"), F.col("degree2"))
    return pairs.withColumn("primary", P.primary_flag(flags)).groupBy("primary", "label").agg(F.count("*").alias("n"), F.median(X.n_words(F.col("gap"))).alias("median_gap"))


def largest_sentences(sents: DataFrame, k: int = 40, chars: int = 400, n_entities: str = "n_entities") -> DataFrame:
    """The k sentences with most entities, their texts cut for display."""
    return sents.orderBy(F.desc(n_entities), "sent_id").limit(k).withColumn("text", F.left("text", F.lit(chars)))
