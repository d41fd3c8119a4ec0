"""Harmonic packing: pieces of like length share bins of a fixed count.

A piece of length l belongs to class min(floor(C / l), K) for bins of C tokens, and a bin
of class j takes j pieces of it: each is at most C / j long, so they fit whichever they
are.  Which pieces share a bin depends on nothing but their class and their shard, so
shards are filled independently of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TOKENIZER, shared_dir, table, token_lengths, written

CAPACITY, CLASSES = 2048, 64
#: Pieces of a shard, on average; the number of shards grows with the input.
SHARD = 50_000


def packed(lengths: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", capacity: int = CAPACITY, classes: int = CLASSES, shard: int = SHARD) -> DataFrame:
    """(doc_id, piece, start, length, class, shard, bin, slot) of every piece of every document.

    A document of more than ``capacity`` tokens is cut into full pieces and a rest.  Rows
    with a null id or without tokens (null, 0 or less) have no piece.  Rows that repeat an
    id are packed each; equal pieces take neighbouring slots.  ``bin`` counts from 0 in
    its class and shard; the last bin of each may have free slots.  Other columns are left
    out.  An empty table gives no bins.
    """
    rows = lengths.select(F.col(id_col).alias("doc_id"), F.col(length_col).cast("long").alias("n")).where("doc_id IS NOT NULL AND n > 0")
    pieces = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {capacity}"))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).alias("length"))
    count = rows.agg(F.sum(F.expr(f"(n - 1) div {capacity} + 1"))).first()[0] or 0
    shards = max(1, -(-count // shard))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", "doc_id", "piece")), 1, 8), 16, 10).cast("long")
    of = pieces.withColumn("class", F.least(F.lit(classes), F.expr(f"{capacity} div length")).cast("int")).withColumn("shard", (key % shards).cast("int"))
    place = F.row_number().over(Window.partitionBy("class", "shard").orderBy("doc_id", "piece", "length")) - 1
    out = of.withColumn("place", place)
    return out.select("doc_id", "piece", "start", "length", "class", "shard", F.expr("cast(place div class as int)").alias("bin"), (F.col("place") % F.col("class")).cast("int").alias("slot"))


def packed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY, classes: int = CLASSES, shard: int = SHARD) -> DataFrame:
    """The pieces of docs by the length of their whole texts in tokens; null and empty texts have none."""
    lengths = written(token_lengths(docs, id_col, text_col, tokenizer), f"{shared_dir(docs.sparkSession)}/lengths")
    return packed(lengths, "id", "n_tokens", capacity, classes, shard)


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document of the table with its place in a bin.

    Nulls, empty and long texts, ties, repeated rows, empty tables and further columns
    are as in ``packed`` and ``packed_texts``.
    """
    return packed_texts(table(spark, sf_dir, "documents"))
