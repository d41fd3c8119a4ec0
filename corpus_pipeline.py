"""Documents to packed training pieces: the stages, in order, and the whole run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import decontaminate, langid, packing, simhash
from pairloom.llm.common import fresh, shared_dir, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compressed sizes tell apart stay, with their columns as they are.

    Null and empty texts have no language and go; long texts are looked at whole; equal
    sizes are no decision, so such texts go; repeated rows are decided alike; an empty
    table stays empty; columns named like the helpers' are kept.
    """
    names = tuple(fresh(docs, n) for n in ("__language", "__margin", "__accepted"))
    found = langid.identified(docs, langid.dictionaries(docs), out=names)
    return found.where(F.col(names[2])).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies stays: the one with the least id.

    Rows with a null id or text stay; empty texts are copies of each other; long texts
    count whole; equal rows are one; an empty table stays empty; other columns, whatever
    their names, stay as they are.
    """
    return simhash.without_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents mostly made of them go.

    Rows with a null or empty text, or without a passage, stay as they are; long texts
    are scanned whole; repeated rows are cut alike; there are no ties; an empty table stays
    empty; other columns stay, but for the length that follows the text.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a bin.

    Null ids, null and empty texts have no piece; long texts are cut into full pieces and
    a rest; equal pieces take neighbouring slots; repeated rows are packed each; an empty
    table has no bin; other columns are not read.
    """
    return packing.packed_texts(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Compressed sizes, fingerprints and tokens are no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    at = shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
