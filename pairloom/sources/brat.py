"""Standoff-annotated documents: a text file and an annotation file of the same name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, root: str, split: str, ending: str) -> DataFrame:
    d = spark.read.text(f"{root}/{split}/*/*.{ending}", wholetext=True).select("value", F.input_file_name().alias("path"))
    return d.select("value", F.regexp_extract("path", rf"([^/]+)/[^/]+\.{ending}$", 1).alias("register"), F.regexp_extract("path", rf"([^/]+)\.{ending}$", 1).alias("doc_id"))


def parsed_annotations(ann: DataFrame) -> DataFrame:
    """(register, doc_id, entities, relations) of annotation files (value, register, doc_id).

    ``T`` lines are entities, with the outermost offsets of a span in several parts; ``R``
    lines are relations.  Other lines are left out.
    """
    lines = F.filter(F.split("value", "\r?\n"), lambda x: x.rlike("^[TR][^\t]*\t"))
    e = F.transform(F.filter(lines, lambda x: x.startswith("T")), lambda x: F.split(x, "\t"))
    span = lambda p: F.regexp_extract_all(p, F.lit(r"(\d+)"), F.lit(1))
    places = lambda p: span(F.regexp_replace(p, r"^\S+", ""))
    ents = F.transform(e, lambda p: F.struct(p[0].alias("id"), F.substring_index(p[1], " ", 1).alias("type"), places(p[1])[0].cast("int").alias("begin"), F.element_at(places(p[1]), -1).cast("int").alias("end"), F.try_element_at(p, F.lit(3)).alias("text")))
    r = F.transform(F.filter(lines, lambda x: x.startswith("R")), lambda x: F.split(x, "\t"))
    arg = lambda p, k: F.regexp_extract(p[1], rf"Arg{k}:(\S+)", 1)
    rels = F.transform(r, lambda p: F.struct(p[0].alias("id"), F.substring_index(p[1], " ", 1).alias("type"), arg(p, 1).alias("arg1"), arg(p, 2).alias("arg2")))
    return ann.select("register", "doc_id", ents.alias("entities"), rels.alias("relations"))


def read_brat(spark: SparkSession, root: str, split: str) -> DataFrame:
    """Documents of root/split/register/*.txt with their .ann; a text without annotations has none."""
    text = _files(spark, root, split, "txt").withColumnRenamed("value", "text")
    ann = parsed_annotations(_files(spark, root, split, "ann"))
    return text.join(ann, ["register", "doc_id"], "left").select("doc_id", "register", "text", "entities", "relations")
