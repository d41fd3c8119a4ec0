"""Whether generated sentences keep to their frame, by patterns: a smoke alarm, not a measurement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import JOINT, MUST, MUST_NOT
from ..schema import NONE


def _by_frame(patterns: dict[str, str], frame: Column, text: Column) -> Column:
    out = F.lit(None).cast("boolean")
    for name, p in patterns.items():
        out = F.when(frame == name, text.rlike(p)).otherwise(out)
    return out


def frame_report(rows: DataFrame) -> DataFrame:
    """(frame, n, has_marker, breaks_avoid) of rows (frame, sentence); null where a frame has no such pattern."""
    c = rows.select("frame", _by_frame(MUST, F.col("frame"), F.col("sentence")).alias("must"), _by_frame(MUST_NOT, F.col("frame"), F.col("sentence")).alias("mustnot"))
    return c.groupBy("frame").agg(F.count("*").alias("n"), F.avg(F.col("must").cast("double")).alias("has_marker"), F.avg(F.col("mustnot").cast("double")).alias("breaks_avoid"))


def error_count(raw: DataFrame) -> DataFrame:
    """(n, errors): attempts of a raw log, and those with an error or without a sample."""
    said = F.coalesce(F.col("error"), F.lit("")) != ""
    return raw.agg(F.count("*").alias("n"), F.count_if(said | F.coalesce("sample", F.lit("")).isin("", "{}", "null")).alias("errors"))


def breaches(report: DataFrame, limit: float = 0.15) -> DataFrame:
    return report.where(F.col("breaks_avoid").isNotNull() & (F.col("breaks_avoid") > limit))


def examples(rows: DataFrame, k: int = 3, breaching: int = 2, order: str = "spec_index") -> DataFrame:
    """The first k sentences of each frame and the first few that breach it."""
    bad = F.coalesce(_by_frame(MUST_NOT, F.col("frame"), F.col("sentence")), F.lit(False))
    r = rows.withColumn("breach", bad)
    first = r.withColumn("r", F.row_number().over(Window.partitionBy("frame").orderBy(order))).where(F.col("r") <= k).withColumn("what", F.lit("example"))
    worst = r.where("breach").withColumn("r", F.row_number().over(Window.partitionBy("frame").orderBy(order))).where(F.col("r") <= breaching).withColumn("what", F.lit("breach"))
    return first.unionByName(worst).select("frame", "what", "r", "sentence")


def regimen_joint_rate(rows: DataFrame) -> DataFrame:
    return rows.where("frame = 'regimen'").agg(F.coalesce(F.avg(F.col("sentence").rlike(JOINT).cast("double")), F.lit(0.0)).alias("joint_rate"))


def expected_positives(wanted: DataFrame, inst: DataFrame) -> DataFrame:
    """(n, matched, share, median_got): sentences whose resolved positives are as many as asked; wanted: sent_id, n_positive."""
    got = inst.where(F.col("label") != NONE).groupBy("sent_id").agg(F.count("*").alias("got"))
    j = wanted.join(got, "sent_id", "left")
    hit = F.coalesce("got", F.lit(0)) == F.col("n_positive")
    return j.agg(F.count("*").alias("n"), F.count_if(hit).alias("matched"), F.avg(hit.cast("double")).alias("share"), F.coalesce(F.median("got"), F.lit(0.0)).alias("median_got"))
