"""Scores of predictions against gold labels, from confusion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import entity_bucket
from ..functions.stats import f1, share
from ..schema import LABELS, NONE, POSITIVE


def confusion(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    return pred.groupBy(*(by or []), "label", "predicted").agg(F.count("*").alias("n"))


def per_label(pred: DataFrame, labels: tuple[str, ...] = POSITIVE) -> DataFrame:
    """(label, precision, recall, f1, support) of each label, also of those that don't occur."""
    c = confusion(pred)
    n = F.sum("n")
    gold = c.groupBy("label").agg(n.alias("support"))
    said = c.groupBy(F.col("predicted").alias("label")).agg(n.alias("said"))
    hit = c.where("label = predicted").groupBy("label").agg(n.alias("hit"))
    names = pred.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    j = names.join(gold, "label", "left").join(said, "label", "left").join(hit, "label", "left").fillna(0)
    s, p, h = F.col("support"), F.col("said"), F.col("hit")
    return j.select("label", share(h, p).alias("precision"), share(h, s).alias("recall"), f1(h, p - h, s - h).alias("f1"), s.alias("support"))


def micro(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Micro precision, recall and F1 over positive labels, and the number of rows."""
    hit = F.count_if((F.col("label") == F.col("predicted")) & (F.col("label") != NONE)).alias("hit")
    c = pred.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count_if(F.col("label") != NONE).alias("gold"), F.count_if(F.col("predicted") != NONE).alias("said"), hit)
    h, g, s = F.col("hit"), F.col("gold"), F.col("said")
    return c.select(*(by or []), "n", share(h, s).alias("precision"), share(h, g).alias("recall"), f1(h, s - h, g - h).alias("f1"))


def macro(pred: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Accuracy and macro-averaged precision, recall and F1 over the labels."""
    acc = pred.agg(F.coalesce(F.avg((F.col("label") == F.col("predicted")).cast("double")), F.lit(0.0)).alias("accuracy"))
    return per_label(pred, labels).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1")).crossJoin(acc)


def bucket_scores(pred: DataFrame, size: str = "n_entities") -> DataFrame:
    """(bucket, n, support, predicted, correct, precision, recall, f1) by entities in the sentence; rows without a number count as 'other'.

    Predicted counts any positive, correct needs the label itself.
    """
    b = pred.withColumn("bucket", F.coalesce(entity_bucket(F.col(size)), F.lit("other")))
    ok = (F.col("label") == F.col("predicted")) & (F.col("label") != NONE)
    c = b.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.col("label") != NONE).alias("support"), F.count_if(F.col("predicted") != NONE).alias("predicted"), F.count_if(ok).alias("correct"))
    k, p, s = F.col("correct"), F.col("predicted"), F.col("support")
    return c.withColumn("precision", share(k, p)).withColumn("recall", share(k, s)).withColumn("f1", f1(k, p - k, s - k))


def missing_keys(pred: DataFrame, size: str = "n_entities") -> DataFrame:
    """(n, missing): predictions, and those whose sentence has no entity count."""
    return pred.agg(F.count("*").alias("n"), F.count_if(F.col(size).isNull()).alias("missing"))


def false_positive_rates(buckets: DataFrame) -> DataFrame:
    """(bucket, fp, negatives, fpr, fp_share) of bucket scores."""
    fp, neg = F.col("predicted") - F.col("correct"), F.col("n") - F.col("support")
    total = F.sum("fp").over(Window.partitionBy())
    return buckets.select("bucket", fp.alias("fp"), neg.alias("negatives"), share(fp, neg).alias("fpr")).withColumn("fp_share", share(F.col("fp"), total))


def pair_shares(sizes: DataFrame, size: str = "n_entities") -> DataFrame:
    """(bucket, sentences, pairs, sentence_share, pair_share) by entities in the sentence."""
    n = F.col(size)
    c = sizes.groupBy(entity_bucket(n).alias("bucket")).agg(F.count("*").alias("sentences"), F.sum(F.expr(f"{size} * ({size} - 1) div 2")).alias("pairs"))
    whole = Window.partitionBy()
    return c.withColumn("sentence_share", F.col("sentences") / F.sum("sentences").over(whole)).withColumn("pair_share", share(F.col("pairs"), F.sum("pairs").over(whole)))


def side_by_side(a: DataFrame, b: DataFrame, on: str, names: tuple[str, str]) -> DataFrame:
    """Two tables with the same columns joined on a key, with suffixes."""
    left = a.select(on, *(F.col(c).alias(f"{c}_{names[0]}") for c in a.columns if c != on))
    return left.join(b.select(on, *(F.col(c).alias(f"{c}_{names[1]}") for c in b.columns if c != on)), on)


def fidelity(pred: DataFrame) -> DataFrame:
    """(label, n, fidelity, positive_share): how often a class is predicted as asked, and how often as any positive."""
    hit = (F.col("label") == F.col("predicted")).cast("double")
    return pred.groupBy("label").agg(F.count("*").alias("n"), F.avg(hit).alias("fidelity"), F.avg((F.col("predicted") != NONE).cast("double")).alias("positive_share"))


def confusion_matrix(pred: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    return pred.groupBy("label").pivot("predicted", list(labels)).count().fillna(0)


def calibration(verdicts: DataFrame, base_rate: float = 0.03, n_none: int = 31000) -> DataFrame:
    """tn, fp, fn, tp of (gold_pos, flagged), recalls, accuracy, and the precision of flags on n_none negatives of which base_rate have drifted."""
    g, f = F.col("gold_pos"), F.col("flagged")
    c = verdicts.agg(F.count_if(~g & ~f).alias("tn"), F.count_if(~g & f).alias("fp"), F.count_if(g & ~f).alias("fn"), F.count_if(g & f).alias("tp"))
    tn, fp, fn, tp = map(F.col, ("tn", "fp", "fn", "tp"))
    c = c.withColumn("none_recall", tn / F.greatest(tn + fp, F.lit(1))).withColumn("pos_recall", tp / F.greatest(tp + fn, F.lit(1))).withColumn("accuracy", share(tn + tp, tn + fp + fn + tp))
    false = (n_none - n_none * base_rate) * (1 - F.col("none_recall"))
    true = n_none * base_rate * F.col("pos_recall")
    return c.withColumn("false_flags", false).withColumn("true_flags", true).withColumn("flag_precision", true / F.greatest(false + true, F.lit(1)))


def corrected_drift(raw: Column, false_rate: Column, pos_recall: Column) -> Column:
    """The true share behind a flagged share, never below 0."""
    return F.greatest((raw - false_rate) / F.greatest(pos_recall - false_rate, F.lit(1e-9)), F.lit(0.0))


def arm_summary(curve: DataFrame, by: list[str], value: str = "f1") -> DataFrame:
    """(by, mean, sd, n): sample standard deviation, null for one run."""
    return curve.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count("*").alias("n"))


def curve_summary(curve: DataFrame, base: str, other: str) -> DataFrame:
    """(n_sentences, both means and sds, delta, pooled_sd) of two arms by budget."""
    s = arm_summary(curve, ["n_sentences", "arm"])
    one = lambda arm, x: s.where(F.col("arm") == arm).select("n_sentences", F.col("mean").alias(f"mean_{x}"), F.col("sd").alias(f"sd_{x}"))
    return one(base, "base").join(one(other, "other"), "n_sentences").withColumn("delta", F.col("mean_other") - F.col("mean_base")).withColumn("pooled_sd", F.sqrt(F.col("sd_base") ** 2 + F.col("sd_other") ** 2))


def minimum_n(stability: DataFrame, effects: DataFrame) -> DataFrame:
    """(measurement, detect_n, estimate_n): the least size whose sd is under a third of the effect, and whose sd and bias are small beside the corpus value.

    stability has measurement, n_sentences, sd, bias; effects has measurement, corpus, effect.
    """
    j = stability.join(effects, "measurement")
    c = F.abs("corpus")
    return j.groupBy("measurement").agg(F.min(F.when(F.col("sd") * 3 < F.abs("effect"), F.col("n_sentences"))).alias("detect_n"), F.min(F.when((F.col("sd") < 0.2 * c) & (F.abs("bias") < 0.1 * c), F.col("n_sentences"))).alias("estimate_n"))
