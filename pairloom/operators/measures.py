"""Measures of labelled instances, fused: one grouping by sentence serves all that count labels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.spans import near_marker, pair_bucket, stripped
from ..functions.stats import entropy, f1, share
from ..schema import NONE


def by_sentence(inst: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, sent_id, n, pos): rows and positives of each sentence; everything below is made of it.

    A missing sent_id is one sentence of its own, a missing label is positive.
    """
    pos = F.count_if(~F.col("label").eqNullSafe(NONE))
    return inst.groupBy(*(by or []), "sent_id").agg(F.count("*").alias("n"), pos.alias("pos"))


def label_measures(inst: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, n_sentences, positive_rate, pairs_per_sentence, hard_negative_rate, count_rule_f1; zeros for no rows."""
    n, pos = F.sum("n"), F.sum("pos")
    single = F.col("n") == 1
    tp, fp = F.sum(F.when(single, F.col("pos")).otherwise(0)), F.sum(F.when(single, F.col("n") - F.col("pos")).otherwise(0))
    missed = F.sum(F.when(single, 0).otherwise(F.col("pos")))
    mixed = F.sum(F.when(F.col("pos") > 0, F.col("n") - F.col("pos")).otherwise(0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    cols = {"n": zero(n), "n_sentences": F.count("*"), "positive_rate": share(zero(pos), zero(n)), "pairs_per_sentence": share(zero(n), F.count("*")), "hard_negative_rate": share(zero(mixed), zero(n - pos)), "count_rule_f1": f1(zero(tp), zero(fp), zero(missed))}
    return by_sentence(inst, by).groupBy(*(by or [])).agg(*(c.alias(k) for k, c in cols.items()))


def label_histogram(inst: DataFrame) -> DataFrame:
    return inst.groupBy("label").agg(F.count("*").alias("n"))


def crosstab(inst: DataFrame) -> DataFrame:
    """(bucket, pos, none, positive_rate) by how many pairs a sentence has."""
    s = by_sentence(inst).withColumn("bucket", pair_bucket(F.col("n")))
    return s.groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum(F.col("n") - F.col("pos")).alias("none"), (F.sum("pos") / F.sum("n")).alias("positive_rate"))


def first_texts(inst: DataFrame, order: str = "pair_no", by: list[str] | None = None) -> DataFrame:
    """(by, sent_id, plain): the stripped text of each sentence's first row."""
    return inst.groupBy(*(by or []), "sent_id").agg(stripped(F.min_by("text", order)).alias("plain"))


def gram_rows(texts: DataFrame, words: Column, n: int, *keep: str, name: str = "g") -> DataFrame:
    """(keep, name): one row a run of n words of each text, as ``ngrams`` would list them.

    Only places are exploded; a run is put together where it is counted, so no function
    runs for each of them.
    """
    w = texts.select(*keep, words.alias("__w"))
    at = w.select(*keep, "__w", F.explode(F.when(F.size("__w") >= n, F.sequence(F.lit(0), F.size("__w") - n))).alias("__i"))
    return at.select(*keep, F.concat_ws(" ", *(F.col("__w")[F.col("__i") + k] for k in range(n))).alias(name))


def text_measures(first: DataFrame, by: list[str] | None = None, column: str = "plain") -> DataFrame:
    """median_length in words, distinct_4 and opening_entropy in bits, over one text a sentence.

    distinct_4 is 0 where no text has four words; an empty text opens with nothing and counts as such.
    """
    by = by or []
    one = first if by else first.withColumn("__all", F.lit(1))
    key = by or ["__all"]
    w = one.select(*key, X.words(F.lower(column)).alias("w"))
    length = w.groupBy(*key).agg(F.median(F.size("w")).alias("median_length"))
    grams = gram_rows(w, F.col("w"), 4, *key).groupBy(*key, "g").agg(F.count("*").alias("c"))
    distinct = grams.groupBy(*key).agg((F.count("*") / F.sum("c")).alias("distinct_4"))
    opens = entropy(w.select(*key, X.opening(F.col("w")).alias("open")), "open", key, "opening_entropy")
    out = length.join(opens, key).join(distinct, key, "left").withColumn("distinct_4", F.coalesce("distinct_4", F.lit(0.0)))
    return out.select(*by, "median_length", "distinct_4", "opening_entropy")


def role_adjacency(inst: DataFrame, by: list[str] | None = None, chars: int = 60) -> DataFrame:
    """Counts of role words near either marker by label, the two rates, their difference (0 where a class is empty) and their ratio."""
    hit = near_marker(F.col("text"), chars).rlike(X.ROLE)
    pos = F.col("label") != NONE
    c = inst.select(*(by or []), hit.alias("hit"), pos.alias("pos")).groupBy(*(by or [])).agg(F.count_if("pos").alias("n_pos"), F.count_if(~F.col("pos")).alias("n_none"), F.count_if(F.col("pos") & F.col("hit")).alias("pos_hits"), F.count_if(~F.col("pos") & F.col("hit")).alias("none_hits"))
    p, n = share(F.col("pos_hits"), F.col("n_pos")), share(F.col("none_hits"), F.col("n_none"))
    return c.withColumn("pos_rate", p).withColumn("none_rate", n).withColumn("gap", F.when((F.col("n_pos") > 0) & (F.col("n_none") > 0), n - p).otherwise(0.0)).withColumn("ratio", F.when(p > 0, n / p))


def repeated_ngrams(texts: DataFrame, column: str = "text", n: int = 4) -> DataFrame:
    """distinct_n and repeated_mass over every record's n-grams; nulls where there is none."""
    grams = gram_rows(texts, X.words(F.lower(column)), n).groupBy("g").agg(F.count("*").alias("c"))
    return grams.agg((F.count("*") / F.sum("c")).alias("distinct_n"), (F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)) / F.sum("c")).alias("repeated_mass"))


def top_values(rows: DataFrame, value: Column, k: int, name: str = "value") -> DataFrame:
    """The k commonest values, equally common ones in their own order."""
    return rows.select(value.alias(name)).groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(k)


def pattern_profile(texts: DataFrame, patterns: dict[str, str], column: str = "text", by: list[str] | None = None) -> DataFrame:
    """The share of texts in which each pattern occurs, one column each."""
    return texts.groupBy(*(by or [])).agg(F.count("*").alias("n"), *(F.avg(F.col(column).rlike(p).cast("double")).alias(k) for k, p in patterns.items()))


_ENZYME = r"\bCYP\s?[0-9][A-Z][0-9]*\b"
#: What texts about mechanisms speak of.
MECHANISM = {
    "absorption": r"(?i)\babsorpt\w*",
    "bioavailability": r"(?i)\bbioavailab\w*",
    "clearance": r"(?i)\bclearance\b",
    "enzyme": r"(?i)\benzyme\w*",
    "exposure": r"(?i)\b(?:AUC|C ?max|half-?life|t1/2)\b",
    "fold_change": r"(?i)\d+\s?-?\s?fold",
    "induction": r"(?i)\binduc\w*",
    "inhibition": r"(?i)\binhibit\w*",
    "metabolism": r"(?i)\bmetaboli\w*",
    "named_enzyme": f"(?i){_ENZYME}",
    "percentage": r"\d+\s?%",
    "plasma": r"(?i)\bplasma (?:concentration|level)",
    "protein_binding": r"(?i)\bprotein[- ]bind\w*",
    "renal": r"(?i)\b(?:renal|excret\w*|urinary)",
    "serum": r"(?i)\bserum (?:concentration|level)",
    "steady_state": r"(?i)\bsteady[- ]state\b",
    "substrate": r"(?i)\bsubstrate\b",
    "transporter": r"(?i)\b(?:P-?gp|P-?glycoprotein|transporter)",
}


def enzyme_counts(texts: DataFrame, column: str = "text", k: int = 20) -> DataFrame:
    """(value, n): the k enzymes named most often, in capitals and without spaces."""
    each = texts.select(F.explode(F.regexp_extract_all(F.upper(F.col(column)), F.lit(_ENZYME), F.lit(0))).alias("e"))
    return top_values(each, F.replace("e", F.lit(" "), F.lit("")), k)


def joint_rate(inst: DataFrame, order: str = "pair_no") -> DataFrame:
    """Share of sentences without a positive whose first text reports a joint outcome."""
    s = inst.groupBy("sent_id").agg(F.count_if(F.col("label") != NONE).alias("pos"), stripped(F.min_by("text", order)).alias("plain")).where("pos = 0")
    return s.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.col("plain").rlike(X.JOINT).cast("double")), F.lit(0.0)).alias("joint_rate"))


#: Limits of the build gates: value, and whether the measure has to be at least or at most that.
THRESHOLDS = {"hard_negative_rate": (0.39, "min"), "count_rule_f1": (0.35, "max"), "probe_lift": (0.23, "max"), "role_adjacency_gap": (0.02, "max"), "role_position_skew": (0.75, "max"), "drift_rate": (0.15, "max")}


def gates(values: DataFrame) -> DataFrame:
    """(gate, value, threshold, side, passed) of a one-row frame of measures named like the thresholds."""
    spark = values.sparkSession
    names = [n for n in values.columns if n in THRESHOLDS]
    long = values.select(F.explode(F.create_map(*(x for n in names for x in (F.lit(n), F.col(n).cast("double"))))).alias("gate", "value"))
    limits = spark.createDataFrame([(n, *THRESHOLDS[n]) for n in names], "gate string, threshold double, side string")
    passed = F.when(F.col("side") == "min", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return long.join(F.broadcast(limits), "gate").withColumn("passed", passed)


def failed_gates(report: DataFrame) -> list[str]:
    return [r.gate for r in report.where(~F.col("passed")).orderBy("gate").collect()]


def assert_gates(report: DataFrame) -> None:
    if failed := failed_gates(report):
        raise AssertionError("gates failed: " + ", ".join(failed))


@dataclass(frozen=True)
class Measure:
    name: str
    tier: str
    of: Callable[[DataFrame, list[str]], DataFrame]
    column: str


def _labels(inst: DataFrame, by: list[str]) -> DataFrame:
    return label_measures(inst, by)


def _texts(inst: DataFrame, by: list[str]) -> DataFrame:
    return text_measures(first_texts(inst, by=by), by)


#: Measures by name; those that share a function are computed by one pass.
REGISTRY = [
    Measure("pairs per sentence", "labelled", _labels, "pairs_per_sentence"),
    Measure("positive rate", "labelled", _labels, "positive_rate"),
    Measure("hard negative rate", "labelled", _labels, "hard_negative_rate"),
    Measure("count-rule F1", "labelled", _labels, "count_rule_f1"),
    Measure("median sentence length", "unlabelled", _texts, "median_length"),
    Measure("distinct-4", "unlabelled", _texts, "distinct_4"),
    Measure("opening entropy", "unlabelled", _texts, "opening_entropy"),
    Measure("role adjacency, NONE", "labelled+spans", role_adjacency, "none_rate"),
    Measure("role adjacency gap", "labelled+spans", role_adjacency, "gap"),
]


def measured(inst: DataFrame, by: list[str], registry: list[Measure] | None = None) -> DataFrame:
    """(by, measurement, tier, value) for every group and measure."""
    registry = REGISTRY if registry is None else registry
    out = None
    for of in dict.fromkeys(m.of for m in registry):
        own = [m for m in registry if m.of is of]
        wide = of(inst, by)
        rows = F.explode(F.array(*(F.struct(F.lit(m.name).alias("measurement"), F.lit(m.tier).alias("tier"), F.col(m.column).cast("double").alias("value")) for m in own))).alias("m")
        part = wide.select(*by, rows).select(*by, "m.*")
        out = part if out is None else out.unionByName(part)
    return out
