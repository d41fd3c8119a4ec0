"""Queries over labels: measures, draws and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import measures as M
from ..operators import sampling as R
from ..operators import scoring as A
from ..operators.divergence import compare, stability
from ..operators.pairs import below_cap
from ..schema import LABELS, POSITIVE
from .views import ORDERS, PREDICTIONS, orders, predictions, sql_digit, table



def _measures_sql(by: str, head: str = ORDERS, t: str = "inst") -> str:
    per = f"per AS (SELECT {by}{', ' if by else ''}sent_id, count(*) AS n, count(*) FILTER (label <> 'NONE') AS pos FROM {t} GROUP BY {by}{', ' if by else ''}sent_id)"
    return f"""WITH {head}, {per}, c AS (SELECT {by}{', ' if by else ''}sum(n) AS n, count(*) AS ns, sum(pos) AS pos, sum(CASE WHEN pos > 0 THEN n - pos ELSE 0 END) AS mixed,
  sum(CASE WHEN n = 1 THEN pos ELSE 0 END) AS tp, sum(CASE WHEN n = 1 THEN n - pos ELSE 0 END) AS fp, sum(CASE WHEN n > 1 THEN pos ELSE 0 END) AS fn FROM per {"GROUP BY " + by if by else ""})
SELECT {by}{', ' if by else ''}CAST(n AS BIGINT) AS n, ns AS n_sentences, CAST(pos AS DOUBLE) / n AS positive_rate, CAST(n AS DOUBLE) / ns AS pairs_per_sentence,
  CASE WHEN n > pos THEN CAST(mixed AS DOUBLE) / (n - pos) ELSE 0 END AS hard_negative_rate, CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0 END AS count_rule_f1 FROM c"""


def measures_by_source(spark: SparkSession, d: str) -> DataFrame:
    return M.label_measures(orders(spark, d), ["source"])


def gates(spark: SparkSession, d: str) -> DataFrame:
    return M.gates(M.label_measures(orders(spark, d)))


def compared(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d)
    own = [m for m in M.REGISTRY if m.of is M._labels]
    return compare(o.where("source = 'O'"), o.where("source = 'F'"), own, seed=7)


def stable(spark: SparkSession, d: str) -> DataFrame:
    own = [m for m in M.REGISTRY if m.of is M._labels]
    s = stability(orders(spark, d), [50, 200], 5, 3, own)
    return s.select("measurement", "n_sentences", F.round("median", 6).alias("median"), F.round("sd", 6).alias("sd"), F.round("full", 6).alias("full"))


def _rank(seed: str, key: str, where: str = "") -> str:
    return f"row_number() OVER (ORDER BY md5('{seed}:' || {key}), {key})"


_COUNTS = "sum(n) AS n, count(*) AS ns, sum(pos) AS pos, sum(CASE WHEN pos > 0 THEN n - pos ELSE 0 END) AS mixed, sum(CASE WHEN n = 1 THEN pos ELSE 0 END) AS tp, sum(CASE WHEN n = 1 THEN n - pos ELSE 0 END) AS fp, sum(CASE WHEN n > 1 THEN pos ELSE 0 END) AS fn"
_VALUES = "unnest([CAST(n AS DOUBLE) / ns, CAST(pos AS DOUBLE) / n, CASE WHEN n > pos THEN CAST(mixed AS DOUBLE) / (n - pos) ELSE 0 END, CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0 END]) AS value, unnest(['pairs per sentence', 'positive rate', 'hard negative rate', 'count-rule F1']) AS measurement"

COMPARE_SQL = f"""WITH {ORDERS}, per AS (SELECT source, sent_id, count(*) AS n, count(*) FILTER (label <> 'NONE') AS pos FROM inst WHERE source IN ('O', 'F') GROUP BY source, sent_id),
least_n AS (SELECT min(c) AS k FROM (SELECT count(*) AS c FROM per GROUP BY source)),
cut AS (SELECT source, n, pos FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || sent_id), sent_id) AS r FROM per) WHERE r <= (SELECT k FROM least_n)),
c AS (SELECT source, {_COUNTS} FROM cut GROUP BY source), v AS (SELECT source, {_VALUES} FROM c),
w AS (SELECT measurement, max(value) FILTER (source = 'O') AS corpus, max(value) FILTER (source = 'F') AS synth FROM v GROUP BY measurement)
SELECT measurement, 'labelled' AS tier, corpus, synth, synth - corpus AS gap, CASE WHEN corpus <> 0 THEN synth / corpus ELSE CAST('nan' AS DOUBLE) END AS ratio FROM w"""

STABLE_SQL = f"""WITH {ORDERS}, per AS (SELECT sent_id, count(*) AS n, count(*) FILTER (label <> 'NONE') AS pos FROM inst GROUP BY sent_id),
draws AS (SELECT size, draw FROM (VALUES (50), (200)) AS a(size), (SELECT unnest(range(5)) AS draw) WHERE size <= (SELECT count(*) FROM per)),
drawn AS (SELECT size, draw, n, pos FROM (SELECT *, row_number() OVER (PARTITION BY size, draw ORDER BY md5('3:' || size || ':' || draw || ':' || sent_id), sent_id) AS r FROM per, draws) WHERE r <= size),
c AS (SELECT size, draw, {_COUNTS} FROM drawn GROUP BY size, draw), v AS (SELECT size, {_VALUES} FROM c),
f AS (SELECT {_VALUES} FROM (SELECT {_COUNTS} FROM per))
SELECT v.measurement, CAST(size AS INTEGER) AS n_sentences, round(median(v.value), 6) AS median, round(stddev_samp(v.value), 6) AS sd, round(any_value(f.value), 6) AS "full" FROM v JOIN f ON v.measurement = f.measurement GROUP BY v.measurement, size"""


def composition_arms(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the ablation arms: everything, cut to a third of the rows, negatives cut to even shares."""
    o = orders(spark, d).where("source = 'O'")
    n = o.count()
    arms = {"full": o, "sized": R.sample_to_rows(o, n // 3, 1), "negcap": R.match_positive_rate(o, 0.6, 1, "key")}
    out = None
    for name, rows in arms.items():
        s = M.label_measures(rows).select(F.lit(name).alias("arm"), "n", "n_sentences", "positive_rate", "pairs_per_sentence", "hard_negative_rate")
        out = s if out is None else out.unionByName(s)
    return out


def _arm(name: str, rows: str) -> str:
    return f"""SELECT '{name}' AS arm, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_sentences, CAST(sum(pos) AS DOUBLE) / sum(n) AS positive_rate, CAST(sum(n) AS DOUBLE) / count(*) AS pairs_per_sentence,
  CASE WHEN sum(n) > sum(pos) THEN CAST(sum(CASE WHEN pos > 0 THEN n - pos ELSE 0 END) AS DOUBLE) / (sum(n) - sum(pos)) ELSE 0 END AS hard_negative_rate
FROM (SELECT sent_id, count(*) AS n, count(*) FILTER (label <> 'NONE') AS pos FROM {rows} GROUP BY sent_id)"""


ARMS_SQL = f"""WITH {ORDERS.replace("inst AS", "whole AS")}, inst AS (SELECT * FROM whole WHERE source = 'O'),
sizes AS (SELECT sent_id, count(*) AS size FROM inst GROUP BY sent_id),
run AS (SELECT sent_id, coalesce(sum(size) OVER (ORDER BY md5('1:' || sent_id), sent_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sizes),
sized AS (SELECT inst.* FROM inst JOIN run USING (sent_id) WHERE before < (SELECT count(*) // 3 FROM inst)),
neg AS (SELECT sent_id, label, key, {_rank("1", "key")} AS r FROM inst WHERE label = 'NONE'),
lim AS (SELECT CAST(trunc((SELECT count(*) FROM inst WHERE label <> 'NONE') * (1 - 0.6::DOUBLE) / 0.6::DOUBLE) AS BIGINT) AS k),
negcap AS (SELECT sent_id, label FROM inst WHERE label <> 'NONE' UNION ALL SELECT sent_id, label FROM neg WHERE r <= (SELECT k FROM lim))
{_arm("full", "inst")} UNION ALL {_arm("sized", "sized")} UNION ALL {_arm("negcap", "negcap")}"""


def events_arms(spark: SparkSession, d: str) -> DataFrame:
    """Runs by arm and seed: event types as arms, mean and sample deviation of their values."""
    e = table(spark, d, "events").select(F.col("event_type").alias("arm"), F.col("value").alias("f1"))
    return A.arm_summary(e, ["arm"]).select("arm", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "n")


def curve(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("user_id") % 4 * 100 + 100).alias("n_sentences"), F.when(F.col("event_id") % 2 == 0, "human").otherwise("mixed").alias("arm"), F.col("value").alias("f1"))
    return A.curve_summary(e, "human", "mixed").select("n_sentences", *(F.round(c, 6).alias(c) for c in ("mean_base", "mean_other", "delta", "pooled_sd")))


def verdict_pairs(pred: DataFrame) -> DataFrame:
    return pred.select((F.col("label") != "NONE").alias("gold_pos"), (F.col("predicted") != "NONE").alias("flagged"))


QUERIES = {
    "measures_by_source": measures_by_source,
    "score_missing_keys": lambda s, d: A.missing_keys(predictions(s, d).withColumn("n_entities", F.when(F.col("n_entities") > 2, F.col("n_entities")))),
    "measures_all": lambda s, d: M.label_measures(orders(s, d)),
    "label_histogram": lambda s, d: M.label_histogram(orders(s, d)),
    "label_crosstab": lambda s, d: M.crosstab(orders(s, d)),
    "build_gates": gates,
    "cap_by_group_size": lambda s, d: below_cap(orders(s, d), 5),
    "compare_sources": compared,
    "stability_table": stable,
    "sample_rows_by_hash": lambda s, d: R.take(orders(s, d).select("sent_id", "label", "key"), 500, 11, "key"),
    "sample_downsample_negatives": lambda s, d: R.downsample_negatives(orders(s, d).select("label", "key"), 0.5, 5, "key"),
    "sample_match_positive_rate": lambda s, d: R.match_positive_rate(orders(s, d).select("label", "key"), 0.6, 5, "key"),
    "sample_none_share": lambda s, d: R.mix_to_none_share(orders(s, d).where("label = 'ADVISE'").select("label", "key"), orders(s, d).where("label = 'NONE'").select("label", "key"), 0.4, 5, "key"),
    "sample_whole_groups": lambda s, d: R.sample_groups(orders(s, d), 300, 5),
    "sample_groups_to_rows": lambda s, d: R.sample_to_rows(orders(s, d), 1000, 5),
    "sample_document_split": lambda s, d: R.split_by_hash(table(s, d, "documents").select("doc_id"), 4, "doc_id", parts={"train": 0.7, "dev": 0.15, "val": 0.15}),
    "sample_every_nth": lambda s, d: R.every(table(s, d, "part").select("p_partkey", "p_name"), 10, 20, "p_partkey"),
    "sample_match_composition": lambda s, d: R.match_composition(orders(s, d), 3.0, 1000, 2),
    "composition_arms": composition_arms,
    "score_per_label": lambda s, d: A.per_label(predictions(s, d)),
    "score_micro": lambda s, d: A.micro(predictions(s, d)),
    "score_micro_by_source": lambda s, d: A.micro(predictions(s, d), ["source"]),
    "score_macro": lambda s, d: A.macro(predictions(s, d)).select(*(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy"))),
    "score_by_bucket": lambda s, d: A.bucket_scores(predictions(s, d)),
    "score_false_positive_rates": lambda s, d: A.false_positive_rates(A.bucket_scores(predictions(s, d))),
    "score_pair_shares": lambda s, d: A.pair_shares(predictions(s, d).select("sent_id", "n_entities").distinct()),
    "score_buckets_side_by_side": lambda s, d: A.side_by_side(*(A.bucket_scores(predictions(s, d).where(F.col("source") == x)).select("bucket", "n", "f1") for x in "OF"), "bucket", ("o", "f")),
    "score_class_fidelity": lambda s, d: A.fidelity(predictions(s, d)),
    "score_confusion_matrix": lambda s, d: A.confusion_matrix(predictions(s, d)),
    "score_calibration": lambda s, d: A.calibration(verdict_pairs(predictions(s, d))),
    "curve_arm_summary": events_arms,
    "curve_two_arms": curve,
}

_F1 = "CASE WHEN said + gold > 0 THEN 2.0::DOUBLE * hit / (said + gold) ELSE 0 END"
_P, _R = "CASE WHEN said > 0 THEN CAST(hit AS DOUBLE) / said ELSE 0 END", "CASE WHEN gold > 0 THEN CAST(hit AS DOUBLE) / gold ELSE 0 END"
_MICRO = "count(*) AS n, count(*) FILTER (label <> 'NONE') AS gold, count(*) FILTER (predicted <> 'NONE') AS said, count(*) FILTER (label = predicted AND label <> 'NONE') AS hit"
_PER = "per AS (SELECT l AS label, (SELECT count(*) FROM pred WHERE label = l) AS gold, (SELECT count(*) FROM pred WHERE predicted = l) AS said, (SELECT count(*) FROM pred WHERE label = l AND predicted = l) AS hit FROM (SELECT unnest([{}]) AS l))"
_BUCKET = "CASE WHEN n_entities >= 20 THEN '20+' WHEN n_entities >= 10 THEN '10-19' WHEN n_entities >= 6 THEN '6-9' WHEN n_entities >= 4 THEN '4-5' WHEN n_entities = 3 THEN '3-3' WHEN n_entities = 2 THEN '2-2' ELSE 'other' END"
_BUCKETS = f"b AS (SELECT source, {_BUCKET} AS bucket, label, predicted FROM pred)"
_SPLIT = f"{sql_digit(chr(39) + '4:' + chr(39) + ' || CAST(doc_id AS VARCHAR)')} / 4294967296.0::DOUBLE"

ORACLES = {
    "score_missing_keys": f"WITH {PREDICTIONS} SELECT count(*) AS n, count(*) FILTER (n_entities <= 2) AS missing FROM pred",
    "measures_by_source": _measures_sql("source"),
    "measures_all": _measures_sql(""),
    "label_histogram": f"WITH {ORDERS} SELECT label, count(*) AS n FROM inst GROUP BY label",
    "label_crosstab": f"""WITH {ORDERS}, per AS (SELECT sent_id, count(*) AS n, count(*) FILTER (label <> 'NONE') AS pos FROM inst GROUP BY sent_id)
SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 9 THEN '4-9' ELSE '10+' END AS bucket, CAST(sum(pos) AS BIGINT) AS pos, CAST(sum(n - pos) AS BIGINT) AS "none", CAST(sum(pos) AS DOUBLE) / sum(n) AS positive_rate FROM per GROUP BY 1""",
    "build_gates": f"""WITH m AS ({_measures_sql("")}) SELECT 'hard_negative_rate' AS gate, hard_negative_rate AS value, 0.39::DOUBLE AS threshold, 'min' AS side, hard_negative_rate >= 0.39 AS passed FROM m
UNION ALL SELECT 'count_rule_f1', count_rule_f1, 0.35::DOUBLE, 'max', count_rule_f1 <= 0.35 FROM m""",
    "cap_by_group_size": f"WITH {ORDERS} SELECT sent_id, label, source, key FROM (SELECT *, count(*) OVER (PARTITION BY sent_id) AS c FROM inst) WHERE c < 5",
    "compare_sources": COMPARE_SQL,
    "stability_table": STABLE_SQL,
    "sample_rows_by_hash": f"WITH {ORDERS} SELECT sent_id, label, key FROM (SELECT *, {_rank('11', 'key')} AS r FROM inst) WHERE r <= 500",
    "sample_downsample_negatives": f"WITH {ORDERS} SELECT label, key FROM inst WHERE label <> 'NONE' UNION ALL SELECT label, key FROM (SELECT *, {_rank('5', 'key')} AS r FROM inst WHERE label = 'NONE') WHERE r <= (SELECT CAST(trunc(count(*) * 0.5) AS BIGINT) FROM inst WHERE label <> 'NONE')",
    "sample_match_positive_rate": f"WITH {ORDERS} SELECT label, key FROM inst WHERE label <> 'NONE' UNION ALL SELECT label, key FROM (SELECT *, {_rank('5', 'key')} AS r FROM inst WHERE label = 'NONE') WHERE r <= (SELECT CAST(trunc(count(*) * (1 - 0.6::DOUBLE) / 0.6::DOUBLE) AS BIGINT) FROM inst WHERE label <> 'NONE')",
    "sample_none_share": f"WITH {ORDERS} SELECT label, key FROM inst WHERE label = 'ADVISE' UNION ALL SELECT label, key FROM (SELECT *, {_rank('5', 'key')} AS r FROM inst WHERE label = 'NONE') WHERE r <= (SELECT CAST(round_even(count(*) * 0.4::DOUBLE / (1 - 0.4::DOUBLE), 0) AS BIGINT) FROM inst WHERE label = 'ADVISE')",
    "sample_whole_groups": f"WITH {ORDERS}, g AS (SELECT sent_id FROM (SELECT sent_id, {_rank('5', 'sent_id')} AS r FROM (SELECT DISTINCT sent_id FROM inst)) WHERE r <= 300) SELECT sent_id, label, source, key FROM inst WHERE sent_id IN (SELECT sent_id FROM g)",
    "sample_groups_to_rows": f"""WITH {ORDERS}, g AS (SELECT sent_id, coalesce(sum(c) OVER (ORDER BY md5('5:' || sent_id), sent_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT sent_id, count(*) AS c FROM inst GROUP BY sent_id))
SELECT sent_id, label, source, key FROM inst WHERE sent_id IN (SELECT sent_id FROM g WHERE before < 1000)""",
    "sample_document_split": f"SELECT doc_id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.7::DOUBLE + 0.15::DOUBLE THEN 'dev' ELSE 'val' END AS split FROM (SELECT doc_id, {_SPLIT} AS u FROM documents)",
    "sample_every_nth": "SELECT p_partkey, p_name FROM (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) AS r FROM part) WHERE (r - 1) % 10 = 0 AND r <= 200",
    "composition_arms": ARMS_SQL,
    "score_per_label": f"WITH {PREDICTIONS}, {_PER.format(str(list(POSITIVE))[1:-1])} SELECT label, {_P} AS precision, {_R} AS recall, {_F1} AS f1, gold AS support FROM per",
    "score_micro": f"WITH {PREDICTIONS}, c AS (SELECT {_MICRO} FROM pred) SELECT n, {_P} AS precision, {_R} AS recall, {_F1} AS f1 FROM c",
    "score_micro_by_source": f"WITH {PREDICTIONS}, c AS (SELECT source, {_MICRO} FROM pred GROUP BY source) SELECT source, n, {_P} AS precision, {_R} AS recall, {_F1} AS f1 FROM c",
    "score_macro": f"WITH {PREDICTIONS}, {_PER.format(str(list(LABELS))[1:-1])} SELECT round(avg({_P}), 9) AS precision, round(avg({_R}), 9) AS recall, round(avg({_F1}), 9) AS f1, (SELECT round(avg(CASE WHEN label = predicted THEN 1.0::DOUBLE ELSE 0 END), 9) FROM pred) AS accuracy FROM per",
    "score_by_bucket": f"WITH {PREDICTIONS}, {_BUCKETS}, c AS (SELECT bucket, {_MICRO} FROM b GROUP BY bucket) SELECT bucket, n, gold AS support, said AS predicted, hit AS correct, {_P} AS precision, {_R} AS recall, {_F1} AS f1 FROM c",
    "score_false_positive_rates": f"WITH {PREDICTIONS}, {_BUCKETS}, c AS (SELECT bucket, {_MICRO} FROM b GROUP BY bucket) SELECT bucket, said - hit AS fp, n - gold AS negatives, CASE WHEN n > gold THEN CAST(said - hit AS DOUBLE) / (n - gold) ELSE 0 END AS fpr, CASE WHEN sum(said - hit) OVER () > 0 THEN CAST(said - hit AS DOUBLE) / sum(said - hit) OVER () ELSE 0 END AS fp_share FROM c",
    "score_pair_shares": f"WITH {PREDICTIONS}, c AS (SELECT {_BUCKET} AS bucket, count(*) AS sentences, CAST(sum(n_entities * (n_entities - 1) // 2) AS BIGINT) AS pairs FROM (SELECT DISTINCT sent_id, n_entities FROM pred) GROUP BY 1) SELECT bucket, sentences, pairs, CAST(sentences AS DOUBLE) / sum(sentences) OVER () AS sentence_share, CAST(pairs AS DOUBLE) / sum(pairs) OVER () AS pair_share FROM c",
    "score_buckets_side_by_side": f"WITH {PREDICTIONS}, {_BUCKETS}, c AS (SELECT source, bucket, {_MICRO} FROM b GROUP BY source, bucket), f AS (SELECT source, bucket, n, {_F1} AS f1 FROM c) SELECT o.bucket, o.n AS n_o, o.f1 AS f1_o, f.n AS n_f, f.f1 AS f1_f FROM f AS o JOIN f ON o.bucket = f.bucket AND o.source = 'O' AND f.source = 'F'",
    "score_class_fidelity": f"WITH {PREDICTIONS} SELECT label, count(*) AS n, avg(CASE WHEN label = predicted THEN 1.0::DOUBLE ELSE 0 END) AS fidelity, avg(CASE WHEN predicted <> 'NONE' THEN 1.0::DOUBLE ELSE 0 END) AS positive_share FROM pred GROUP BY label",
    "score_confusion_matrix": f"WITH {PREDICTIONS} SELECT label, " + ", ".join(f"count(*) FILTER (predicted = '{x}') AS \"{x}\"" for x in LABELS) + " FROM pred GROUP BY label",
    "score_calibration": f"""WITH {PREDICTIONS}, c AS (SELECT count(*) FILTER (label = 'NONE' AND predicted = 'NONE') AS tn, count(*) FILTER (label = 'NONE' AND predicted <> 'NONE') AS fp, count(*) FILTER (label <> 'NONE' AND predicted = 'NONE') AS fn, count(*) FILTER (label <> 'NONE' AND predicted <> 'NONE') AS tp FROM pred),
r AS (SELECT *, CAST(tn AS DOUBLE) / greatest(tn + fp, 1) AS none_recall, CAST(tp AS DOUBLE) / greatest(tp + fn, 1) AS pos_recall, CAST(tn + tp AS DOUBLE) / (tn + fp + fn + tp) AS accuracy FROM c),
f AS (SELECT *, (31000 - 31000 * 0.03::DOUBLE) * (1 - none_recall) AS false_flags, 31000 * 0.03::DOUBLE * pos_recall AS true_flags FROM r)
SELECT *, true_flags / greatest(false_flags + true_flags, 1) AS flag_precision FROM f""",
    "curve_arm_summary": "SELECT event_type AS arm, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, count(*) AS n FROM events GROUP BY event_type",
    "curve_two_arms": """WITH e AS (SELECT user_id % 4 * 100 + 100 AS n_sentences, CASE WHEN event_id % 2 = 0 THEN 'human' ELSE 'mixed' END AS arm, value FROM events), s AS (SELECT n_sentences, arm, avg(value) AS m, stddev_samp(value) AS sd FROM e GROUP BY 1, 2)
SELECT a.n_sentences, round(a.m, 6) AS mean_base, round(b.m, 6) AS mean_other, round(b.m - a.m, 6) AS delta, round(sqrt(a.sd * a.sd + b.sd * b.sd), 6) AS pooled_sd FROM s AS a JOIN s AS b ON a.n_sentences = b.n_sentences AND a.arm = 'human' AND b.arm = 'mixed'""",
}
