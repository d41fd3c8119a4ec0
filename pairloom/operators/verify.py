"""Verifier batches and verdicts, and pruning by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import marked_spans, numbered, stripped
from ..functions.stats import index_quantiles
from ..functions.text import n_words
from ..schema import NONE, VERDICTS
from ..sources.store import scratch, written
from .sampling import take


def keyed(inst: DataFrame) -> DataFrame:
    """inst with spans, m1 and m2: numbers from 1 of its two spans among all different spans of its sentence.

    m1 and m2 are null where the tags don't mark exactly two spans.  Numbers depend on
    which rows of the sentence are there.
    """
    with_spans = inst.withColumn("spans", marked_spans(F.col("text")))
    each = F.array_distinct(F.flatten(F.collect_list("spans").over(Window.partitionBy("sent_id"))))
    k = with_spans.withColumn("all_spans", F.sort_array(each))
    two = F.size("spans") == 2
    at = lambda i: F.when(two, F.array_position("all_spans", F.try_element_at("spans", F.lit(i))).cast("int"))
    return k.withColumn("m1", at(1)).withColumn("m2", at(2))


def verify_batches(inst: DataFrame, max_pairs: int | None = None) -> DataFrame:
    """One row a sentence: numbered text, pairs of mention numbers, their names and labels; no row without a readable pair."""
    k = keyed(inst).withColumn("plain", stripped(F.col("text")))
    name = lambda i: F.substring("plain", F.col("spans")[i]["begin"] + 1, F.col("spans")[i]["end"] - F.col("spans")[i]["begin"])
    ok = k.where("m1 > 0 AND m2 > 0").withColumn("p", F.struct("pair_no", F.array("m1", "m2").alias("pair"), F.array(name(0), name(1)).alias("name"), F.col("label").alias("gold")))
    b = ok.groupBy("sent_id").agg(F.array_sort(F.collect_list("p")).alias("p"), F.min("plain").alias("plain"), F.first("all_spans").alias("s"))
    if max_pairs is not None:
        b = b.where(F.size("p") <= max_pairs)
    field = lambda n: F.transform("p", lambda x: x[n]).alias(n)
    return b.select("sent_id", numbered(F.col("plain"), F.col("s")).alias("text"), field("pair").alias("pairs"), field("name").alias("names"), field("gold").alias("gold"), F.size("s").alias("n_mentions"))


def rendered(batches: DataFrame) -> DataFrame:
    """(sent_id, prompt): the text and a numbered line for each pair."""
    line = lambda p, i: F.format_string("  %d. mention %d (%s)  and  mention %d (%s)", i, p["pairs"][0], p["names"][0], p["pairs"][1], p["names"][1])
    lines = F.transform(F.arrays_zip("pairs", "names"), line)
    return batches.select("sent_id", F.array_join(F.concat(F.array(F.col("text"), F.lit(""), F.lit("pairs:")), lines), "\n").alias("prompt"))


def verdict_rows(raw: DataFrame, batches: DataFrame) -> DataFrame:
    """One row a pair of the batches that came back whole.

    raw has sent_id, sample (JSON of verdicts) and error.  A batch counts as whole when it
    names as many different pair numbers as it has pairs; a pair not named is not flagged.
    """
    good = raw.where("(error IS NULL OR error = '') AND sample IS NOT NULL").select("sent_id", F.from_json("sample", VERDICTS)["verdicts"].alias("v"))
    got = good.select("sent_id", F.array_distinct(F.transform("v", lambda x: x["pair"])).alias("numbers"), "v")
    j = batches.join(got, "sent_id").where(F.size("numbers") == F.size("pairs"))
    each = j.select("sent_id", "text", "n_mentions", "v", F.posexplode(F.arrays_zip("pairs", "names", "gold")).alias("i", "p"))
    last = F.try_element_at(F.filter("v", lambda x: x["pair"] == F.col("i")), F.lit(-1))["annotated"]
    return each.select("sent_id", "text", F.col("p.pairs")[0].alias("m1"), F.col("p.pairs")[1].alias("m2"), F.col("p.names")[0].alias("e1"), F.col("p.names")[1].alias("e2"), "n_mentions", F.col("p.gold").alias("gold"), (F.col("p.gold") != NONE).alias("gold_pos"), F.coalesce(last, F.lit(False)).alias("flagged"))


def same_name(e1, e2):
    """Whether two mentions say the same name, but for case and final s."""
    base = lambda e: F.regexp_replace(F.lower(e), "s+$", "")
    return base(e1) == base(e2)


def aligned(inst: DataFrame, verdicts: DataFrame) -> DataFrame:
    """inst with judged and flagged; verdicts of one pair that repeat count by their last (``no``) if there is such a column."""
    return with_verdicts(keyed(inst), verdicts).select(*inst.columns, "judged", "flagged")


def with_verdicts(keyed: DataFrame, verdicts: DataFrame) -> DataFrame:
    """aligned for rows that have m1 and m2 already, with all their columns."""
    last = F.max_by("flagged", "no") if "no" in verdicts.columns else F.max("flagged")
    v = verdicts.groupBy("sent_id", "m1", "m2").agg(last.alias("__v"))
    j = keyed.join(v, ["sent_id", "m1", "m2"], "left")
    return j.select(*(j[c] for c in keyed.columns), F.col("__v").isNotNull().alias("judged"), (F.coalesce("__v", F.lit(False)) & (F.col("label") == NONE)).alias("flagged"))


def flag_summary(marked: DataFrame) -> DataFrame:
    none = F.count_if(F.col("judged") & (F.col("label") == NONE))
    return marked.agg(F.count("*").alias("n"), F.count_if("judged").alias("judged"), F.count_if(~F.col("judged")).alias("unjudged"), F.count_if("flagged").alias("flagged"), (F.count_if("flagged") / F.greatest(none, F.lit(1))).alias("flag_rate"))


def pruning_arms(marked: DataFrame, seed: int, *key: str, fraction: float = 1.0) -> DataFrame:
    """Rows by arm: judged, judged-pruned (without flagged), judged-randprune (without as many negatives by chance).

    With a fraction only that share of the flagged, in hash order, is dropped.  The judged
    rows are written to the shared folder once; every arm reads them from there.
    """
    judged = written(marked.where("judged"), scratch(marked.sparkSession))
    flagged = judged.where("flagged")
    n = int(flagged.count() * fraction)
    if fraction >= 1:
        dropped = flagged
    else:
        dropped = take(flagged, n, seed, *key)
    at_random = take(judged.where(F.col("label") == NONE), n, seed, *key)
    arm = lambda rows, name: rows.withColumn("arm", F.lit(name))
    without = lambda gone: judged.join(gone.select(*key), list(key), "left_anti")
    return arm(judged, "judged").unionByName(arm(without(dropped), "judged-pruned")).unionByName(arm(without(at_random), "judged-randprune"))


def siblings(marked: DataFrame, order: str = "pair_no") -> DataFrame:
    """(sent_id, no, label, flagged, flagged_no): each flagged row with every judged row of its sentence, itself too."""
    j = marked.where("judged")
    own = j.where("flagged").select("sent_id", F.col(order).alias("flagged_no"))
    return own.join(j.select("sent_id", F.col(order).alias("no"), "label", "flagged"), "sent_id")


def text_length(text: Column) -> Column:
    """Words of a marked text."""
    return n_words(stripped(text))


def described(inst: DataFrame) -> DataFrame:
    """(n, sentences, median_length, per_sentence) of a set of marked rows; the median is the word count in the middle of the sorted ones.

    Rows that come with ``words``, the ``text_length`` of their text, need no text.
    """
    w = inst.select("sent_id", "words" if "words" in inst.columns else text_length(F.col("text")).alias("words"))
    mid = index_quantiles(w, "words", {"median_length": 0.5})
    n = w.agg(F.count("*").alias("n"), (F.count_distinct("sent_id") + F.max(F.col("sent_id").isNull().cast("int"))).alias("sentences"))
    return n.crossJoin(mid).select("n", "sentences", "median_length", (F.col("n") / F.greatest("sentences", F.lit(1))).alias("per_sentence"))


def flag_concentration(marked: DataFrame) -> DataFrame:
    """Among sentences with a flagged row: their number, the median share of their negatives that is flagged, and how many are flagged whole."""
    s = marked.where("judged").groupBy("sent_id").agg(F.count_if("flagged").alias("f"), F.count_if(F.col("label") == NONE).alias("none")).where("f > 0")
    return s.agg(F.count("*").alias("sentences"), F.median(F.col("f") / F.col("none")).alias("median_share"), F.count_if(F.col("f") == F.col("none")).alias("all_flagged"))
