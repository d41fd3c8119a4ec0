"""How far one dataset is from another, and how many sentences a measure needs to say so."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .measures import REGISTRY, Measure, measured
from .sampling import groups, match_positive_rate, sample_groups, stability_draws
from .scoring import minimum_n


def compare(corpus: DataFrame, synth: DataFrame, registry: list[Measure] | None = None, match_size: bool = True, seed: int = 0) -> DataFrame:
    """(measurement, tier, corpus, synth, gap, ratio): the larger side is cut to the smaller one's number of sentences; the ratio to 0 is NaN."""
    if match_size:
        a, b = groups(corpus).count(), groups(synth).count()
        corpus, synth = (sample_groups(corpus, b, seed), synth) if a > b else (corpus, sample_groups(synth, a, seed))
    both = corpus.withColumn("side", F.lit("corpus")).unionByName(synth.withColumn("side", F.lit("synth")))
    m = measured(both, ["side"], registry)
    wide = m.groupBy("measurement", "tier").agg(F.max(F.when(F.col("side") == "corpus", F.col("value"))).alias("corpus"), F.max(F.when(F.col("side") == "synth", F.col("value"))).alias("synth"))
    return wide.withColumn("gap", F.col("synth") - F.col("corpus")).withColumn("ratio", F.when(F.col("corpus") != 0, F.col("synth") / F.col("corpus")).otherwise(F.lit(float("nan"))))


def stability(inst: DataFrame, sizes: list[int], draws: int = 10, seed: int = 0, registry: list[Measure] | None = None) -> DataFrame:
    """(measurement, tier, n_sentences, median, sd, bias, full) over draws of n sentences, all in one plan; without unlabelled measures unless they are asked for."""
    registry = [m for m in REGISTRY if m.tier != "unlabelled"] if registry is None else registry
    drawn = measured(stability_draws(inst, sizes, draws, seed), ["budget", "draw"], registry)
    full = measured(inst.withColumn("__all", F.lit(1)), ["__all"], registry).select("measurement", F.col("value").alias("full"))
    s = drawn.groupBy("measurement", "tier", F.col("budget").alias("n_sentences")).agg(F.median("value").alias("median"), F.stddev_samp("value").alias("sd"))
    return s.join(full, "measurement").withColumn("bias", F.col("median") - F.col("full"))


def minimum_sizes(corpus: DataFrame, synth: DataFrame, sizes: list[int], draws: int = 10, seed: int = 0, registry: list[Measure] | None = None) -> DataFrame:
    """The least number of sentences that shows each measure's gap, and that estimates it."""
    registry = [m for m in REGISTRY if m.tier != "unlabelled"] if registry is None else registry
    effects = compare(corpus, synth, registry, seed=seed).select("measurement", "corpus", F.col("gap").alias("effect"))
    return minimum_n(stability(corpus, sizes, draws, seed, registry), effects)


def mixing_curve(human: DataFrame, synth: DataFrame, budgets: list[int | None], seeds: Callable[[int | None], list[int]], score: Callable[[DataFrame], float], key: tuple[str, ...], ratio: float | None = None) -> list[dict]:
    """One row a budget, arm and seed: human sentences alone, and with synthetic ones whose positive rate is matched.

    ``score`` trains and scores whatever model is asked about; with a ratio the synthetic
    side is cut to that many rows for each human one.
    """
    from .sampling import sample_to_rows

    rows = []
    for budget in budgets:
        for seed in seeds(budget):
            own = sample_groups(human, budget, seed)
            n, pos = own.agg(F.count("*"), F.avg((F.col("label") != "NONE").cast("double"))).first()
            more = synth if ratio is None else sample_to_rows(synth, int(ratio * n), seed)
            mixed = own.unionByName(match_positive_rate(more, pos or 0.0, seed, *key))
            for arm, data in (("human", own), ("mixed", mixed)):
                c, p = data.agg(F.count("*"), F.avg((F.col("label") != "NONE").cast("double"))).first()
                row = dict(seed=seed, arm=arm, f1=score(data), pos_rate=p, n_instances=c)
                rows.append(row | {"budget": "full" if budget is None else str(budget)})
    return rows
