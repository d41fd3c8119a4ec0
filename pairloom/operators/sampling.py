"""Seeded draws: every random order is the order of md5(seed:key).

A draw is the same wherever and however often it runs.  Taking the first k of a table in
that order needs no sort of the table: rows are counted by the hash's first digits, whole
buckets before the k-th row are taken, and only the bucket that holds it is ranked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import NONE


def hashed(seed: int | str, *key: Column | str) -> Column:
    cols = [F.col(k) if isinstance(k, str) else k for k in key]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in cols)))


def uniform(h: Column) -> Column:
    """A number from 0 below 1 out of a hash's first eight digits."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def take(rows: DataFrame, k: Column | int | float, seed: int | str, *key: str, weight: str | None = None, digits: int = 4) -> DataFrame:
    """The first rows in hash order of the key until their weights (1 each) reach k.

    The row that reaches it is taken too, so weighted draws can go beyond k by one row.
    Equal keys go by the key itself, then by chance.
    """
    k = k if isinstance(k, Column) else F.lit(k)
    w = F.col(weight) if weight else F.lit(1)
    h = rows.withColumn("__h", hashed(seed, *key)).withColumn("__b", F.substring("__h", 1, digits)).withColumn("__w", w)
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = h.groupBy("__b").agg(F.sum("__w").alias("__n")).withColumn("__before", before).where(F.col("__before") < k)
    near = h.join(F.broadcast(buckets), "__b")
    whole = near.where(F.col("__before") + F.col("__n") <= k)
    run = F.coalesce(F.sum("__w").over(Window.partitionBy("__b").orderBy("__h", *key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = near.where(F.col("__before") + F.col("__n") > k).withColumn("__run", run).where(F.col("__before") + F.col("__run") < k).drop("__run")
    return whole.unionByName(cut).drop("__h", "__b", "__w", "__n", "__before")


def shuffled(rows: DataFrame, seed: int | str, *key: str) -> DataFrame:
    return rows.orderBy(hashed(seed, *key), *key)


def split_by_hash(rows: DataFrame, seed: int | str, *key: str, parts: dict[str, float]) -> DataFrame:
    """rows with ``split``: each key's share of the unit interval decides, so a key is always whole and needs no other row."""
    u = uniform(hashed(seed, *key))
    name = F.lit(list(parts)[-1])
    edge = 0.0
    for p, size in parts.items():
        edge += size
        name = F.when((u < edge) & (u >= edge - size), p).otherwise(name)
    return rows.withColumn("split", name)


def counts(inst: DataFrame) -> tuple[int, int]:
    """(positives, negatives)."""
    r = inst.agg(F.count_if(F.col("label") != NONE), F.count_if(F.col("label") == NONE)).first()
    return r[0], r[1]


def negatives_to(inst: DataFrame, n: int | None, seed: int, *key: str) -> DataFrame:
    """All positives and n negatives in hash order; all negatives for None or where there are no more."""
    pos, neg = inst.where(F.col("label") != NONE), inst.where(F.col("label") == NONE)
    return inst if n is None else pos.unionByName(take(neg, n, seed, *key))


def downsample_negatives(inst: DataFrame, ratio: float | None, seed: int, *key: str) -> DataFrame:
    """At most int(ratio * positives) negatives."""
    return inst if ratio is None else negatives_to(inst, int(ratio * counts(inst)[0]), seed, *key)


def match_positive_rate(inst: DataFrame, target: float, seed: int, *key: str) -> DataFrame:
    """Negatives dropped until positives are the target share: int(pos * (1 - t) / t) stay."""
    pos, neg = counts(inst)
    n = int(pos * (1 - target) / max(target, 1e-9))
    return inst if n >= neg else negatives_to(inst, n, seed, *key)


def none_needed(n_pos: int, target: float) -> int:
    """Negatives beside n_pos positives for a share of negatives of target, rounded half to even."""
    return round(n_pos * target / (1 - target))


def mix_to_none_share(pos: DataFrame, pool: DataFrame, target: float, seed: int, *key: str) -> DataFrame:
    return pos.unionByName(take(pool, none_needed(pos.count(), target), seed, *key))


def groups(inst: DataFrame) -> DataFrame:
    return inst.groupBy("sent_id").agg(F.count("*").alias("size"))


def keep_groups(inst: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of whole groups; a null group can't be kept."""
    return inst.join(kept.select("sent_id"), "sent_id", "left_semi")


def sample_groups(inst: DataFrame, n: int | None, seed: int) -> DataFrame:
    """All rows of n sentences; all rows for None or if there are no more."""
    return inst if n is None else keep_groups(inst, take(groups(inst).where("sent_id IS NOT NULL"), n, seed, "sent_id"))


def sample_to_rows(inst: DataFrame, n_rows: int, seed: int) -> DataFrame:
    """Whole sentences in hash order until they have n_rows rows, the last one whole."""
    return keep_groups(inst, take(groups(inst), n_rows, seed, "sent_id", weight="size"))


def match_composition(inst: DataFrame, target: float, n_rows: int, seed: int, free: int = 50) -> DataFrame:
    """Whole sentences, small ones first by chance, accepted while rows per sentence move towards the target.

    The order is a weighted draw without replacement: -ln(u) * size, ascending.  Accepting
    depends on all sentences before, so the sizes, one narrow row a sentence, go through
    one worker; texts don't.
    """
    order = (-F.log(F.greatest(uniform(hashed(seed, "sent_id")), F.lit(1e-12))) * F.col("size")).alias("at")

    def accept(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = n = 0
        for pdf in pdfs:
            out = []
            for sid, size in zip(pdf.sent_id, pdf["size"], strict=True):
                if n >= n_rows:
                    break
                now = n / kept if kept else 0.0
                if kept < free or abs((n + size) / (kept + 1) - target) <= abs(now - target) + 0.5:
                    out.append(sid)
                    kept, n = kept + 1, n + size
            yield pd.DataFrame({"sent_id": pd.Series(out, dtype=object)})

    ordered = groups(inst).select("sent_id", "size", order).orderBy("at", "sent_id").coalesce(1).select("sent_id", "size")
    return keep_groups(inst, ordered.mapInPandas(accept, "sent_id string"))


def stability_draws(inst: DataFrame, sizes: list[int], draws: int, seed: int = 0) -> DataFrame:
    """inst once for every (budget, draw): so many sentences drawn by hash of (seed, budget, draw).

    Sizes beyond the number of sentences are left out.  All draws are one plan and only ids
    are multiplied: they are counted by their hash's first digits, and those in the buckets
    up to a draw's last sentence, few more than are drawn, are ranked.
    """
    spark = inst.sparkSession
    ids = groups(inst).select("sent_id")
    total = ids.count()
    table = spark.createDataFrame([(n, d) for n in sizes if n <= total for d in range(draws)], "budget int, draw int")
    h = hashed(seed, "budget", "draw", "sent_id")
    each = ids.crossJoin(F.broadcast(table)).withColumn("h", h).withColumn("b", F.substring("h", 1, 4))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("budget", "draw").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = each.groupBy("budget", "draw", "b").agg(F.count("*").alias("n")).withColumn("before", before).where("before < budget").select("budget", "draw", "b")
    rank = F.row_number().over(Window.partitionBy("budget", "draw").orderBy("h", "sent_id"))
    drawn = each.join(F.broadcast(near), ["budget", "draw", "b"]).withColumn("r", rank).where("r <= budget")
    return inst.join(drawn.select("sent_id", "budget", "draw"), "sent_id")


def pick(dist: dict[str, float], u: Column) -> Column:
    """A weighted choice by a uniform number; weights needn't sum to 1."""
    total, at, out = math.fsum(dist.values()), 0.0, F.lit(list(dist)[-1])
    edges = []
    for k, w in dist.items():
        at += w / total
        edges.append((k, at))
    for k, edge in reversed(edges):
        out = F.when(u < edge, F.lit(k)).otherwise(out)
    return out


def every(rows: DataFrame, step: int, limit: int, *order: str) -> DataFrame:
    """Every step-th row in order, from the first, up to a limit: for looking at."""
    return rows.orderBy(*order).limit(step * limit).withColumn("__r", F.row_number().over(Window.orderBy(*order))).where(F.expr(f"(__r - 1) % {step} = 0")).drop("__r")
