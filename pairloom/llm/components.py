"""Connected components of an edge table.

Up to ``TOGETHER`` edges between integers are labelled in one task.  More, or those between
other kinds of nodes, go through alternating large-star and small-star steps: each is two
shuffles of narrow rows; its result is written to the shared folder, so lineage stays short and
a lost executor costs one step at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, shared_dir, written

#: Edges that one task labels: 16 MB of numbers.
TOGETHER = 1 << 20


def labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Of the nodes 0 to n - 1 the least that edges (u, v) connect each to."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))  # roots go under lesser ones
        while ((up := label[label]) != label).any():
            label = up


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of edges (u, v) between integers, which all lie in these batches."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        of = nodes[labels(at[: len(u)], at[len(u) :], len(nodes))]
        for k in range(0, len(nodes), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + 10_000]), pa.array(of[k : k + 10_000])], names=["node", "component"])


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v.  Large: a node's larger neighbours go to its least one; small: its lesser neighbours and itself do."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", together: int = TOGETHER) -> DataFrame:
    """(node, component): every node of an edge, with the least node that edges connect it to.

    Edges that repeat, run both ways or lead from a node to itself are the same as one;
    edges with a null end are left out.  No edges give no rows.  Edges are read twice, at
    last by the result where one task labels them.
    """
    spark = edges.sparkSession
    at = shared_dir(spark)
    clean = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna()
    kinds = {clean.schema["x"].dataType, clean.schema["y"].dataType}
    if len(kinds) == 1 and isinstance(kind := kinds.pop(), T.IntegralType):
        if clean.count() <= together:
            return clean.repartition(1).mapInArrow(_labelled, T.StructType([T.StructField("node", kind), T.StructField("component", kind)]))
    loops = written(clean.where("x = y").select("x").distinct(), f"{at}/loops")
    now = written(clean.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), f"{at}/0")
    step, before = 0, None
    while before != (before := _sum(now)):
        after = written(_stars(_stars(now, True), False), f"{at}/{step + 1}")
        dropped(spark, f"{at}/{step}")
        now, step = after, step + 1
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = loops.select(F.col("x").alias("node"), F.col("x").alias("component"))
    return stars.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))
