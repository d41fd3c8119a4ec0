"""Shortcut probe: what a bag of words alone gives away of the label, beyond guessing the larger class."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, NGram, RegexTokenizer, SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import stripped
from ..schema import NONE
from .sampling import hashed, uniform
from .scoring import macro


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """(label, weight) n / (classes * rows of the class)."""
    c = rows.groupBy(label).agg(F.count("*").alias("n"))
    t = c.agg(F.sum("n").alias("all"), F.count("*").alias("k"))
    return c.crossJoin(F.broadcast(t)).select(label, (F.col("all") / (F.col("k") * F.col("n"))).alias("weight"))


def probe(inst: DataFrame, max_features: int = 5000, test: float = 0.3, seed: int = 0, top: int = 15) -> dict:
    """lift (macro F1 less that of the majority class), f1, baseline and the top features by weight; a lift of 0 where a class or all words are missing."""
    data = inst.select("sent_id", F.lower(stripped(F.col("text"))).alias("text"), (F.col("label") != NONE).cast("double").alias("y")).withColumn("test", uniform(hashed(seed, "sent_id")) < test)
    train, held = data.where("NOT test"), data.where("test")
    if train.select("y").distinct().count() < 2 or held.isEmpty():
        return {"lift": 0.0, "f1": 0.0, "baseline": 0.0, "top": []}
    train = train.join(F.broadcast(class_weights(train, "y")), "y")
    steps = [RegexTokenizer(inputCol="text", outputCol="w", pattern=r"\w\w+", gaps=False), NGram(n=2, inputCol="w", outputCol="b"), SQLTransformer(statement="SELECT *, concat(w, b) AS grams FROM __THIS__"), CountVectorizer(inputCol="grams", outputCol="features", minDF=2, vocabSize=max_features)]
    shaped = Pipeline(stages=steps).fit(train)
    if not shaped.stages[-1].vocabulary:
        return {"lift": 0.0, "f1": 0.0, "baseline": 0.0, "top": []}
    model = LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", maxIter=50, regParam=0.01).fit(shaped.transform(train))
    pred = model.transform(shaped.transform(held)).select(F.col("y").cast("int").cast("string").alias("label"), F.col("prediction").cast("int").cast("string").alias("predicted"))
    major = train.groupBy("y").count().orderBy(F.desc("count"), "y").first()["y"]
    f1 = macro(pred, ("0", "1")).first()["f1"]
    base = macro(pred.withColumn("predicted", F.lit(str(int(major)))), ("0", "1")).first()["f1"]
    ranked = sorted(zip(shaped.stages[-1].vocabulary, model.coefficients.toArray().tolist(), strict=True), key=lambda x: (-abs(x[1]), x[0]))
    return {"lift": f1 - base, "f1": f1, "baseline": base, "top": ranked[:top]}


def probe_repeated(inst: DataFrame, seeds: range = range(10), max_features: int = 5000) -> dict[str, float]:
    """Median, standard deviation, least and largest lift over several splits."""
    import statistics

    lifts = [probe(inst, max_features, seed=s)["lift"] for s in seeds]
    return {"median": statistics.median(lifts), "sd": statistics.stdev(lifts) if len(lifts) > 1 else 0.0, "min": min(lifts), "max": max(lifts)}
