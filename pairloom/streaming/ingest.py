"""Generation as ingest: an append-only log of attempts, what of it counts, what is left to do.

A call with a side effect happens at least once; the log keeps every attempt, and the
first success of an index is what counts, so running again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import RAW


#: An attempt counts as done where it has no error; an empty one is none.
DONE = "(error IS NULL OR error = '')"


def succeeded(raw: DataFrame) -> DataFrame:
    return raw.where(DONE).select("spec_index").distinct()


def todo(specs: DataFrame, raw: DataFrame) -> DataFrame:
    """Requests without a success; failed ones are tried again."""
    return specs.join(succeeded(raw), "spec_index", "left_anti")


def effective(raw: DataFrame) -> DataFrame:
    """One row an index: a success if there is one, else any error."""
    ok = F.expr(DONE)
    best = F.max_by(F.struct("spec", "sample", "error"), F.struct(ok.alias("ok"), F.coalesce("sample", "error", F.lit("")).alias("x")))
    return raw.groupBy("spec_index").agg(best.alias("r")).select("spec_index", "r.*")


def log_counts(raw: DataFrame) -> DataFrame:
    """(attempts, errors, indices, succeeded): every attempt counts as an error or not."""
    ok = F.expr(DONE)
    return raw.agg(F.count("*").alias("attempts"), F.count_if(~ok).alias("errors"), F.count_distinct("spec_index").alias("indices"), F.count_distinct(F.when(ok, F.col("spec_index"))).alias("succeeded"))


def observed(raw: DataFrame, name: str = "log") -> tuple[DataFrame, Observation]:
    """raw, and what its next run counts on the way: ``ok`` and ``err``, without a job of their own."""
    seen = Observation(name)
    return raw.observe(seen, F.count_if(F.expr(DONE)).alias("ok"), F.count_if(~F.expr(DONE)).alias("err")), seen


def called(specs: DataFrame, call: Callable[[str], str], at_once: int | None = None) -> DataFrame:
    """Raw rows of calling a function with each request's JSON; its exception is the row's error.

    ``at_once`` bounds how many calls run at a time, for a service that limits them.
    """

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = []
            for index, spec in zip(pdf.spec_index, pdf.spec, strict=True):
                try:
                    rows.append((index, spec, call(spec), None))
                except Exception as e:  # the row's error, whatever the callback raises
                    said = ": ".join((type(e).__name__, str(e)))
                    rows.append((index, spec, None, said))
            yield pd.DataFrame(rows, columns=["spec_index", "spec", "sample", "error"])

    specs = specs.repartition(at_once, "spec_index") if at_once else specs
    return specs.select("spec_index", "spec").mapInPandas(run, RAW)


def generate(specs: DataFrame, call: Callable[[str], str], path: str, attempts: int = 5, enough: float = 0.9, at_once: int | None = None) -> DataFrame:
    """Call for what is left to do and append, until enough requests have succeeded or attempts are used up; the log."""
    spark, total = specs.sparkSession, specs.count()
    empty = spark.createDataFrame([], RAW)
    log = lambda: spark.read.schema(RAW).json(path) if _there(spark, path) else empty
    done = succeeded(log()).count()
    for _ in range(attempts):
        if done >= enough * total:
            break
        rows, seen = observed(called(todo(specs, log()), call, at_once))
        rows.write.mode("append").json(path)
        done += seen.get["ok"]  # what was left to do had no success before
    return log()


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def stream_log(spark: SparkSession, source: str, schema, to_raw: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, files_at_once: int = 8) -> StreamingQuery:
    """Follow a folder of files into a bronze table of raw rows; all that is there is taken, then the query ends.

    A batch is written under its own number, so a batch that runs twice after a failure
    replaces itself.
    """

    def put(batch: DataFrame, number: int) -> None:
        to_raw(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(source)
    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_successes(spark: SparkSession, source: str, schema, to_raw: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """The first success of each index, exactly once across restarts: the state is the set of indices seen."""
    rows = to_raw(spark.readStream.schema(schema).parquet(source)).where(DONE)
    return rows.dropDuplicates(["spec_index"]).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
