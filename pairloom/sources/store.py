"""Datasets with manifests, run records, raw logs, curves: reading and writing."""

from __future__ import annotations

import datetime as dt
import json
import re
import subprocess
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import INSTANCE, MANIFEST, RAW


def new_id() -> str:
    return "-".join((format(dt.datetime.now(dt.UTC), "%Y%m%d-%H%M%S"), str(uuid.uuid4())[:6]))


def _git() -> tuple[str, bool]:
    def say(*args: str) -> str:
        try:
            return subprocess.run(["git", *args], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return ""

    return say("rev-parse", "HEAD"), bool(say("status", "--porcelain"))


def digest(rows: DataFrame) -> DataFrame:
    """One row: sha256 over the sorted digests of all rows, whatever files they lie in.

    Rows are hashed where they are; only sums of their digests' parts meet, so the order
    of rows doesn't matter and nothing is gathered.
    """
    h = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    part = lambda k: F.sum(F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("decimal(38,0)"))
    sums = rows.select(h.alias("h")).agg(F.count("*").alias("n"), *(part(k).alias(f"p{k}") for k in range(8)))
    return sums.select(F.sha2(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in sums.columns)), 256).alias("sha256"))


def manifest_row(inst: DataFrame, dataset_id: str, provenance: str, data_root: str, **more) -> DataFrame:
    """The one-row manifest of a dataset: counts, label histogram, checksum, git state."""
    spark = inst.sparkSession
    labels = inst.groupBy("label").agg(F.count("*").alias("n"))
    dist = labels.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("label_distribution"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    sents = inst.agg(F.count_distinct(F.coalesce("sent_id", F.lit(""))).alias("sents"))
    sha, dirty = _git()
    known = {"dataset_id": dataset_id, "created_at": f"{dt.datetime.now(dt.UTC):%Y-%m-%dT%H:%M:%SZ}", "provenance": provenance, "data_root": data_root, "git_sha": sha, "git_dirty": dirty} | more
    j = dist.crossJoin(sents).crossJoin(digest(inst))
    made = {"size": F.struct(F.col("rows").alias("n_instances"), F.col("sents").alias("n_sentences")), "label_distribution": F.col("label_distribution"), "sha256": F.col("sha256")}
    cols = [(made[f.name] if f.name in made else F.lit(known.get(f.name))).cast(f.dataType).alias(f.name) for f in MANIFEST.fields]
    return spark.createDataFrame(j.select(*cols).collect(), MANIFEST)


def write_dataset(inst: DataFrame, root: str, provenance: str, **more) -> str:
    """Write rows and, when they are complete, their manifest; the new id."""
    dataset_id = new_id()
    at = f"{root}/instances/{dataset_id}"
    inst.write.parquet(at)
    back = inst.sparkSession.read.parquet(at)
    manifest_row(back, dataset_id, provenance, root, **more).write.mode("append").json(f"{root}/manifests")
    return dataset_id


def manifests(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{root}/manifests")


def load_dataset(spark: SparkSession, root: str, dataset_id: str, verify: bool = True) -> DataFrame:
    """The rows of a dataset; with verify their digest has to be the manifest's."""
    m = manifests(spark, root).where(F.col("dataset_id") == dataset_id).first()
    if m is None:
        raise ValueError(f"no manifest of {dataset_id}")
    rows = spark.read.parquet(f"{root}/instances/{dataset_id}")
    if verify and (found := digest(rows).first()[0]) != m.sha256:
        raise ValueError(f"{dataset_id}: the rows' digest {found} is not the manifest's {m.sha256}")
    return rows


def lineage(manifest: DataFrame) -> DataFrame:
    """(dataset_id, ancestor, depth) along parent_id to the end; an ancestor that comes round again ends it."""
    m = manifest.select("dataset_id", "parent_id")
    step = m.where("parent_id IS NOT NULL").select("dataset_id", F.col("parent_id").alias("ancestor"), F.lit(1).alias("depth"))
    out, now = step, step
    up = m.select(F.col("dataset_id").alias("ancestor"), "parent_id")
    at, depth = scratch(manifest.sparkSession), 2
    out = now = written(now, f"{at}/1")
    while not now.isEmpty():
        now = now.join(up, "ancestor").where("parent_id IS NOT NULL").select("dataset_id", F.col("parent_id").alias("ancestor"), F.lit(depth).alias("depth"))
        now = now.join(out.select("dataset_id", "ancestor"), ["dataset_id", "ancestor"], "left_anti")
        now = written(now.select("dataset_id", "ancestor", "depth"), f"{at}/{depth}")
        out, depth = out.unionByName(now), depth + 1
    return out


def write_masked_twins(inst: DataFrame, root: str, parent_id: str) -> tuple[str, str, DataFrame]:
    """Two datasets with the same rows, one masked, and the label histogram of what can't be masked."""
    from ..operators.pairs import masked_twins

    kept, masked, dropped = masked_twins(inst)
    a = write_dataset(kept, root, "derived", parent_id=parent_id, render_mode="markers")
    b = write_dataset(masked, root, "derived", parent_id=parent_id, render_mode="mask_targets")
    return a, b, dropped.groupBy("label").agg(F.count("*").alias("n"))


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of instances; blank lines are none."""
    return spark.read.schema(INSTANCE).json(path)


def log_run(spark: SparkSession, root: str, config: dict, metrics: dict[str, float], notes: str = "", train_id: str | None = None, eval_id: str | None = None) -> str:
    sha, dirty = _git()
    run_id = new_id()
    row = dict(run_id=run_id, train_id=train_id, eval_id=eval_id, metrics=metrics, config=config, git_dirty=dirty, git_sha=sha, notes=notes)
    row["timestamp"] = f"{dt.datetime.now(dt.UTC):%Y-%m-%dT%H:%M:%SZ}"
    spark.createDataFrame([(json.dumps(row),)], "value string").coalesce(1).write.mode("append").text(f"{root}/runs")
    return run_id


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run records, one a file or line, with config as cfg.* and metrics as m.*; list-shaped files are none."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\n(?=\{)")).alias("value")).where(F.trim("value").startswith("{"))
    kind = "struct<run_id:string,timestamp:string,train_id:string,eval_id:string,config:map<string,string>,metrics:map<string,double>,notes:string,git_sha:string,git_dirty:boolean>"
    r = raw.select(F.from_json("value", kind).alias("r")).select("r.*").where("run_id IS NOT NULL")
    r = r.withColumn("train_id", F.coalesce("train_id", F.try_element_at("config", F.lit("train_id")))).withColumn("eval_id", F.coalesce("eval_id", F.try_element_at("config", F.lit("eval_id"))))
    keys = lambda c: sorted(x[0] for x in r.select(F.explode(F.map_keys(c))).distinct().collect())
    cfg, met = keys("config"), keys("metrics")
    return r.select("run_id", "timestamp", "train_id", "eval_id", "notes", "git_sha", "git_dirty", *(F.try_element_at("config", F.lit(k)).alias(f"cfg.{k}") for k in cfg), *(F.try_element_at("metrics", F.lit(k)).alias(f"m.{k}") for k in met))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw log of generated samples: spec and sample as JSON text."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    get = lambda k: F.get_json_object("value", f"$.{k}")
    return lines.select(get("spec_index").cast("long").alias("spec_index"), get("spec").alias("spec"), get("sample").alias("sample"), get("error").alias("error"))


def write_raw(rows: DataFrame, path: str) -> None:
    rows.select(*(F.col(f.name).cast(f.dataType) for f in RAW.fields)).write.mode("append").json(path)


def read_curve(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Rows of an aggregate file: a JSON list (multiline) or JSON lines."""
    return spark.read.option("multiLine", multiline).json(path)


def read_drug_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, encoding="utf-8", multiLine=True, escape='"')


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """(kind, name) of a JSON object whose values are lists of names or objects keyed by name."""
    kind = T.MapType(T.StringType(), T.StringType())
    m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("kind", "v"))
    listed, keyed = F.from_json("v", "array<string>"), F.map_keys(F.from_json("v", kind))
    return m.select("kind", F.explode(F.when(F.trim("v").startswith("["), listed).otherwise(keyed)).alias("name")).where("name <> ''")


def write_rejects(rejects: DataFrame, path: str) -> bool:
    """Write rejects if there are any."""
    if rejects.isEmpty():
        return False
    rejects.write.mode("overwrite").json(path)
    return True


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(spec_index, sent_id, reason) of rejects as ``write_rejects`` leaves them; no file, no rejects."""
    kind = "spec_index long, sent_id string, reason string"
    try:
        return spark.read.schema(kind).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kind)


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one only for a local master without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{tempfile.gettempdir()}/pairloom-scratch"
    return f"{root.rstrip('/')}/{new_id()}"


def written(rows: DataFrame, path: str) -> DataFrame:
    """The same rows, read from a table written at path."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def guard_evaluation(train: DataFrame, evaluation: DataFrame) -> None:
    """Refuse to score on generated data, or across render modes; both are manifest rows."""
    t, e = train.first(), evaluation.first()
    if e.provenance != "human":
        raise ValueError("the evaluation set has to be annotated by people")
    if (t.render_mode or "markers") != (e.render_mode or "markers"):
        raise ValueError(f"render modes differ: {t.render_mode} and {e.render_mode}")


def write_table(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)


def report_text(title: str, tables: dict[str, DataFrame], limit: int | None = None) -> str:
    """A Markdown report of small tables; a limit is named where it leaves rows out."""
    out = [f"# {title}"]
    for name, df in tables.items():
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        rows = df.collect() if limit is None else df.limit(limit + 1).collect()
        out += ["| " + " | ".join(str(v) for v in r) + " |" for r in rows[:limit]]
        if limit is not None and len(rows) > limit:
            out += ["", f"The first {limit} rows; there are more."]
    return "\n".join(out) + "\n"
