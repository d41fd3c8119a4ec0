"""Shared pieces: the cluster's shared folder, written tables, tokenizers, word splitting."""

from __future__ import annotations

import base64
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Where the public vocabularies lie; every operator takes another path as a parameter.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-token pattern of the byte-level vocabularies.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_WORD = re.compile(r"\w+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, made known to the context.

    Where the setting is absent a temporary folder serves, but only for a local master:
    on a cluster executors could not see it, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "pairloom-shared")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """The same rows, read again from a table written at path: lineage ends there."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a written table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Rows whose Python values a worker holds at a time; Arrow batches come larger.
ROWS = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in short pieces, so that a worker's memory doesn't follow the batch size; unused memory goes back at the end."""
    try:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield b.slice(at, rows)
            del b
            pa.default_memory_pool().release_unused()
    finally:
        pa.default_memory_pool().release_unused()


def lowered(text: str) -> str:
    """Lower case of the same length, so that offsets in it are offsets in the text."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    return low


def words(text: str) -> list[str]:
    return _WORD.findall(lowered(text))


def word_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(lowered(text))]


def encoding(path: str = TOKENIZER):
    """The byte-level tokenizer in a file of base64 tokens and ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of whole texts; one for each Python worker."""

    def __init__(self, path: str = TOKENIZER):
        self.enc = encoding(path)

    def ids(self, text: str) -> list[int]:
        return self.enc.encode_ordinary(text)

    def length(self, text: str) -> int:
        return len(self.enc.encode_ordinary(text))


def token_lengths(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, out: str = "n_tokens") -> DataFrame:
    """(id, tokens of the whole text); null texts have null tokens."""
    from pyspark.sql import types as T

    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(tokenizer)
        for b in slices(batches):
            lens = [None if t is None else enc.length(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lens, pa.int64())], names=["id", out])

    schema = T.StructType([T.StructField("id", kind), T.StructField(out, T.LongType())])
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string")).mapInArrow(run, schema)
