"""Benchmark decontamination: test n-grams are looked up in every window of training tokens.

Tokens are runs of word characters in lower case.  The n-grams of all test items, and
the whole of items shorter than n, form a hash set that every worker holds, bounded in
bytes; windows of
a document are hashed alike, hits are verified token by token, and what verified windows
cover is cut out of the text.  Where they cover a large part, the document goes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, lowered, shared_dir, slices, table, word_spans, written

N = 8
#: Share of a document's tokens in test passages from which the whole document goes.
SHARE = 0.5
#: Bytes of test text held at once; more are looked up in as many passes as they need.  A
#: worker holds about 20 bytes for each token of it and the different words: 150 MB or so.
HELD = 32 << 20
#: Tokens of the pieces that test items are cut into, which overlap by n - 1.
PIECE = 4096
_WORD = re.compile(r"\w+")
_TAIL = re.compile(r"[^\w\s]*\s*")
_P = np.uint64(0x100000001B3)
_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


class Grams:
    """Windows of test items, found in lists of tokens.

    The items' tokens lie in one array of numbers; a window is its hash, in a sorted
    array, and where it begins.  Workers get these arrays and the words, and number the
    words once.
    """

    def __init__(self, items: list[list[str]], n: int):
        names: dict[str, int] = {}
        self.ids = np.array([names.setdefault(w, len(names)) for item in items for w in item], dtype=np.int32)
        starts: dict[int, list[np.ndarray]] = {}
        at = 0
        for item in items:
            size = min(n, len(item))
            starts.setdefault(size, []).append(np.arange(at, at + len(item) - size + 1, dtype=np.int64))
            at += len(item)
        self.by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, some in starts.items():
            start = np.concatenate(some)
            key = self._hashes(self.ids, size)[start]
            words = self.ids[start[:, None] + np.arange(size)]
            order = np.lexsort((*words.T[::-1], key))
            start, key, words = start[order], key[order], words[order]
            new = np.r_[True, (key[1:] != key[:-1]) | (words[1:] != words[:-1]).any(1)]
            self.by[size] = (key[new], start[new])
        self.words = "\n".join(names)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "number"}

    @cached_property
    def number(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.words.split("\n"))}

    @staticmethod
    def _hashes(ids: np.ndarray, n: int) -> np.ndarray:
        size = len(ids) - n + 1
        h = np.zeros(size, dtype=np.uint64)
        u = ids.astype(np.uint64) + np.uint64(1)
        for k in range(n):
            h = h * _P + u[k : k + size]
        return h * np.uint64(0x9E3779B97F4A7C15)

    def spans(self, tokens: list[str]) -> list[tuple[int, int]]:
        """Stretches of tokens [from, to) that verified windows cover."""
        get = self.number.get
        ids = np.array([get(w, -1) for w in tokens], dtype=np.int32)
        out: list[tuple[int, int]] = []
        for n, (keys, starts) in self.by.items():
            if len(ids) < n:
                continue
            unknown = np.r_[0, np.cumsum(ids < 0)]
            at = np.flatnonzero(unknown[n:] == unknown[:-n])
            if not len(at):
                continue
            h = self._hashes(ids, n)[at]
            first, last = np.searchsorted(keys, h), np.searchsorted(keys, h, side="right")
            while (left := first < last).any():
                at, first, last = at[left], first[left], last[left]
                own = np.arange(n)
                same = (ids[at[:, None] + own] == self.ids[starts[first][:, None] + own]).all(1)
                out += [(k, k + n) for k in at[same].tolist()]
                first = first + 1
        return joined(out)


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def tokens(text: str) -> list[str]:
    return _WORD.findall(lowered(text))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less the tokens of the spans, and what punctuation and space follows each."""
    at, out, start = word_spans(text), [], 0
    for a, b in spans:
        out.append(text[start : at[a][0]])
        start = _TAIL.match(text, at[b - 1][1]).end()
    return "".join([*out, text[start:]]).strip()


def test_items(benchmark: DataFrame, text_col: str = "text", n: int = N, piece: int = PIECE) -> DataFrame:
    """(item: array of tokens) of all items, each once, cut into pieces that overlap by n - 1 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for t in b.column(0).to_pylist():
                w = tokens(t)
                out += [w[k : k + piece] for k in range(0, max(1, len(w) - n + 1), piece - n + 1)] if w else []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], names=["item"])

    return benchmark.select(F.col(text_col).cast("string")).dropna().mapInArrow(run, "item array<string>").distinct()


def _parts(items: DataFrame, n: int, held: int) -> Iterator[Grams]:
    """Grams of shares of the items, each about ``held`` bytes of text; the driver has one at a time."""
    size = items.agg(F.sum(F.octet_length(F.array_join("item", " ")))).first()[0] or 0
    parts = -(-size // held)
    for k in range(parts):
        got = items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == k).collect()
        if got:
            yield Grams([r[0] for r in got], n)


def _scan(sent, at: int, first: bool):
    """Adds the spans of one held set to the last column, rows by rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = sent.value
        for b in slices(batches):
            old = [()] * b.num_rows if first else b.column(b.num_columns - 1).to_pylist()
            spans = [None if t is None else joined([*((s["a"], s["b"]) for s in o), *grams.spans(tokens(t))]) for t, o in zip(b.column(at).to_pylist(), old, strict=True)]
            new = pa.array([None if s is None else [{"a": x, "b": y} for x, y in s] for s in spans], _SPANS)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], new], names=b.schema.names)

    return run


def _scanned(docs: DataFrame, benchmark: DataFrame, text_col: str, bench_col: str, n: int, held: int, out: str):
    """(docs with a column of spans, a function that still has to go over its batches or None)."""
    spark = docs.sparkSession
    at = docs.columns.index(text_col)
    now = docs.withColumn(out, F.when(F.col(text_col).isNotNull(), F.expr("cast(array() as array<struct<a:int,b:int>>)")))
    folder = shared_dir(spark)
    last = None
    for k, part in enumerate(_parts(written(test_items(benchmark, bench_col, n), f"{folder}/items"), n, held)):
        if last is not None:
            now = written(now.mapInArrow(last, now.schema), f"{folder}/{k}")
        last = _scan(spark.sparkContext.broadcast(part), at, k == 0)
    return now, last


def scanned(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", bench_col: str = "text", n: int = N, held: int = HELD, out: str = "__spans") -> DataFrame:
    """All rows and columns of docs with the token stretches that test passages cover.

    Null texts have null stretches; texts without tokens, and any text where there is no
    test item, have none.  Test items that are null or without tokens, and repeated ones,
    add nothing.  A column of docs named like the new one is replaced.
    """
    now, rest = _scanned(docs.drop(out), benchmark, text_col, bench_col, n, held, out)
    return now if rest is None else now.mapInArrow(rest, now.schema)


def _then(first, second):
    """One pass of a worker over two functions of batches."""
    return second if first is None else lambda batches: second(first(batches))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", bench_col: str = "text", n: int = N, share: float = SHARE, length_col: str | None = "n_chars", held: int = HELD) -> DataFrame:
    """docs without test passages: spans are cut out, and documents mostly made of them go.

    Columns stay as they are, but for the text and, if there is one, the column of its
    length.  Rows with a null text and rows without a hit are left as they are.  A document
    goes where verified windows cover at least ``share`` of its tokens, or nothing of the
    text remains.
    """
    marked, rest = _scanned(docs, benchmark, text_col, bench_col, n, held, fresh(docs, "__spans"))
    at = docs.columns.index(text_col)
    name = fresh(docs, "__cut")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.IntegerType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            spans = [[(x["a"], x["b"]) for x in s or ()] for s in b.column(b.num_columns - 1).to_pylist()]
            columns, done = [*b.columns[:-1]], [0] * b.num_rows
            if any(spans):
                texts = b.column(at).to_pylist()
                for i, own in enumerate(spans):
                    if own:
                        total, left = len(word_spans(texts[i])), without(texts[i], own)
                        done[i] = 2 if sum(y - x for x, y in own) >= share * total or not left else 1
                        texts[i] = left
                columns[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(done, pa.int32())], names=[*b.schema.names[:-1], name])

    out = marked.mapInArrow(_then(rest, cut), schema).where(f"{name} < 2")
    if length_col and length_col in docs.columns and length_col != text_col:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.col(name) == 1, F.length(text_col).cast(kind)).otherwise(F.col(length_col)))
    return out.drop(name)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", bench_col: str = "text", n: int = N, share: float = SHARE, held: int = HELD) -> DataFrame:
    """(doc_id, spans, n_hit, n_tokens, drop_document) of the documents with a verified hit.

    Spans are stretches of tokens from ``a`` up to ``b``.  Null texts, texts without tokens
    and tables without test items have no hit; rows that repeat an id are scanned each.
    """
    marked, rest = _scanned(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), benchmark, "text", bench_col, n, held, "spans")

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = pc.fill_null(pc.greater(pc.list_value_length(b.column(2)), 0), False)
            b = b.filter(found)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(word_spans(t)) for t in b.column(1).to_pylist()], pa.int32())], names=["doc_id", "spans", "n_tokens"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("spans", marked.schema["spans"].dataType), T.StructField("n_tokens", T.IntegerType())])
    hit = F.aggregate("spans", F.lit(0), lambda acc, s: acc + s["b"] - s["a"])
    return marked.mapInArrow(_then(rest, hits), schema).withColumn("n_hit", hit).withColumn("drop_document", F.col("n_hit") >= share * F.col("n_tokens"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in which passages of the benchmark are found, with their spans.

    Nulls, empty and long texts, repeated rows, empty tables and further columns are as
    in ``contaminated``; there are no ties.
    """
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
