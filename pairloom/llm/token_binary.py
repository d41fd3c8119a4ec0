"""Token ids as directly addressable codes.

An id is split into chunks of ``CHUNK`` bits, lowest first.  Level k holds the k-th chunk
of every id that has one, in order; a bitmap says which of them go on in the next level,
and a rank directory counts its set bits before every ``BLOCK`` bits.  Token i is read
from position i of level 0, then at each level from the rank of its position: no other
token is decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TOKENIZER, Encoder, slices, table

CHUNK, BLOCK = 8, 512
_LEVELS = T.ArrayType(T.StructType([T.StructField(n, T.BinaryType()) for n in ("chunks", "more", "ranks")]))
_ARROW = pa.list_(pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())]))


def encoded(ids: np.ndarray) -> list[dict[str, bytes]]:
    """Levels of a list of ids from 0 to 2**32 - 1; no ids give no level."""
    left, out = np.asarray(ids, dtype=np.uint32), []
    while len(left):
        more = left > 0xFF
        bits = np.packbits(more, bitorder="little")
        ones = np.r_[0, np.cumsum(np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64))[:-1]]
        out.append({"chunks": (left & 0xFF).astype(np.uint8).tobytes(), "more": bits.tobytes(), "ranks": ones.astype("<u4").tobytes()})
        left = left[more] >> np.uint32(CHUNK)
    return out


def token_at(levels: list, i: int) -> int:
    """Token i, read from one position of each level it reaches; IndexError beyond the ends."""
    if not levels or not 0 <= i < len(levels[0]["chunks"]):
        raise IndexError(i)
    value = 0
    for k, level in enumerate(levels):
        value |= level["chunks"][i] << (CHUNK * k)
        more = level["more"]
        if not more[i >> 3] >> (i & 7) & 1:
            break
        block = i // BLOCK
        rank = int.from_bytes(level["ranks"][4 * block : 4 * block + 4], "little")
        start = block * BLOCK // 8
        rank += int.from_bytes(more[start : i >> 3], "little").bit_count() + (more[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
        i = rank
    return value


def decoded(levels: list) -> np.ndarray:
    """All ids again."""
    if not levels:
        return np.empty(0, np.uint32)
    value = np.empty(0, np.uint32)
    for level in reversed(levels):
        own = np.frombuffer(level["chunks"], np.uint8).astype(np.uint32)
        more = np.unpackbits(np.frombuffer(level["more"], np.uint8), bitorder="little")[: len(own)].astype(bool)
        own[more] |= value << np.uint32(CHUNK)
        value = own
    return value


def token_codes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, levels) of every row, in its order and with repeats.

    A null text has null tokens and levels, an empty text 0 tokens and no level.  Whole
    texts are encoded, however long.  Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(tokenizer)
        for part in slices(batches):
            counts, levels = [], []
            for t in part.column(1).to_pylist():
                ids = None if t is None else enc.ids(t)
                counts.append(None if ids is None else len(ids))
                levels.append(None if ids is None else encoded(np.array(ids, dtype=np.uint32)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(levels, _ARROW)], names=["doc_id", "n_tokens", "levels"])

    kind = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("levels", _LEVELS)])
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, kind)


def tokens_at(levels: Column, position: Column) -> Column:
    """Token at a position of each row; null where the position or the levels are null or there is no such token."""

    def one(own, i) -> int | None:
        try:
            return None if own is None or i is None else token_at(own, int(i))
        except IndexError:
            return None

    @F.arrow_udf(T.LongType())
    def read(own: pa.Array, at: pa.Array) -> pa.Array:
        return pa.array([one(x, i) for x, i in zip(own.to_pylist(), at.to_pylist(), strict=True)], pa.int64())

    return read(levels, position)


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of the whole documents table.

    Nulls, empty and long texts, repeated rows, empty tables and further columns are as
    in ``token_codes``; there are no ties.
    """
    return token_codes(table(spark, sf_dir, "documents"))
