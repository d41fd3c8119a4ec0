"""Language by compression: the language whose dictionary makes a text smallest.

Each language has a zstandard raw-content dictionary of labelled text.  A text is cut
into pieces, every piece is compressed with every dictionary, and the sizes are added up
over the whole text; the smallest sum names the language.  Where the second smallest is
within ``margin`` of it, relative to it, the text is rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table

#: Labelled documents of a language that its dictionary is fitted on at most, and bytes of each.
SAMPLE_DOCS, SAMPLE_BYTES = 96, 1024
#: Languages that can be told apart; every worker holds a dictionary of each.
LANGUAGES = 512
#: Bytes compressed at a time; short enough that the dictionary stays what most is copied from.
PIECE = 2048
#: Spaces after each piece: a piece on its own may be too short to be stored compressed at all.
PAD = b" " * 256
#: Relative difference of the two smallest sizes up to which a text is rejected.
MARGIN = 0.003


def dictionaries(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs: int = SAMPLE_DOCS, doc_bytes: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Raw dictionary content by language, from a bounded sample of labelled rows.

    The sample is the ``docs`` rows of each language that come first by a hash of the id
    (of the text where the id is null) and of the text, with ``doc_bytes`` from the middle
    of each: the documented bound of the fit.  Rows with a null label or text and empty
    texts are no labelled rows, equal rows are one.  Languages without a sample have no
    dictionary; more than ``LANGUAGES`` labels are an error.

    Labels are counted first; then one scan takes the rows below a hash that lets about
    four times ``docs`` of each language through, and of these the first are kept.  Only
    where repeated rows leave too few is the share widened and the scan repeated.
    """
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counted = rows.where("lang IS NOT NULL").groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(counted) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    many = {r["lang"]: r["count"] for r in counted}
    rows = rows.where("lang IS NOT NULL AND text <> ''").withColumn("h", F.md5(F.coalesce("id", "text")))
    middle = F.greatest(F.lit(1), ((F.length("text") - doc_bytes) / 2).cast("int"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))
    found: list = []
    share = {name: min(1.0, (4 * docs + 64) / n) for name, n in many.items()}
    while share:
        passed = F.lit(False)
        for name, part in share.items():
            own = F.col("lang") == name
            passed = passed | (own if part >= 1 else own & (F.col("h") < f"{int(part * 2**32):08x}"))
        some = rows.where(passed).select("lang", "h", F.xxhash64("text").alias("t"), F.substring("text", middle, F.lit(doc_bytes)).alias("part"))
        got = some.withColumn("again", F.row_number().over(Window.partitionBy("lang", "h", "t").orderBy("part"))).where(F.col("again") == 1).withColumn("place", place).where(F.col("place") <= docs).select("lang", "h", "t", "part").collect()
        have = Counter(r.lang for r in got)
        found += [r for r in got if have[r.lang] >= docs or share[r.lang] >= 1]
        share = {name: min(1.0, 16 * part) for name, part in share.items() if have[name] < docs and part < 1}
    out: dict[str, bytes] = {}
    for name in sorted({r.lang for r in found}):
        parts = sorted((r.h, r.t, r.part) for r in found if r.lang == name)
        out[name] = b"\n".join(x.lower().encode()[:doc_bytes] for _, _, x in parts)
    return out


class Sizes:
    """Compressed sizes of a text in lower case by language."""

    def __init__(self, dicts: dict[str, bytes], piece: int = PIECE):
        import zstandard as z

        self.langs, self.piece, self._with = sorted(dicts), piece, []
        params = z.ZstdCompressionParameters(window_log=18, chain_log=17, hash_log=17, search_log=8, min_match=4, target_length=32, strategy=z.STRATEGY_GREEDY, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False)
        for name in self.langs:
            d = z.ZstdCompressionDict(dicts[name], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self._with.append(z.ZstdCompressor(dict_data=d, compression_params=params).compress)

    def of(self, text: str) -> list[int]:
        raw = text.lower().encode()
        parts = [raw[k : k + self.piece] + PAD for k in range(0, len(raw), self.piece)]
        return [sum(len(c(p)) for p in parts) for c in self._with]

    def language(self, text: str | None, margin: float = MARGIN) -> tuple[str | None, float, bool]:
        """(smallest, relative margin, accepted)."""
        if not text or not self.langs:
            return None, 0.0, False
        order = sorted(zip(self.of(text), self.langs, strict=True))
        gap = (order[1][0] - order[0][0]) / order[0][0] if len(order) > 1 else 1.0
        return order[0][1], gap, gap > margin


def identified(docs: DataFrame, dicts: dict[str, bytes], text_col: str = "text", margin: float = MARGIN, out: tuple[str, str, str] = ("language", "language_margin", "language_accepted")) -> DataFrame:
    """All rows and columns of docs with the language, its margin and whether it is accepted.

    Null and empty texts have no language and are rejected; so is everything where there
    is no dictionary.  Equal sizes are a margin of 0, which is rejected; of equally small
    languages the first in alphabetical order is named.  With one dictionary the margin
    is 1.  Whole texts are compressed, however long.  Columns of docs named like the new
    ones are replaced.
    """
    base = docs.drop(*out)
    at = base.columns.index(text_col)
    schema = T.StructType([*base.schema.fields, T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType()), T.StructField(out[2], T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(dicts)
        for b in slices(batches):
            found = [sizes.language(t, margin) for t in b.column(at).to_pylist()]
            new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *out])

    return base.mapInArrow(run, schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by dictionaries fitted on a bounded sample of the labels.

    Null ids and texts, empty and long texts, ties, repeated rows, empty tables and
    further columns are as in ``dictionaries`` and ``identified``.
    """
    docs = table(spark, sf_dir, "documents")
    return identified(docs.select("doc_id", "text"), dictionaries(docs)).drop("text")
