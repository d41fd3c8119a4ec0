"""Near-duplicate groups by SimHash, with all pairs of fingerprints up to a distance.

A text's fingerprint has ``BITS`` bits, each the sign of a sum over its distinct words.
All pairs that differ in at most ``DISTANCE`` bits are linked, none by chance: with
``BLOCKS`` blocks of ``BLOCK_BITS`` bits such a pair has a block in which at most
``DISTANCE`` // ``BLOCKS`` bits differ, and in one of its ``QUARTERS`` quarters at most a
quarter of these, so one bit.  Texts are put in buckets by a quarter; a bucket is compared with itself and
with those a bit away by the block, and pairs near there by the whole fingerprint.  That is an
eighth of all pairs of the larger check table, so its cost grows with the square of the texts.

A task has some of the blocks and all texts, or above ``TOGETHER`` texts one of the pairs of
parts of them.  Its links connect just what all its pairs connect: pairs of texts that are
connected already are passed over, and where a bucket abounds with them they are not even compared.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, fresh, lowered, shared_dir, slices, table, written
from .components import components

BITS, BLOCKS, QUARTERS, BLOCK_BITS = 512, 9, 4, 56
#: Bits in which two near copies' fingerprints differ at most.
DISTANCE = 68
#: Texts that a task holds; more are compared in pairs of parts of half as many.
TOGETHER = 1 << 20
_LANES = BITS // 64
#: Pairs that are compared at a time, and pairs up to which all are compared without buckets.
_TILE, _FEW = 1 << 16, 1 << 21
_WORD = re.compile(r"\w+")
#: Words whose bits a worker keeps; beyond it the store starts anew.
_KEPT = 50_000
_FIRST = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Fingerprints:
    """Fingerprints of texts; a word weighs 1 + ln(its count), in sixteenths so that sums are exact."""

    def __init__(self) -> None:
        self._row: dict[str, int] = {}
        self._bits = np.empty((_KEPT, BITS), dtype=np.int8)

    def _rows(self, found: list[str]) -> np.ndarray:
        row = self._row
        new = [w for w in found if w not in row]
        if new:
            if len(row) + len(new) > _KEPT:
                row.clear()
                new = found
            start, end = len(row), len(row) + len(new)
            h = np.array([xxhash.xxh3_64_intdigest(w) for w in new], dtype=np.uint64)
            lanes = _mixed(h[:, None] + _FIRST * np.arange(1, _LANES + 1, dtype=np.uint64)[None, :])
            bits = np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8).reshape(len(new), -1), axis=1)
            self._bits[start:end] = bits.view(np.int8) * 2 - 1
            row.update(zip(new, range(start, end), strict=True))
        return self._bits[[row[w] for w in found]]

    def of(self, text: str) -> np.ndarray | None:
        """Eight 64-bit words, or None where the text has no word."""
        count = Counter(_WORD.findall(lowered(text)))
        if not count:
            return None
        found = list(count)
        weight = np.array([round(16 * (1 + math.log(c))) for c in count.values()], dtype=np.float64 if len(found) > 50_000 else np.float32)
        total = np.zeros(BITS, dtype=weight.dtype)
        for k in range(0, len(found), 4096):
            total += weight[k : k + 4096] @ self._rows(found[k : k + 4096]).astype(weight.dtype)
        return np.packbits(total > 0).view(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h1, h2: digest, fp: eight longs or null) of each row with an id and a text.

    The digest is the fingerprint's, so texts of equal fingerprints share it; a text
    without any word has no fingerprint and its own digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprints()
        for b in slices(batches):
            h1, h2, fps = [], [], []
            for t in b.column(1).to_pylist():
                fp = make.of(t)
                d = xxhash.xxh3_128_intdigest(t, 1) if fp is None else xxhash.xxh3_128_intdigest(fp.tobytes())
                h1.append((d >> 64) - (1 << 63))
                h2.append((d & ((1 << 64) - 1)) - (1 << 63))
                fps.append(None if fp is None else fp.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(fps, pa.list_(pa.int64()))], names=["id", "h1", "h2", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).dropna()
    kind = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("fp", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(run, kind)


def walk(ids: np.ndarray, fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (a, b) that connect what all pairs within the distance connect."""
    left, links = np.arange(len(ids)), []
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            at = reached.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]).sum(1) <= distance
            found, left = left[near], left[~near]
            links += [(int(ids[at]), int(ids[x])) for x in found if ids[at] != ids[x]]
            reached += found.tolist()
    return links


def _block(fps: np.ndarray, k: int, quarter: int) -> np.ndarray:
    """The k-th block of each fingerprint, turned so that the quarter is on top."""
    lane, low = divmod(k * BLOCK_BITS, 64)
    v = fps[:, lane] >> np.uint64(low)
    if low + BLOCK_BITS > 64:
        v |= fps[:, lane + 1] << np.uint64(64 - low)
    turn, mask = quarter * (BLOCK_BITS // QUARTERS), np.uint64((1 << BLOCK_BITS) - 1)
    v &= mask
    return ((v << np.uint64(turn)) | (v >> np.uint64(BLOCK_BITS - turn))) & mask if turn else v


class _Links:
    """Links of verified pairs, each between texts that were not connected before.

    A label is a member of its set; ``_after`` leads from each member to the next and at last
    to the first again, so sets take two numbers a text whatever their sizes.
    """

    def __init__(self, fps: np.ndarray, distance: int):
        self.fps, self.distance = fps, distance
        self.label = np.arange(len(fps))
        self._after, self._size = array("q", range(len(fps))), array("q", [1]) * len(fps)
        self._ends = array("q")

    @property
    def links(self) -> np.ndarray:
        return np.array(self._ends, dtype=np.int64).reshape(-1, 2)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Compare pairs on the whole fingerprint and link those within the distance."""
        apart = self.label[i] != self.label[j]
        i, j = i[apart], j[apart]
        near = np.bitwise_count(self.fps[i] ^ self.fps[j]).sum(1, dtype=np.int64) <= self.distance
        for a, b in zip(i[near].tolist(), j[near].tolist(), strict=True):
            x, y = int(self.label[a]), int(self.label[b])
            if x == y:
                continue
            self._ends.extend((a, b))
            after, size = self._after, self._size
            if size[x] < size[y]:
                x, y = y, x
            less, at = [y], after[y]
            while at != y:
                less.append(at)
                at = after[at]
            self.label[less] = x
            after[x], after[y] = after[y], after[x]
            size[x] += size[y]

    def tile(self, rows: np.ndarray, cols: np.ndarray, row_values: np.ndarray, col_values: np.ndarray, radius: int) -> None:
        """Compare all rows with all columns by their values, then what is near there whole."""
        width = len(cols)
        found = np.flatnonzero(np.bitwise_count(row_values[:, None] ^ col_values[None, :]).ravel() <= radius)
        if len(found):
            self.add(rows[found // width], cols[found % width])


def _masks(bits: int, radius: int) -> list[int]:
    """Numbers of so many bits with at most ``radius`` ones, but 0."""
    out = {0}
    for _ in range(radius):
        out |= {m | (1 << i) for m in out for i in range(bits)}
    return sorted(out - {0})


def near_links(fps: np.ndarray, other: int, distance: int, blocks: range = range(BLOCKS)) -> np.ndarray:
    """Links, rows (a, b) of two rows of ``fps`` that connect what their pairs within the distance connect.

    The rows from ``other`` on are another part: each of the rows before it is compared with
    these only; where there is no other part, ``other`` is the number of rows, all rows are
    compared with each other.  The blocks are those that find a pair; all of them find all pairs.
    """
    n, apart = len(fps), other < len(fps)
    found = _Links(fps, distance)
    if other * (n - other if apart else n) <= _FEW:
        every = np.arange(n)
        for a in range(0, other, 256):
            rows = every[a : min(a + 256, other)]
            for c in range(other if apart else a, n, 256):
                cols = every[c : c + 256]
                near = np.bitwise_count(fps[rows][:, None] ^ fps[cols][None]).sum(2, dtype=np.int64) <= distance
                i, j = np.nonzero(near)
                found.add(rows[i], cols[j])
        return found.links
    block_radius = distance // BLOCKS
    width = BLOCK_BITS // QUARTERS
    masks = _masks(width, block_radius // QUARTERS)
    for k in blocks:
        for quarter in range(QUARTERS):
            v = _block(fps, k, quarter)
            top = (v >> np.uint64(BLOCK_BITS - width)).astype(np.int64)
            order = np.argsort(top[:other], kind="stable")
            size = np.bincount(top[:other], minlength=1 << width)
            start = np.r_[0, np.cumsum(size)].tolist()
            there, begin = (order, start) if not apart else (other + np.argsort(top[other:], kind="stable"), np.r_[0, np.cumsum(np.bincount(top[other:], minlength=1 << width))].tolist())
            of, near_of = v[order], v[there]
            for h in np.flatnonzero(size).tolist():
                a, z = start[h], start[h + 1]
                spans = [(begin[y], begin[y + 1]) for m in masks if ((y := h ^ m) > h or apart) and begin[y] < begin[y + 1]]
                if apart and begin[h] < begin[h + 1]:
                    spans.append((begin[h], begin[h + 1]))
                rows, values = order[a:z], of[a:z]
                cols = np.concatenate([there[x:y] for x, y in spans]) if spans else rows[:0]
                col_values = np.concatenate([near_of[x:y] for x, y in spans]) if spans else values[:0]
                if not apart:
                    cols, col_values = np.concatenate([rows, cols]), np.concatenate([values, col_values])
                if len(rows) * len(cols) > _TILE:
                    _large(found, rows, cols, values, col_values, block_radius, 0 if apart else len(rows))
                elif len(cols) > (not apart):
                    found.tile(rows, cols, values, col_values, block_radius)
    return found.links


def _large(found: _Links, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, col_values: np.ndarray, radius: int, own: int) -> None:
    """A large bucket: rows of one group leave out the columns of that group.  The first ``own`` columns are the rows."""
    own_rows, own_values = cols[:own], col_values[:own]
    cols, col_values = cols[own:], col_values[own:]
    done, turn = 0, 1
    while done < len(rows):
        if done >= turn:  # groups that have grown come together
            turn = 2 * done
            by = done + np.argsort(found.label[rows[done:]], kind="stable")
            rows, values = np.r_[rows[:done], rows[by]], np.r_[values[:done], values[by]]
            if own:
                own_rows, own_values = rows, values
        step = max(1, min(64, _TILE // 1024))
        part, part_values = rows[done : done + step], values[done : done + step]
        label = found.label[part]
        same = (label == label[0]).all()
        for c, cv in ((own_rows[done:], own_values[done:]), (cols, col_values)):
            if same and len(c):
                rest = found.label[c] != label[0]
                if not rest.all():
                    c, cv = c[rest], cv[rest]
            for x in range(0, len(c), 1024):
                found.tile(part, c[x : x + 1024], part_values, cv[x : x + 1024], radius)
        done += step


def _linked(distance: int, groups: int):
    """Links (a, b) of the numbers n, for rows (k, side, n, fingerprint) in the order of k and side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what a worker holds of a task: flat buffers, not Arrow's, which would stay beside them
        ids, fps, sides, task = array("q"), array("q"), 0, None

        def links() -> pa.RecordBatch:
            n, group = np.frombuffer(ids, dtype=np.int64), task % groups
            other = len(n) - sides
            got = near_links(np.frombuffer(fps, dtype=np.uint64).reshape(-1, _LANES), other, distance, range(group, BLOCKS, groups)) if other else np.empty((0, 2), dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(n[got[:, 0]]), pa.array(n[got[:, 1]])], names=["a", "b"])

        for b in batches:
            k = b.column("k").to_numpy()
            cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a == z:
                    continue
                if ids and k[a] != task:
                    yield links()
                    ids, fps, sides = array("q"), array("q"), 0
                task, part = int(k[a]), b.slice(a, z - a)
                sides += int(part.column("side").to_numpy().sum())
                ids.frombytes(part.column("n").to_numpy().tobytes())
                fps.frombytes(np.stack([part.column(f"f{i}").to_numpy() for i in range(_LANES)], axis=1).tobytes())
        pa.default_memory_pool().release_unused()
        if ids:
            yield links()

    return run


def _tasks(texts: DataFrame, count: int, together: int) -> tuple[DataFrame, int]:
    """(k, side, n, fingerprint) of each task that a text belongs to, and the number of groups of blocks."""
    parts = 1 if count <= together else -(-2 * count // together)
    groups = 1 if min(count, together) ** 2 <= _FEW else BLOCKS if parts == 1 else 3
    own = F.pmod(F.xxhash64("n"), F.lit(parts))
    tasks = F.expr(f"flatten(transform(sequence(0L, {parts - 1}L), j -> transform(sequence(0L, {groups - 1}L), g -> struct((least(own, j) * {parts}L + greatest(own, j)) * {groups}L + g AS k, int(own > j) AS side))))")
    lanes = [f"f{i}" for i in range(_LANES)]
    return texts.withColumn("own", own).select(F.explode(tasks).alias("t"), "n", *lanes).select("t.k", "t.side", "n", *lanes), groups


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, together: int = TOGETHER) -> DataFrame:
    """(doc_id, duplicate_of): every document that copies another, with the one that stays.

    A group is what exact copies and verified near copies connect; its smallest id, of any
    type that has an order, stays and doesn't appear on the left.  Rows with a null id or
    a null text take part in nothing.  Empty texts are exact copies of each other; texts
    without any word have no fingerprint and are only compared as wholes.  Rows that
    repeat an id are one document: links of any of its texts are its links.  Other columns
    are not read.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    at = shared_dir(spark)
    fps = written(fingerprints(docs, id_col, text_col), f"{at}/fingerprints")
    lanes = [F.first(F.col("fp")[i]).alias(f"f{i}") for i in range(_LANES)]
    reps = fps.groupBy("h1", "h2").agg(F.min("id").alias("rep"), *lanes)
    reps = written(reps.withColumn("n", F.monotonically_increasing_id()), f"{at}/texts")
    same = fps.join(reps.select("h1", "h2", "rep"), ["h1", "h2"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))

    texts = reps.where("f0 IS NOT NULL")
    tasks, groups = _tasks(texts.select("n", *(f"f{i}" for i in range(_LANES))), texts.count(), together)
    near = tasks.repartition("k").sortWithinPartitions("k", "side").mapInArrow(_linked(distance, groups), "a long, b long").distinct()
    for end in ("a", "b"):
        near = near.join(reps.select(F.col("n").alias(end), F.col("rep").alias(f"{end}_id")), end)
    edges = written(same.unionByName(near.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))), f"{at}/edges")
    out = components(edges, "a", "b").where("node <> component").select(F.col("node").alias("doc_id"), F.col("component").alias("duplicate_of"))
    for name in ("fingerprints", "texts"):  # the result may still read the edges
        dropped(spark, f"{at}/{name}")
    return out


def _once(rows: DataFrame) -> DataFrame:
    """Distinct rows; columns without an order (maps) are compared as they are written out."""
    plain = [f.name for f in rows.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    if len(plain) == len(rows.columns):
        return rows.dropDuplicates()
    name = fresh(rows, "__row")
    others = F.to_json(F.struct(*(F.col(c) for c in rows.columns if c not in plain)), {"ignoreNullFields": "false"})
    return rows.withColumn(name, others).dropDuplicates([*plain, name]).drop(name)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The rows of docs, less those that copy another: one document of each group stays.

    Rows with a null id or text stay.  Of rows that repeat an id, with equal columns, one
    stays; maps are equal where they are written alike.  All columns stay as they are.
    """
    name, other = fresh(docs, "__gone"), fresh(docs, "__again")
    gone = near_duplicates(docs, id_col, text_col, distance).select(F.col("doc_id").alias(name))
    again = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(other)).agg(F.count("*").alias("n")).where("n > 1").select(other)
    marked = docs.join(gone.hint("shuffle_hash"), F.col(id_col) == F.col(name), "left_anti")
    at = shared_dir(docs.sparkSession)
    again = written(again, f"{at}/again")
    if again.isEmpty():
        return marked
    repeated = _once(marked.join(again, F.col(id_col) == F.col(other), "left_semi"))
    return marked.join(again, F.col(id_col) == F.col(other), "left_anti").unionByName(repeated)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of the whole documents table with the document that stays of each group.

    Null ids and texts, empty and very long texts, ties, repeated rows, empty tables and
    further columns are as in ``near_duplicates``.
    """
    return near_duplicates(table(spark, sf_dir, "documents"))
