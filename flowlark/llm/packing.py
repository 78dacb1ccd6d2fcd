"""Packing of token sequences by length patterns fitted with non-negative least squares."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encode
from .scratch import partitions, saved

#: Lengths, spread over the documents, that serve as second member of patterns of three.
SECOND_MEMBERS = 24
#: Steps of the fit.
FIT_STEPS = 300


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids`` of every document's ids (by the file's library with its defaults, nothing added around) and ``end_id`` behind them.

    A document of more than ``capacity`` ids is cut; all its pieces but the first
    are full.  A null or empty text is the end id alone.  Rows without a doc_id and repeated rows are documents too.
    """

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ended = encode(source, path, pattern).select("doc_id", F.concat("ids", F.lit(end_id.to_bytes(4, "little"))).alias("ids"))
    total = (F.length("ids") / 4).cast("int")
    cut = ended.select("doc_id", "ids", (F.pmod(total - 1, F.lit(capacity)) + 1).alias("_first"), F.explode(F.sequence(F.lit(0), F.ceil(total / capacity).cast("int") - 1)).alias("piece"))
    start = F.when(F.col("piece") == 0, 0).otherwise(F.col("_first") + (F.col("piece") - 1) * capacity)
    cut = cut.select("doc_id", "piece", start.cast("long").alias("start"), F.when(F.col("piece") == 0, F.col("_first")).otherwise(capacity).cast("long").alias("length"), "ids")
    return cut.withColumn("ids", F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))"))


def _patterns(count: np.ndarray, capacity: int) -> np.ndarray:
    """Full patterns of two or three lengths that occur; 0 stands for no third."""
    have = np.flatnonzero(count[:capacity])
    two = have[(capacity - have <= have) & (count[capacity - have] > 0)]
    out = [np.stack([two, capacity - two, np.zeros_like(two)], 1)]
    if len(have):
        mass = np.cumsum(count[have])
        second = np.unique(have[np.searchsorted(mass, (np.arange(SECOND_MEMBERS) + 0.5) / SECOND_MEMBERS * mass[-1])])
        a, b = np.meshgrid(have, second, indexing="ij")
        a, b = a.ravel(), b.ravel()
        c = capacity - a - b
        ok = c > 0
        ok[ok] = count[c[ok]] > 0
        three = np.sort(np.stack([a[ok], b[ok], c[ok]], 1), axis=1)[:, ::-1]
        out.append(np.unique(three, axis=0) if len(three) else np.zeros((0, 3), int))
    return np.concatenate(out)


def _fit(patterns: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 for the least squares |A x - count|, by an accelerated projected gradient."""
    x = np.zeros(len(patterns))
    if not len(x):
        return x
    weight = (patterns > 0).astype(float)
    rows = patterns.ravel()

    def forward(v):
        return np.bincount(rows, (weight * v[:, None]).ravel(), len(count))

    v = np.random.default_rng(0).random(len(x))  # the largest curvature, by power iteration
    for _ in range(20):
        v /= np.linalg.norm(v)
        v = (forward(v)[patterns] * weight).sum(1)
    step, y, t = 1 / (1.05 * np.linalg.norm(v)), x, 1.0
    for _ in range(FIT_STEPS):
        new = np.maximum(y - step * ((forward(y) - count)[patterns] * weight).sum(1), 0)
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / u * (new - x), new, u
    return x


def plan(count: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of sequences that hold ``count[l]`` pieces of each length l.

    Its size depends on the capacity alone, not on the number of pieces.
    """
    left = count.astype(np.int64).copy()
    out = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    patterns = _patterns(left, capacity)
    x = _fit(patterns, left.astype(float))
    for i in np.argsort(-x, kind="stable").tolist():
        repeats = int(x[i])
        if repeats < 1:
            break
        lengths = [v for v in patterns[i].tolist() if v]
        repeats = min([repeats, *(int(left[v]) // lengths.count(v) for v in lengths)])
        if repeats > 0:
            for v in lengths:
                left[v] -= repeats
            out.append((tuple(lengths), repeats))
    return out + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """What rounding leaves: longest pieces first, each into the fullest sequence that has room; equal ones at once."""
    open_at: dict[int, list[list]] = {}  # room -> [lengths, repeats]
    rooms: list[int] = []

    def put(lengths: tuple[int, ...], repeats: int, room: int) -> None:
        if room not in open_at:
            open_at[room] = []
            insort(rooms, room)
        open_at[room].append([lengths, repeats])

    for length in range(capacity, 0, -1):
        todo = int(left[length])
        while todo:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                fits = capacity // length
                full, rest = divmod(todo, fits)
                if full:
                    put((length,) * fits, full, capacity - fits * length)
                if rest:
                    put((length,) * rest, 1, capacity - rest * length)
                break
            room = rooms[at]
            lengths, repeats = open_at[room].pop()
            if not open_at[room]:
                del open_at[room]
                rooms.pop(at)
            fits = min(room // length, -(-todo // repeats))
            used = min(repeats, todo // fits)
            if used < repeats:
                put(lengths, repeats - used, room)
            if used:
                put(lengths + (length,) * fits, used, room - fits * length)
            todo -= used * fits
    return [(tuple(lengths), repeats) for group in open_at.values() for lengths, repeats in group]


def pack(found: DataFrame, capacity: int = 2048) -> DataFrame:
    """``found`` (with ``doc_id, piece, length``) and ``sequence_id, offset``: each piece's place.

    A histogram of lengths (``capacity`` numbers, whatever the input) is all that
    the driver sees.  Pieces of one length are numbered in Spark, by salted parts of
    the length, and the plan says where the n-th piece of a length goes.  ``found`` is read
    twice, so it should be a written table.  An empty table stays empty.
    """
    spark = found.sparkSession
    count = np.zeros(capacity + 1, np.int64)
    for r in found.groupBy("length").count().collect():
        count[r["length"]] = r["count"]
    starts, base, offsets, key = [], [], [], []
    used, sequence = np.zeros(capacity + 1, np.int64), 0
    for lengths, repeats in plan(count, capacity):
        at = 0
        for v in lengths:
            key.append(v)
            starts.append(int(used[v]))
            base.append(sequence - int(used[v]))
            offsets.append(at)
            used[v] += repeats
            at += v
        sequence += repeats
    order = np.lexsort((starts, key)) if key else np.zeros(0, int)
    key, starts, base, offsets = (np.array(x, np.int64)[order] for x in (key, starts, base, offsets))
    sorted_key = key.astype(np.uint64) << np.uint64(48) | starts.astype(np.uint64)
    columns = [c for c in found.columns if c not in ("sequence_id", "offset")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_number"))
            at = np.searchsorted(sorted_key, length.astype(np.uint64) << np.uint64(48) | number.astype(np.uint64), "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(base[at] + number), pa.array(offsets[at])], names=[*columns, "sequence_id", "offset"])

    parts = partitions(spark)
    salted = found.select(*columns).withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    before = salted.groupBy("length", "_part").count()
    before = before.withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col("length").alias("_length"), F.col("_part").alias("_at"), F.coalesce("_before", F.lit(0)).alias("_before"))
    numbered = salted.withColumn("_row", F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece")))
    numbered = numbered.join(before, (F.col("length") == F.col("_length")) & (F.col("_part") == F.col("_at")))
    numbered = numbered.select(*columns, (F.col("_row") - 1 + F.col("_before")).cast("long").alias("_number"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in salted.schema if f.name in columns] + ["sequence_id long, offset long"])
    return numbered.mapInArrow(place, schema)


def packed_documents(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of all documents.

    Each document's pieces (see ``pieces``) go into as few sequences of ``capacity`` tokens as the
    plan finds.  Rows without a doc_id are packed as well; repeated rows are documents of their own.
    """
    found = pieces(docs, path, pattern, capacity, end_id).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(saved(found, "pieces"), capacity)


def sequences(found: DataFrame, capacity: int = 2048) -> DataFrame:
    """The packed rows themselves: ``sequence_id, length, ids`` from pieces that carry ``ids``."""
    placed = pack(found, capacity)
    rows = placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return rows.select("sequence_id", "length", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"))
