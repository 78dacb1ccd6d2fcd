"""Near-duplicate vectors by the epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .scratch import partitions, saved
from .vectors import lengths, matrix, unit, valid

#: Principal directions are fitted on at most so many vectors; they only steer what is skipped.
SAMPLE_ROWS = 10_000
#: Directions that make the grid, and those whose bounds let blocks be skipped.
GRID, BOUNDS = 8, 10
#: Rows of an interval that is sent as one: an eighth of all, within these bounds, so that what is sent grows with
#: the rows up to 8 times the larger one.
BLOCK_ROWS = 2048, 16384
#: Rows of an interval that is compared at once.
LEAF_ROWS = 256


def _directions(rows: DataFrame) -> np.ndarray:
    """The leading principal directions of a sample by hash."""
    some = rows.orderBy(F.xxhash64("vec_id")).limit(SAMPLE_ROWS).select("embedding").toArrow()["embedding"].combine_chunks()
    if not len(some):
        return np.zeros((0, 0))
    x = unit(matrix(some))
    _, vectors = np.linalg.eigh(np.cov(x.T, ddof=0) if x.shape[1] > 1 else np.ones((1, 1)))
    return vectors[:, ::-1][:, :BOUNDS]


def _close(lo1, hi1, lo2, hi2, epsilon: float) -> bool:
    """Whether two boxes come within epsilon of each other."""
    gap = np.maximum(0, np.maximum(lo1 - hi2, lo2 - hi1))
    return float(gap @ gap) <= epsilon * epsilon * (1 + 1e-9)


def interval_links(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, least: float, epsilon: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) with ``a[i] @ b[j] >= least``; halves intervals and skips halves that are surely distant."""
    found_i, found_j = [], []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if i0 == i1 or j0 == j1 or (same and j1 <= i0):
            continue
        if not _close(pa_[i0:i1].min(0), pa_[i0:i1].max(0), pb[j0:j1].min(0), pb[j0:j1].max(0), epsilon):
            continue
        if i1 - i0 <= LEAF_ROWS and j1 - j0 <= LEAF_ROWS:
            i, j = np.nonzero(a[i0:i1] @ b[j0:j1].T >= least)
            i, j = i + i0, j + j0
            if same:
                i, j = i[i < j], j[i < j]
            found_i.append(i)
            found_j.append(j)
        elif i1 - i0 >= j1 - j0:
            m = (i0 + i1) // 2
            todo += [(i0, m, j0, j1), (m, i1, j0, j1)]
        else:
            m = (j0 + j1) // 2
            todo += [(i0, i1, j0, m), (i0, i1, m, j1)]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_i]), np.concatenate([none, *found_j])


def near_duplicates(rows: DataFrame, similarity: float = 0.95) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``rows(vec_id, embedding)``; exact.

    Vectors link when their cosine, in double precision, is ``similarity`` or more.
    ``n_links`` counts the other rows linked directly, copies too; ``component_id``
    is the smallest vec_id that links reach; ``kept`` marks it.  Vectors that are
    null, zero or hold null or non-finite components stand alone; those of different lengths have no cosine, so that each
    length is joined by itself.  Rows without a
    vec_id are left out, other columns ignored; an empty table gives an empty result.

    Unit vectors within an angle are within epsilon of each other, so also along each
    principal direction.  Vectors are sorted by their grid cells of that width and
    cut into intervals; two intervals meet if their bounds come within epsilon, and
    halve each other until what is left is compared.  Equal vectors are one to start
    with, counted.
    """
    rows = rows.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = rows.where(valid("embedding"))
    out = rows.where(~valid("embedding")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for length in lengths(good, "embedding"):
        out = out.unionByName(_linked(good.where(F.size("embedding") == length), similarity))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _linked(good: DataFrame, similarity: float) -> DataFrame:
    """``vec_id, n_links, component_id`` of usable vectors of one length."""
    spark = good.sparkSession
    distinct = saved(good.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")), "vectors")
    directions = _directions(distinct)
    epsilon = float(np.sqrt(max(0.0, 2 - 2 * similarity))) + 1e-9
    bounds = directions.shape[1]
    grid = min(GRID, bounds)
    cells = [f"c{i}" for i in range(grid)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("embedding"))
            cell = np.floor(unit(x) @ directions[:, :grid] / epsilon).astype(np.int32) if len(batch) else np.zeros((0, grid), np.int32)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(cell[:, i])) for i in range(grid)), batch.column("vec_id"), batch.column("copies"), batch.column("embedding")], names=[*cells, "vec_id", "copies", "embedding"])

    n = distinct.count()
    block_rows = min(max(-(-n // 8), BLOCK_ROWS[0]), BLOCK_ROWS[1])
    kind = dict(distinct.dtypes)["embedding"]
    placed = distinct.mapInArrow(place, ", ".join([*(f"{c} int" for c in cells), f"vec_id long, copies long, embedding {kind}"]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []

        def block(table: pa.Table) -> pa.RecordBatch:
            x = matrix(table["embedding"].combine_chunks())
            p = unit(x) @ directions
            lo, hi = p.min(0), p.max(0)
            at = np.floor(np.stack([lo, hi])[:, :grid] / epsilon).astype(int)
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([lo.tolist()]), pa.array([hi.tolist()]), pa.array([at[0].tolist()]), pa.array([at[1].tolist()]),
                 pa.array([table["vec_id"].to_numpy().tobytes()]), pa.array([table["copies"].to_numpy().tobytes()]), pa.array([np.ascontiguousarray(x).tobytes()]), pa.array([str(x.dtype)])],
                names=["block", "lo", "hi", "first_cell", "last_cell", "ids", "copies", "x", "dtype"],
            )

        for batch in batches:
            held.append(batch)
            while sum(len(b) for b in held) >= block_rows:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, block_rows))
                number += 1
                held = table.slice(block_rows).to_batches()
        if sum(len(b) for b in held):
            yield block(pa.Table.from_batches(held))

    schema = "block long, lo array<double>, hi array<double>, first_cell array<long>, last_cell array<long>, ids binary, copies binary, x binary, dtype string"
    intervals = max(1, min(partitions(spark), n // block_rows))
    ordered = placed.repartitionByRange(intervals, *cells, "vec_id").sortWithinPartitions(*cells, "vec_id")
    blocks = saved(ordered.mapInArrow(pack, schema), "blocks")
    boxes = blocks.select("block", "lo", "hi", "first_cell", "last_cell")
    # Intervals meet in a cell of the two leading directions, the second one widened by a cell.
    def spread(i: int, wide: int):
        return F.explode(F.sequence(F.col("first_cell")[i] - wide, F.col("last_cell")[i] + wide))

    left = boxes.select("block", "lo", "hi", spread(0, 0).alias("k0"), "first_cell", "last_cell")
    right = boxes.select(F.col("block").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), spread(0, 1).alias("k0"), "first_cell", "last_cell")
    if grid > 1:
        left, right = left.withColumn("k1", spread(1, 0)), right.withColumn("k1", spread(1, 1))
    left, right = left.drop("first_cell", "last_cell"), right.drop("first_cell", "last_cell")
    gap = "aggregate(zip_with(arrays_zip(lo, hi), arrays_zip(lo2, hi2), (p, q) -> greatest(0d, p.lo - q.hi2, q.lo2 - p.hi)), 0d, (s, g) -> s + g * g)"
    pairs = left.join(right, [c for c in ("k0", "k1") if c in left.columns]).where("block <= other").where(F.expr(gap) <= epsilon * epsilon * (1 + 1e-9)).select("block", "other").distinct()
    payload = blocks.select("block", "ids", "copies", "x", "dtype")
    other = payload.select(F.col("block").alias("other"), F.col("ids").alias("ids2"), F.col("copies").alias("copies2"), F.col("x").alias("x2"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                get = lambda c: batch.column(c)[r].as_py()  # noqa: E731, B023
                ids, ids2 = (np.frombuffer(get(c), np.int64) for c in ("ids", "ids2"))
                many, many2 = (np.frombuffer(get(c), np.int64) for c in ("copies", "copies2"))
                a, b = (unit(np.frombuffer(get(c), get("dtype")).reshape(len(k), -1)) for c, k in (("x", ids), ("x2", ids2)))
                same = get("block") == get("other")
                i, j = interval_links(a, b, a @ directions, b @ directions, similarity, epsilon, same)
                links = np.bincount(i, many2[j], len(ids)).astype(np.int64)
                links2 = np.bincount(j, many[i], len(ids2)).astype(np.int64)
                src, dst = forest(ids[i], ids2[j])
                vec = np.concatenate([ids[links > 0], ids2[links2 > 0], src])
                more = np.concatenate([links[links > 0], links2[links2 > 0], np.zeros(len(src), np.int64)])
                to = pa.array(np.concatenate([np.zeros(len(vec) - len(src), np.int64), dst]), mask=np.arange(len(vec)) < len(vec) - len(src))
                yield pa.RecordBatch.from_arrays([pa.array(vec), pa.array(more), to], names=["vec_id", "links", "to"])

    work = pairs.join(payload, "block").join(other, "other").repartition(4 * partitions(spark), F.xxhash64("block", "other"))
    found = saved(work.mapInArrow(compare, "vec_id long, links long, to long"), "links")
    counts = found.where("to is null").groupBy("vec_id").agg(F.sum("links").alias("links"))
    linked = components(found.where("to is not null").select(F.col("vec_id").alias("src"), F.col("to").alias("dst")))
    each = distinct.join(counts, "vec_id", "left").join(linked, distinct.vec_id == linked.id, "left")
    each = each.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", distinct.vec_id).alias("component_id"))
    return good.join(each, "embedding").select("vec_id", "n_links", "component_id")
