"""Address ranges of several databases, cut into intervals that each have one answer of every database."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlark.functions.net import cidr_range, ip_to_long
from flowlark.operators.asof import asof

#: Leading bits of an address that are swept together.
PREFIX_BITS = 12


def read_ranges(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """``(lo, hi, *columns)`` from CSV files with a header: a ``network`` as ``a.b.c.d/n``, or ``lo`` and ``hi`` as addresses or numbers.

    Lines without a range that can be read are left out; columns that a file lacks are null; the rest of a line is ignored.
    """
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    number = lambda c: F.coalesce(ip_to_long(F.col(c)), F.col(c).try_cast("long"))
    if "network" in raw.columns:
        lo, hi = cidr_range(F.col("network"))
    else:
        lo, hi = number("lo"), number("hi")
    values = [(F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string")).alias(c) for c in columns]
    return raw.select(lo.alias("lo"), hi.alias("hi"), *values).where("lo is not null and hi is not null and lo <= hi")


def _sweep(sides: int):
    """Elementary intervals of one prefix: at every place each side answers by its range that begins last, of those the shortest."""

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        first = table["_first"][0].as_py()
        last = first + (1 << (32 - PREFIX_BITS)) - 1
        side, lo, hi, row = (table[c].to_pylist() for c in ("_side", "lo", "hi", "_row"))
        order = sorted(range(len(lo)), key=lambda i: lo[i])
        cuts = sorted({first, *(max(first, x) for x in lo), *(x + 1 for x in hi if x < last)})
        heaps: list[list[tuple]] = [[] for _ in range(sides)]
        out: list[list] = []
        at = 0
        for n, cut in enumerate(cuts):
            while at < len(order) and lo[order[at]] <= cut:
                i = order[at]
                heapq.heappush(heaps[side[i]], (-lo[i], hi[i], row[i]))
                at += 1
            found = []
            for heap in heaps:
                while heap and heap[0][1] < cut:
                    heapq.heappop(heap)
                found.append(heap[0][2] if heap else None)
            end = cuts[n + 1] - 1 if n + 1 < len(cuts) else last
            if any(x is not None for x in found):
                if out and out[-1][2:] == found and out[-1][1] + 1 == cut:
                    out[-1][1] = end
                else:
                    out.append([cut, end, *found])
        columns = [pa.array([r[i] for r in out], pa.int64()) for i in range(sides + 2)]
        return pa.Table.from_arrays(columns, names=["lo", "hi", *(f"_r{i}" for i in range(sides))])

    return run


def elementary(databases: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """``(lo, hi, *columns)``: intervals that don't overlap, with the columns of every database.

    Each database is ``(lo, hi, ...)`` and the columns that are asked of it.  Its ranges may be nested or overlap: at each address the
    one that begins last answers, which in nested ones is the innermost; of ranges with one beginning the shortest; of equal ranges
    that with the least values.  Addresses that no database knows are in no interval; where a database alone knows nothing its columns are null.
    Ranges are swept apart for each prefix of 12 bits.
    """
    parts, values = None, []
    for i, (table, columns) in enumerate(databases):
        known = table.where("lo is not null and hi is not null and lo <= hi and hi >= 0 and lo < 4294967296").groupBy("lo", "hi").agg(F.min(F.struct(*columns)).alias("x"))
        # A range is told by both ends, as one number.
        row = F.col("lo") * (1 << 32) + F.col("hi") - (1 << 62)
        known = known.select(F.greatest("lo", F.lit(0)).cast("long").alias("lo"), F.least("hi", F.lit(4294967295)).cast("long").alias("hi"), "x").withColumn("_row", row)
        first, last = (F.shiftright(c, 32 - PREFIX_BITS) for c in ("lo", "hi"))
        spread = known.select(F.lit(i).alias("_side"), "lo", "hi", "_row", F.explode(F.sequence(first, last)).alias("_p"))
        parts = spread if parts is None else parts.unionByName(spread)
        values.append(known.select(F.col("_row").alias(f"_r{i}"), F.col("x")).select(f"_r{i}", *(F.col("x")[c].alias(c) for c in columns)))
    schema = ", ".join(["lo long", "hi long", *(f"_r{i} long" for i in range(len(databases)))])
    swept = parts.withColumn("_first", F.shiftleft(F.col("_p").cast("long"), 32 - PREFIX_BITS)).groupBy("_p").applyInArrow(_sweep(len(databases)), schema)
    for i, found in enumerate(values):
        swept = swept.join(found, f"_r{i}", "left")
    return swept.select("lo", "hi", *(c for _, columns in databases for c in columns))


def located(rows: DataFrame, intervals: DataFrame, ip: str, columns: list[str]) -> DataFrame:
    """Left join of each row with the interval ``(lo, hi, *columns)`` that holds its address; intervals don't overlap.

    Distinct addresses are looked up in one pass beside the sorted intervals, each once; rows without an address that is a number have nulls.
    """
    number = ip_to_long(F.col(ip))
    numbers = rows.select(number.cast("double").alias("t"))
    found = asof(numbers, intervals.select(F.col("lo").alias("start")), "floor").where("start is not null")
    held = intervals.select(F.col("lo").cast("double").alias("start"), F.col("hi").alias("_hi"), *(F.col(c).alias(f"_v{i}") for i, c in enumerate(columns)))
    answers = found.join(held, "start").where(F.col("t") <= F.col("_hi")).select(F.col("t").alias("_t"), *(F.col(f"_v{i}").alias(c) for i, c in enumerate(columns)))
    return rows.join(answers, number.cast("double") == F.col("_t"), "left").drop("_t")
