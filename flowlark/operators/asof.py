"""As-of joins of times with the starts of files (or of numbers with the starts of ranges).

Times and starts are cut at quantiles of both together, so that parts are of one size whatever the days hold; each start
goes to the parts that its reach touches, and a part is merged in one pass over its sorted columns.  Equal times are one, so an
instant that very many share isn't a hot part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Times and starts in a part, about.
PART_ROWS = 1 << 20


def _cuts(times: DataFrame, starts: DataFrame, rows: int) -> list[float]:
    """Where parts begin, but the first: quantiles of times and starts. They are as many as parts, not as rows."""
    both = times.select("t").union(starts.select("start"))
    n = -(-both.count() // rows)
    if n < 2:
        return []
    places = [i / n for i in range(1, n)]
    found = both.agg(F.percentile_approx("t", F.array(*map(F.lit, places)), F.lit(max(10_000, 20 * n)))).first()[0]
    return sorted(set(found))


def _part(value: Column, cuts: list[float]) -> Column:
    if not cuts:
        return F.lit(0)

    @F.pandas_udf("int")
    def of(t: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, t.to_numpy(), "right").astype("int32"))

    return of(value)


def in_order(starts: DataFrame, cuts: list[float]) -> DataFrame:
    """``(start, before, after)`` of distinct starts: the start on either side; null at the ends.

    Ordered part by part; only the first and last of each part are ordered in one task.
    """
    known = starts.withColumn("_p", _part(F.col("start"), cuts))
    within = Window.partitionBy("_p").orderBy("start")
    near = known.withColumns({"before": F.lag("start").over(within), "after": F.lead("start").over(within)})
    ends = known.groupBy("_p").agg(F.min("start").alias("_first"), F.max("start").alias("_last"))
    row = Window.orderBy("_p")
    ends = ends.select("_p", F.lag("_last").over(row).alias("_back"), F.lead("_first").over(row).alias("_on"))
    return near.join(F.broadcast(ends), "_p").select("start", F.coalesce("before", "_back").alias("before"), F.coalesce("after", "_on").alias("after"))


def previous_starts(starts: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """``(start, previous)`` of distinct starts, none null."""
    return in_order(starts, _cuts(starts.withColumnRenamed("start", "t"), starts.limit(0), part_rows)).select("start", F.col("before").alias("previous"))


def _merge(mode: str, overlap: float):
    names = {"floor": ["t", "start"], "nearest": ["t", "start", "previous"], "overlap": ["t", "start"]}[mode]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        t = np.sort(left["t"].to_numpy())
        order = np.argsort(right["start"].to_numpy())
        s = right["start"].to_numpy()[order]
        empty = lambda name, fill: right[name].fill_null(fill).to_numpy()[order]
        if mode == "overlap":
            first = np.searchsorted(empty("after", np.inf) + overlap, t, "right")  # reaches beyond t
            many = np.maximum(np.searchsorted(s, t, "left") - first, 0)
            at = np.repeat(first - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
            return pa.table([pa.array(np.repeat(t, many)), pa.array(s[at])], names=names)
        at = np.searchsorted(s, t, "right") - 1
        if mode == "nearest" and len(s):
            low, high = np.clip(at, 0, None), np.clip(at + 1, None, len(s) - 1)
            at = np.where(np.abs(s[high] - t) < np.abs(t - s[low]), high, low)
        none = at < 0 if len(s) else np.ones(len(t), bool)
        column = lambda values: pa.array(values[np.clip(at, 0, None)] if len(s) else np.zeros(len(t)), mask=none)
        out = [pa.array(t), column(s)]
        if mode == "nearest":
            before = empty("before", np.nan)
            found = before[np.clip(at, 0, None)] if len(s) else np.zeros(len(t))
            out.append(pa.array(found, mask=none | np.isnan(found)))
        return pa.table(out, names=names)

    return run, ", ".join(f"{n} double" for n in names)


def asof(times: DataFrame, starts: DataFrame, mode: str = "floor", overlap: float = 0.0, part_rows: int = PART_ROWS) -> DataFrame:
    """Each distinct time ``t`` with its start.

    ``floor``: ``(t, start)``, the latest start that isn't after t; null before the first.
    ``nearest``: ``(t, start, previous)``, the start with the least absolute difference, of two equally near ones the earlier, and the
    start before that one, null for the first.  ``overlap``: ``(t, start)`` for every start before t whose successor plus
    ``overlap`` is after t; the last start reaches as far as times go, times without any give no rows.

    Null times and starts are left out; repeated ones count once; either table may be empty.
    """
    held = times.select(F.col("t").cast("double").alias("t")).where("t is not null").distinct()
    known = starts.select(F.col("start").cast("double").alias("start")).where("start is not null").distinct()
    cuts = _cuts(held, known, part_rows)
    edge = F.lit(float("inf"))
    reach = {"floor": ("start", "after"), "nearest": ("before", "after"), "overlap": ("start", "after")}[mode]
    lo, hi = F.coalesce(reach[0], -edge), F.coalesce(F.col(reach[1]) + (overlap if mode == "overlap" else 0.0), edge)
    spread = in_order(known, cuts).withColumns({"_lo": _part(lo, cuts), "_hi": _part(hi, cuts)})
    spread = spread.select("start", "before", "after", F.explode(F.sequence("_lo", "_hi")).alias("_p"))
    run, schema = _merge(mode, overlap)
    return held.withColumn("_p", _part(F.col("t"), cuts)).groupBy("_p").cogroup(spread.groupBy("_p")).applyInArrow(run, schema)
