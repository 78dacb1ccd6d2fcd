"""Connected components of a graph of links, as Spark joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, saved


def components(edges: DataFrame) -> DataFrame:
    """``(id, component_id)`` for every end of ``edges(src, dst)``; the component is its smallest id.

    Alternates the large-star and small-star steps (Kiveris et al., 2014): each
    round moves every link to the smallest neighbour of one of its ends, so a
    chain of n links takes about log n rounds and no node's links are ever
    collected.  Null ends, loops and repeated links are ignored; without links
    the result is empty.
    """
    links = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    links = links.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    links = saved(links, "links")
    before = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        # Large star: larger neighbours go to the smallest of u's neighbours and u.
        both = links.union(links.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: smaller neighbours (and u) go to the smallest of them.
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        small = small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()
        old, links = links, saved(small, "links")
        dropped(old)
    roots = links.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return links.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(roots)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links ``a[i] - b[i]``, as links to each tree's smallest end."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        x, y = label[u], label[v]
        low = np.minimum(x, y)
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        label = label[label]
        if np.array_equal(before, label):
            break
    at = np.flatnonzero(label != np.arange(len(ids)))
    return ids[label[at]], ids[at]
