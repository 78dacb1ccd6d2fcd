"""How the words of a source diverge from those of other sources and of its language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import saved, small_batches

#: Whatever is no letter: terms are what lies between. Letters of other alphabets count, A-Z become small.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text that are split at once; partial counts that a task merges, and that it holds after merging before they leave.
SLICE_BYTES, MERGE_ROWS, HOLD_ROWS = 4 << 20, 1 << 20, 1 << 19
#: Counts in a shard, at least and at most; in between, a fourth of the square of the most sources of a language, so that shards don't
#: give more pairs than they read counts. Cells of a shard's columns that are compared at once.
LEAST_ROWS, MOST_ROWS, CELLS = 1 << 12, 1 << 21, 1 << 22
SCALE, SMOOTH = 1_000_000_000, 5

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with some megabytes of text each."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def _count(batch: pa.RecordBatch) -> pa.Table:
    """Occurrences of each term in each (lang, source) of the rows, and the rows that hold it; the term '' stands for the group itself."""
    words = pc.split_pattern_regex(pc.ascii_lower(batch.column("text")), BETWEEN)
    term, row = pc.list_flatten(words), pc.list_parent_indices(words)
    real = pc.not_equal(term, "")
    term, row = pc.filter(term, real).dictionary_encode(), pc.filter(row, real)
    by_row = pa.table({"row": row, "code": term.indices}).group_by(["row", "code"]).aggregate([([], "count_all")])
    # Groups of the rows as numbers, so that only numbers are hashed.
    lang, source = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
    group = pc.add(pc.multiply(lang.indices.cast(pa.int64()), len(source.dictionary)), source.indices.cast(pa.int64()))
    both = pa.table({"group": group.take(by_row["row"]), "code": by_row["code"], "n": by_row["count_all"]})
    both = both.group_by(["group", "code"]).aggregate([("n", "sum"), ("n", "count")])
    own = pc.unique(group)
    groups = pa.concat_arrays([both["group"].combine_chunks(), own])
    terms = pa.concat_arrays([term.dictionary.take(both["code"].combine_chunks()), pa.array([""] * len(own), pa.string())])
    zero = pa.array(np.zeros(len(own), np.int64))
    at = pc.divide(groups, max(len(source.dictionary), 1))
    columns = [
        lang.dictionary.take(at), source.dictionary.take(pc.subtract(groups, pc.multiply(at, len(source.dictionary)))), terms,
        pa.concat_arrays([both["n_sum"].combine_chunks(), zero]), pa.concat_arrays([both["n_count"].combine_chunks(), zero]),
    ]
    return pa.Table.from_arrays(columns, schema=_COUNTS)


def _merge(tables: list[pa.Table]) -> pa.Table:
    merged = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return merged.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(_COUNTS.names)


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the rows that one task reads, merged as long as they fit."""
    held, rows = [], 0
    for batch in batches:
        for part in _slices(batch):
            held.append(_count(part))
            rows += held[-1].num_rows
            if rows > MERGE_ROWS:
                held = [_merge(held)]
                rows = held[0].num_rows
                if rows > HOLD_ROWS:
                    yield from held[0].to_batches(1 << 16)
                    held, rows = [], 0
    if held:
        yield from _merge(held).to_batches(1 << 16)


def shares(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """``1 + floor(10**9 * (count + 5) / (total + 5 * terms))``, exact for totals below 9 * 10**15."""
    below = np.asarray(total + SMOOTH * terms, np.int64)
    above = np.broadcast_to(count + SMOOTH, np.broadcast_shapes(np.shape(count), below.shape))
    out = above // below
    rest = above - out * below
    for _ in range(3):  # three decimal digits at a time
        rest = rest * 1000
        digits = rest // below
        out, rest = out * 1000 + digits, rest - digits * below
    return out + 1


def _shard(limit: int):
    """Compares the sources of a language on one shard of its terms."""

    def run(table: pa.Table) -> pa.Table:
        lang = table["lang"][0].as_py()
        is_group = pc.is_null(table["term"])
        groups = table.filter(is_group).sort_by("source")
        source, total, terms = groups["source"].combine_chunks(), groups["n"].to_numpy(), int(groups["n_terms"][0].as_py())
        counts = table.filter(pc.invert(is_group))
        word = pc.unique(counts["term"])
        word = word.take(pc.sort_indices(word))
        at, of = pc.index_in(counts["term"], word).to_numpy(), pc.index_in(counts["source"], source).to_numpy()
        n, order = counts["n"].to_numpy(), np.argsort(at, kind="stable")
        at, of, n = at[order], of[order], n[order]
        wide = max(1, CELLS // len(source))
        apart = np.zeros((len(source), len(source)), np.int64)
        best: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
        for lo in range(0, len(word), wide):
            hi = min(len(word), lo + wide)
            cut = slice(*np.searchsorted(at, [lo, hi]))
            dense = np.zeros((len(source), hi - lo), np.int64)
            dense[of[cut], at[cut] - lo] = n[cut]
            own = shares(dense, total[:, None], terms)
            whole = shares(dense.sum(0), total.sum(), terms)
            for a in range(len(source) - 1):
                apart[a, a + 1 :] += np.abs(own[a + 1 :] - own[a]).sum(1)
            s, t = np.nonzero((dense > 0) & (own > whole))
            found = np.concatenate([best[0], np.stack([s, own[s, t] - whole[t], t + lo], 1)])
            found = found[np.lexsort((found[:, 2], -found[:, 1], found[:, 0]))]
            best = [found[np.arange(len(found)) - np.searchsorted(found[:, 0], found[:, 0]) < limit]]
        a, b = np.triu_indices(len(source), 1)
        s, f, t = best[0].T
        columns = [
            pa.array([lang] * (len(a) + len(s)), pa.string()), pa.concat_arrays([source.take(pa.array(a)), source.take(pa.array(s))]), pa.array(["pair"] * len(a) + ["term"] * len(s), pa.string()),
            pa.concat_arrays([source.take(pa.array(b)), pa.array(word.take(pa.array(t)).to_pylist(), pa.string())]), pa.array(np.concatenate([apart[a, b], f])),
        ]
        return pa.Table.from_arrays(columns, names=["lang", "source", "part", "item", "value"])

    return run


def audit(docs: DataFrame, least_docs: int = 30, limit: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank`` for each (lang, source) of ``docs(lang, source, text)``.

    Each row is a document.  A language keeps the terms that at least ``least_docs`` of its documents hold.  Part ``pair`` has the
    distance of the group to each other source of the language, over all kept terms; part ``term`` the ``limit`` terms that the group
    uses most above its language.  Shares are whole parts of 10**9, smoothed by 5, and all arithmetic is exact.

    Null texts, languages and sources are empty strings; empty texts and texts without terms still make their group; repeated rows
    count as often as they stand; ties go to the smaller item in the order of UTF-8 bytes; languages without kept terms have pairs of
    value 0 and no terms; without documents the result is empty; other columns are ignored.

    Texts become counts inside ``mapInArrow``; a shuffle by (lang, term) merges them, so that a hot source is no hot key.  Kept counts
    are dealt to shards of hashed terms, each with the totals of all sources, and give sums of distances and their first terms.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    partial = texts.mapInArrow(partial_counts, "lang string, source string, term string, n long, docs long")
    merged = partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    seen = merged.withColumn("docs", F.sum("docs").over(of_term)).withColumn("first", F.row_number().over(of_term.orderBy("source")) == 1)
    kept = saved(seen.where((F.col("docs") >= least_docs) | (F.col("term") == "")).drop("docs"), "counts")
    is_term = F.col("term") != ""
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum((F.col("first") & is_term).cast("long")).alias("n_terms"), F.count("*").alias("rows"))
    of_lang = Window.partitionBy("lang")
    groups = saved(groups.withColumn("n_terms", F.sum("n_terms").over(of_lang)).withColumn("sources", F.count("*").over(of_lang)), "groups")
    rows, most = groups.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.max("sources"), F.lit(0))).first()
    shards = 1 + rows // min(MOST_ROWS, max(LEAST_ROWS, most * most // 4))
    dealt = kept.where(is_term).select("lang", "source", "term", "n", F.lit(None).cast("long").alias("n_terms"), F.pmod(F.xxhash64("term"), F.lit(shards)).alias("shard"))
    totals = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), "n", "n_terms", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    schema = "lang string, source string, part string, item string, value long"
    found = saved(dealt.union(totals).groupBy("lang", "shard").applyInArrow(_shard(limit), schema), "divergences")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("source"), F.col("item")), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x")
    pairs = pairs.select("lang", "part", "value", both).select("lang", "x.source", "part", "x.item", "value")
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.unionByName(found.where("part = 'term'")).withColumn("rank", place).where((F.col("part") == "pair") | (F.col("rank") <= limit))
