"""Addresses and the behaviours (clusters) that they share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlark.operators.scratch import forget, kept, kept_together

#: Greedy groups go on without pairs while a round places at least this part of the addresses that are left.
WORTH_A_ROUND = 0.05
#: Sets of at most so many behaviours in all are compared as rows of bits, in blocks of so many sets, where that is less than
#: so many times the work of meeting by behaviours; of a block so many sets meet so many of the other at once. There are at most so many
#: blocks, as each is shuffled once for each other: with more sets blocks grow, not their number.
FEW_BEHAVIOURS, BLOCK, WORTH_BLOCKS, STRIP, BLOCKS = 1024, 8192, 20, 256, 32


def _once(edges: DataFrame) -> DataFrame:
    """Distinct ``(ip, cluster)`` as a written table; rows of an address stand together, so that counts by address are all but done before they are shuffled."""
    if hasattr(edges, "_is_once"):
        return edges
    out = kept(edges.select("ip", "cluster").repartition("ip").distinct())
    out._is_once = True
    return out


def _of_several(rows: DataFrame, key: str) -> DataFrame:
    """A written table of the rows whose ``key`` several rows have.

    Either such keys are looked up or the others, whichever are fewer; they are written first, so that Spark knows their size and broadcasts a
    few instead of shuffling the rows.
    """
    counted = kept(rows.groupBy(key).agg(F.count("*").alias("n")))
    several, single = counted.agg(F.count_if(F.col("n") > 1), F.count_if(F.col("n") == 1)).first()
    keys = kept(counted.where("n > 1" if several < single else "n = 1").select(key))
    out = kept(rows.where(F.col(key).isNotNull()).join(keys, key, "left_semi" if several < single else "left_anti"))
    forget(counted, keys)
    return out


def prune(edges: DataFrame) -> DataFrame:
    """Distinct ``(ip, cluster)`` without behaviours of one address, then without addresses of one behaviour; a written table."""
    once = _once(edges)
    left = _of_several(once, "cluster")
    out = _of_several(left, "ip").select("ip", "cluster")
    out._is_once = True
    forget(left, *([] if once is edges else [once]))
    return out


def _score(common: Column, na: Column, nb: Column, total: Column) -> Column:
    """With p the larger set's part of all behaviours: p * cosine + (1 - p) * Jaccard."""
    p = F.greatest(na, nb) / total
    return p * (common / F.sqrt(na * nb)) + (1 - p) * (common / (na + nb - common))


def _total(edges: DataFrame) -> DataFrame:
    return edges.agg(F.countDistinct("cluster").alias("total"))


def _size_class(n: Column) -> Column:
    """Small sets by their size, larger ones by powers of one and a half."""
    return F.when(n <= 8, n).otherwise(9 + F.floor(F.log(n / 9) / F.log(F.lit(1.5)))).cast("int")


def pair_scores(edges: DataFrame, threshold: float = 0.0) -> DataFrame:
    """``(a, b, common, score)`` with a < b of addresses that share a behaviour and score more than ``threshold``, by a mix of cosine and Jaccard.

    Pairs without a common behaviour score 0 and aren't made.  To score more than the threshold with a set of a
    given size, a set must have more than r behaviours in common with it; so the two meet in what is left of the
    set without its r most common behaviours.  Each set so asks each class of sizes for partners; behaviours that very many addresses
    share make no pairs unless the sets are so small, or so much alike, that they count.

    Where behaviours are few and counting shows that sets would meet at them more often than all pairs are worth, blocks of sets are
    compared as matrices of bits: only pairs that score leave a task, and what is shuffled are the blocks.
    """
    edges = _once(edges).select("ip", "cluster")
    shared = kept(edges.groupBy("cluster").agg(F.count("*").alias("df")))
    sizes = edges.groupBy("ip").agg(F.count("*").alias("n"), F.collect_list("cluster").alias("set"))
    # As many rows as the logarithm of the largest set's size.
    classes = sizes.groupBy(_size_class(F.col("n")).alias("other")).agg(F.min("n").alias("lo"), F.max("n").alias("hi")).crossJoin(_total(edges))
    ranked = edges.join(shared, "cluster").withColumn("_at", F.row_number().over(Window.partitionBy("ip").orderBy("df", "cluster")))
    ranked = ranked.withColumn("n", F.count("*").over(Window.partitionBy("ip"))).withColumn("own", _size_class(F.col("n"))).crossJoin(F.broadcast(classes))
    # A * c + B * c / (S - c) > threshold, with the bounds of cosine, Jaccard and p that the sizes of the class allow.
    p = F.greatest("n", "hi") / F.col("total")
    cos, jac, both = p / F.sqrt(F.col("n") * F.col("lo")), 1 - p, F.col("n") + F.col("lo")
    linear = cos * both + jac + threshold
    r = F.floor(2 * threshold * both / (linear + F.sqrt(F.greatest(linear * linear - 4 * cos * threshold * both, F.lit(0.0)))) * (1 - 1e-9))
    prefix = ranked.where((r < F.least("n", "hi")) & (F.col("_at") <= F.col("n") - r)).select("ip", "cluster", "own", "other")
    behaviours, addresses = shared.count(), sizes.count()
    if behaviours <= FEW_BEHAVIOURS:
        asks = prefix.groupBy("cluster", "own", "other").agg(F.count("*").cast("double").alias("n"))
        answers = asks.toDF("cluster", "other", "own", "m")
        meetings = asks.join(answers, ["cluster", "own", "other"]).agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0.0))).first()[0] / 2
        if addresses * addresses / 2 <= WORTH_BLOCKS * meetings:
            return _pairs_of_blocks(edges, shared, behaviours, addresses, threshold)
    left, right = prefix.toDF("a", "cluster", "x", "y"), prefix.toDF("b", "cluster", "y", "x")
    met = left.join(right, ["cluster", "x", "y"]).where("a < b").select("a", "b").distinct()
    found = met.join(sizes.toDF("a", "na", "sa"), "a").join(sizes.toDF("b", "nb", "sb"), "b").withColumn("common", F.size(F.array_intersect("sa", "sb")).cast("long"))
    found = found.crossJoin(F.broadcast(_total(edges))).withColumn("score", _score(F.col("common"), F.col("na"), F.col("nb"), F.col("total")))
    return found.where(F.col("score") > threshold).select("a", "b", "common", "score")


def _pairs_of_blocks(edges: DataFrame, shared: DataFrame, behaviours: int, addresses: int, threshold: float) -> DataFrame:
    """``pair_scores`` of all pairs of addresses, by products of blocks of sets; ``shared`` has a row for each of a few behaviours."""
    place = shared.select("cluster", (F.row_number().over(Window.orderBy("cluster")) - 1).alias("_bit"))  # as few rows as behaviours
    words = -(-behaviours // 64)
    bit = lambda w: F.when(F.floor(F.col("_bit") / 64) == w, F.expr("shiftleft(1L, cast(_bit % 64 as int))"))
    sets = edges.join(F.broadcast(place), "cluster").groupBy("ip").agg(F.array(*(F.coalesce(F.bit_or(bit(w)), F.lit(0).cast("long")) for w in range(words))).alias("bits"))
    blocks = max(min(-(-addresses // BLOCK), BLOCKS), min(8, -(-addresses // STRIP)))
    dealt = sets.groupBy(F.pmod(F.xxhash64("ip"), F.lit(blocks)).cast("long").alias("block")).agg(F.collect_list(F.struct("ip", "bits")).alias("all"))
    dealt = kept(dealt.select("block", F.col("all.ip").alias("ips"), F.flatten("all.bits").alias("bits")))
    # Each pair of blocks is two rows, the earlier block first; a block with itself is one.
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    ways = dealt.select("*", other.alias("other")).select((F.least("block", "other") * blocks + F.greatest("block", "other")).alias("pair"), "block", "ips", "bits")
    kind = edges.schema["ip"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("common", T.LongType()), T.StructField("score", T.DoubleType())])

    def packed(row: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
        return row["ips"][0].values, row["bits"][0].values.to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8 * words)

    def matrix(ips: pa.Array, bits: np.ndarray, at: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        full = np.unpackbits(bits[at : at + BLOCK], axis=1, bitorder="little").astype(np.float32)
        return ips[at : at + BLOCK], full, full.sum(1).astype(np.int64)

    def compared(left: tuple, right: tuple, alone: bool) -> Iterator[pa.RecordBatch]:
        # As bytes and more the sets are held BLOCK by BLOCK only, however large their blocks.
        for i in range(0, len(left[1]), BLOCK):
            one = matrix(*left, i)
            for j in range(i if alone else 0, len(right[1]), BLOCK):
                yield from scored(one, matrix(*right, j), alone and i == j)

    def scored(left: tuple, right: tuple, alone: bool) -> Iterator[pa.RecordBatch]:
        (ips, x, n), (others, y, m) = left, right
        # Sorted by size, so that a strip's least bound is near that of each of its pairs.
        order = np.argsort(n, kind="stable")
        for at in range(0, len(order), STRIP):
            rows = order[at : at + STRIP]
            common = x[rows] @ y.T
            total, most, size = behaviours, np.maximum(n[rows].max(), m), n[rows].min()
            # No pair of the strip and a set of size m scores more than with the largest p for the cosine and the smallest for Jaccard.
            cos, jac, both = most / total / np.sqrt(size * m), 1 - np.maximum(size, m) / total, size + m
            linear = cos * both + jac + threshold
            least = 2 * threshold * both / (linear + np.sqrt(np.maximum(linear * linear - 4 * cos * threshold * both, 0)))
            i, j = np.nonzero(common > np.maximum(least * (1 - 1e-6), 0).astype(np.float32) * np.float32(1 - 1e-6))
            count, i = common[i, j].astype(np.int64), rows[i]
            if alone:
                once = i < j
                i, j, count = i[once], j[once], count[once]
            p = np.maximum(n[i], m[j]) / total
            score = p * (count / np.sqrt((n[i] * m[j]).astype(np.float64))) + (1 - p) * (count / (n[i] + m[j] - count))
            good = score > threshold
            if good.any():
                a, b = ips.take(pa.array(i[good])), others.take(pa.array(j[good]))
                yield pa.RecordBatch.from_arrays([a, b, pa.array(count[good]), pa.array(score[good])], names=["a", "b", "common", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, left = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                now, block = row["pair"][0].as_py(), row["block"][0].as_py()
                if now // blocks == now % blocks:
                    one = packed(row)
                    yield from compared(one, one, True)
                elif now == pair:
                    yield from compared(left, packed(row), False)
                    pair, left = None, None
                else:
                    pair, left = now, packed(row)

    # Tasks are told how many, as little data is much work here.
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(blocks * (blocks + 1) // 2, 2000))
    met = ways.repartition(parts, "pair").sortWithinPartitions("pair", "block").mapInArrow(run, schema)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "common", "score")


def _like_sets(edges: DataFrame) -> DataFrame:
    """``(ip, n, same)``: how many behaviours an address has, and the smallest address with the same set of them.

    Sets that may be equal are found by their size and two 64-bit combinations of hashes. They are equal if all together hold no more
    behaviours than each of them; where they hold more, each is compared with the one that stands for them, and
    an address whose set differs stands for itself.
    """
    one = kept(edges.groupBy("ip").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("cluster")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), "cluster")).alias("g")))
    alike = one.groupBy("n", "h", "g").agg(F.min("ip").alias("same"), F.count("*").alias("of"))
    likely = kept(one.join(alike, ["n", "h", "g"]).select("ip", "n", "same", "of"))
    several = kept(likely.where("of > 1").select("ip", "n", "same"))
    together = edges.where("cluster is not null").join(several, "ip").select("same", "cluster").distinct().groupBy("same").agg(F.count("*").alias("m"))
    unlike = kept(several.where("ip = same").join(together, "same", "left").where("m is null or m <> n").select("same", F.lit(True).alias("differs")))
    if unlike.isEmpty():
        return likely.select("ip", "n", "same")
    doubtful = several.join(unlike, "same", "left_semi")
    rest = edges.join(doubtful.where("ip <> same"), "ip").select("ip", "n", "same", "cluster")
    shared = rest.join(edges.select(F.col("ip").alias("same"), "cluster"), ["same", "cluster"]).groupBy("ip", "n").agg(F.count("*").alias("common"))
    equal = shared.where("common = n").select("ip", F.lit(True).alias("equal"))
    found = likely.join(unlike, "same", "left").join(equal, "ip", "left")
    return found.select("ip", "n", F.when(F.col("differs") & F.col("equal").isNull(), F.col("ip")).otherwise(F.col("same")).alias("same"))


def _first_of_all(edges: DataFrame, total: DataFrame, threshold: float) -> DataFrame:
    """``(ip, lead)``: who leads for certain and whom these take. ``edges`` is ``(ip, cluster, n)``, with addresses as numbers in their order.

    An address that is the first of all that are left at each of its behaviours can't be taken.  A behaviour has at most
    one such, so comparing these with all who share a behaviour takes no more than a row for each edge. What edges meet here is written
    first: there are no more such rows than behaviours.
    """
    first = kept(edges.groupBy("cluster").agg(F.min("ip").alias("_first")))
    ready = edges.join(first, "cluster").groupBy("ip", "n").agg(F.bool_and(F.col("ip") == F.col("_first")).alias("ready"))
    lead = kept(ready.where("ready").select(F.col("ip").alias("lead"), F.col("n").alias("nl")))
    led = kept(edges.join(lead, F.col("ip") == F.col("lead")).select("cluster", "lead", "nl"))
    common = edges.join(led, "cluster").where("ip <> lead").groupBy("ip", "n", "lead", "nl").agg(F.count("*").alias("common"))
    scored = common.crossJoin(F.broadcast(total)).where(_score(F.col("common"), F.col("n"), F.col("nl"), F.col("total")) > threshold)
    taken = kept(scored.groupBy("ip").agg(F.min("lead").alias("lead")).union(lead.select("lead", "lead")))
    forget(first, lead, led)
    return taken


def groups(edges: DataFrame, threshold: float) -> DataFrame:
    """``(ip, leader)``, a written table, by greedy grouping in order of behaviours, most first (ties: the smaller address); loners lead themselves alone.

    Going down the order, an address that is still free takes all free addresses
    that score more than ``threshold`` (below 1) with it.  Addresses with equal sets score 1
    with each other and alike with all others, so one of each set stands for them all, and goes by its number in the order.

    First, those who lead for certain take theirs, round by round and without pairs, as long as a round places
    many: so a behaviour that very many addresses share is worked off by its leaders.  Of what is
    left, pairs are made; leaders are the first maximal independent set of the order, found in rounds (all
    that precede their free neighbours at once), and each other set belongs to its earliest leader.
    """
    given, edges = edges, _once(edges)  # read by each of the steps below
    like = kept(_like_sets(edges))
    own = kept(ranked(like.where("ip = same").select("ip", "n"), [F.desc("n"), F.col("ip")], "r"))
    left = kept(edges.select("ip", "cluster").join(own, "ip").select(F.col("r").alias("ip"), "cluster", "n"))
    if edges is not given:
        forget(edges)
    total = kept(_total(left))
    free, count, placed = own.select(F.col("r").alias("ip")), own.count(), []
    while count:
        taken = _first_of_all(left, total, threshold)
        placed.append(taken)
        before, left, free = left, kept(left.join(taken.select("ip"), "ip", "left_anti")), free.join(taken.select("ip"), "ip", "left_anti")
        forget(before)
        done, count = taken.count(), free.count()
        if done < WORTH_A_ROUND * (done + count):
            break
    if count:
        left._is_once = True
        placed.append(_by_pairs(left, kept(free), threshold))
    forget(left, total)
    named = own.select("ip", "r")
    if placed:
        leaders = placed[0].toDF("r", "lead")
        for more in placed[1:]:
            leaders = leaders.unionByName(more.toDF("r", "lead"))
        named = named.join(leaders, "r").select("ip", F.col("lead").alias("r"))
    named = named.toDF("same", "r").join(own.select("r", F.col("ip").alias("leader")), "r")
    out = kept(like.join(named, "same").select("ip", "leader"))
    forget(like, own, *placed)
    return out


def _by_pairs(edges: DataFrame, addresses: DataFrame, threshold: float) -> DataFrame:
    """``(ip, leader)`` of ``addresses``, those of the edges, with unlike sets and as numbers in their order, from all pairs that score more than the threshold."""
    pairs = kept(pair_scores(edges, threshold).select("a", "b"))  # a goes before b
    live, rounds = pairs, []
    while not live.isEmpty():
        # Who comes after no free neighbour leads and takes all free ones.
        later = kept(live.select(F.col("b").alias("a")).distinct())
        rounds.append(kept(live.join(later, "a", "left_anti").select("b").distinct()))
        gone = rounds[-1].select(F.col("b").alias("a"))
        before, live = live, kept(live.join(later, "a", "left_semi").join(gone, "a", "left_anti").join(rounds[-1], "b", "left_anti").select("a", "b"))
        forget(later)
        if before is not pairs:
            forget(before)
    forget(live)
    if not rounds:
        return addresses.select("ip", F.col("ip").alias("leader"))
    # Whoever isn't taken leads, also who lost all neighbours to others before its turn, and may precede the leaders that took these.
    leading = pairs.join(kept_together(rounds).select(F.col("b").alias("a")), "a", "left_anti")
    mine = leading.groupBy("b").agg(F.min("a").alias("leader")).withColumnRenamed("b", "ip")
    found = kept(addresses.select("ip").join(mine, "ip", "left").select("ip", F.coalesce("leader", "ip").alias("leader")))
    forget(pairs, *rounds)
    return found


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rows with their place, from 1, in a total ``order``: each range of the order is numbered in a task of its own."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row for each range
    numbered = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order))).join(F.broadcast(before), "_part")
    return numbered.withColumn(name, (F.col("_at") + F.col("_before")).cast("int")).drop("_part", "_at", "_before")


def knee_points(sizes: DataFrame, k: int = 100, part: tuple[str, ...] = ()) -> DataFrame:
    """``(*part, rank, size, change)``: where the slope of the cumulated size counts changes most.

    Sizes are ordered by how often they occur, rarest first (ties: the larger size
    first); the cumulated counts of a few thousand distinct sizes fit one task.
    """
    by = Window.partitionBy(*part).orderBy("f", F.desc("size"))
    freq = sizes.groupBy(*part, "size").agg(F.count("*").alias("f"))
    cum = freq.withColumn("cum", F.sum("f").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("f").over(Window.partitionBy(*part)))
    slope = (F.lead("cum").over(by) - F.col("cum")) / F.col("total") / (F.lead("size").over(by) - F.col("size"))
    sloped = cum.withColumn("slope", slope).withColumn("next_size", F.lead("size").over(by)).withColumn("change", F.abs(F.lead("slope").over(by) - F.col("slope")))
    ranked = sloped.where("change is not null").withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("change"), "next_size")))
    return ranked.where(F.col("rank") <= k).select(*part, "rank", F.col("next_size").alias("size"), "change")


def small_cluster_limit(clusters: DataFrame, part: tuple[str, ...] = ()) -> DataFrame:
    """``(*part, limit)``: up to how many members, the leader apart, a cluster counts as small.

    ``clusters`` is ``(*part, size)``, leaders included, with size 1 for each loner.  The limit is one less than
    the first knee below the lower quartile of the clusters' members without leaders; 0 if there is none.
    """
    quartile = clusters.groupBy(*part).agg(F.percentile(F.when(F.col("size") > 1, F.col("size") - 1), F.lit(0.25)).alias("q1"))
    knees = knee_points(clusters, part=part)
    both = quartile.join(knees, list(part), "left") if part else quartile.crossJoin(F.broadcast(knees))
    return both.groupBy(*part).agg(F.coalesce(F.min_by(F.col("size") - 1, F.when(F.col("size") < F.col("q1"), F.col("rank"))), F.lit(0)).cast("long").alias("limit"))
