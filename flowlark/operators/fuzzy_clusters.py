"""Sessions whose payloads look alike: clusters, their representatives and trees of them.

Payload rows are ``(part, idx, pos, hash)``: ``part`` is what is clustered apart (a day
and protocol), ``idx`` the session, ``pos`` gives the order of its payloads.  Rows without a hash take no part, and the
places of a session's payloads are counted without them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlark.functions.fuzzy import fuzzy_compare, grams, shortened
from flowlark.operators.behaviour import ranked
from flowlark.operators.scratch import forget, kept, kept_together


def _hashes(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(part, hash, l, r, x, id)``, a written table: distinct hashes of ``left`` and ``right``, on which side they are, shortened, and their numbers."""
    yes, no = F.lit(True), F.lit(False)
    rows = left.select("part", "hash", yes.alias("l"), no.alias("r")).unionByName(right.select("part", "hash", no.alias("l"), yes.alias("r")))
    once = rows.where("part is not null and hash is not null").groupBy("part", "hash").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return kept(once.withColumn("x", shortened(F.col("hash"))).withColumn("id", F.monotonically_increasing_id()))


def _scored(nodes: DataFrame) -> DataFrame:
    """``(part, a, b, i, j, score)`` of ``_hashes`` that score more than 0, from the left to the right, by name and by number; see ``alike``."""
    of = nodes.select("id", "l", "r", F.xxhash64("part").alias("p"), F.explode(grams(F.col("hash"))).alias("gram")).select("id", "l", "r", F.xxhash64("p", "gram").alias("gram"))
    gram = Window.partitionBy("gram")
    sums = [F.bit_xor(F.xxhash64("id", F.lit(seed))).over(gram).alias(f"s{seed}") for seed in (1, 2)]
    shared = of.select("id", "l", "r", F.count("*").over(gram).alias("n"), F.max("l").over(gram).alias("al"), F.max("r").over(gram).alias("ar"), *sums)
    common = kept(shared.where("n > 1 and al and ar").select("id", "l", "r", F.xxhash64("n", "s1", "s2").alias("gram")).distinct())
    met = common.toDF("i", "il", "ir", "gram").join(common.toDF("j", "jl", "jr", "gram").hint("merge"), "gram").where("i < j and (il and jr or ir and jl)").select("i", "j").distinct()
    one, other = (nodes.select(F.col("id").alias(i), F.col("part").alias(f"{i}p"), F.col("hash").alias(h), F.col("x").alias(f"{i}x"), F.col("l").alias(f"{i}l"), F.col("r").alias(f"{i}r")) for i, h in (("i", "a"), ("j", "b")))
    near = met.join(one, "i").join(other, "j").where("ip = jp and ix <> jx")
    near = near.select(F.col("ip").alias("part"), "a", "b", "i", "j", "il", "ir", "jl", "jr", fuzzy_compare("a", "b").alias("score"))
    back = F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("j").alias("i"), F.col("i").alias("j"))
    # Scores are filtered by what is made of them, as Spark would work out a filter of their own a second time.
    ways = F.array(F.when(F.expr("score > 0 and il and jr"), F.struct("a", "b", "i", "j")), F.when(F.expr("score > 0 and jl and ir"), back))
    near = near.select("part", F.explode(ways).alias("way"), "score").where("way is not null").select("part", "way.*", "score")
    l, r = (nodes.where(side).select("part", "x", F.col("hash").alias(h), F.col("id").alias(i)) for side, h, i in (("l", "a", "i"), ("r", "b", "j")))
    return near.unionByName(l.join(r, ["part", "x"]).select("part", "a", "b", "i", "j", F.lit(100).alias("score")))


def alike(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(part, a, b, score)`` of all distinct hashes that score more than 0; ``left`` and ``right`` are ``(part, hash)``.

    Only pairs with seven characters in common are scored, each once whichever side they are on.  Hashes that are equal once their long runs of
    one character are shortened score 100, whatever their length.
    Work is that of the pairs which share such characters; equal payloads count once, and so do sevens that the same hashes have.  Hashes and sevens go by
    numbers until they meet: should two sevens have one number, more pairs meet, which then score 0.  What a single hash has is dropped before the join, and
    what was shuffled for that is gone by then.  Spark takes exploded rows for as few as they come from, so that join says itself that nothing is broadcast.
    """
    return _scored(_hashes(left, right)).select("part", "a", "b", "score")


def numbered(payloads: DataFrame) -> DataFrame:
    """``(part, idx, pos, hash, n)``: payloads with a hash, counted anew from 0 in each session, and how many its session has."""
    session = Window.partitionBy("part", "idx")
    known = payloads.where("hash is not null").select("part", "idx", "pos", "hash")
    return known.withColumn("pos", (F.row_number().over(session.orderBy("pos", "hash")) - 1).cast("int")).withColumn("n", F.count("*").over(session))


def probes(payloads: DataFrame) -> DataFrame:
    """The payloads by which a session looks for others: those at a quarter, half, three quarters; from five on also the last.

    With few payloads places coincide and later ones are left out.
    """
    q = [F.floor(F.col("n") * x).cast("int") for x in (0.25, 0.5, 0.75)]
    places = F.when(q[1] == q[0], F.array(q[0])).when(q[2] == q[1], F.array(q[0], q[1])).when(F.col("n") > 4, F.array(*q, F.col("n").cast("int") - 1)).otherwise(F.array(*q))
    found = numbered(payloads).withColumn("places", places)
    return found.where(F.array_contains("places", F.col("pos"))).select("part", "idx", "pos", "hash", F.size("places").alias("probes"))


def links(payloads: DataFrame, threshold: float = 0.0, within: str | None = None) -> DataFrame:
    """``(part, a, b)``: session ``a`` finds ``b``, if the mean score of its probes with any payload of ``b`` is above the threshold (0 or more).

    All links are rows here; ``leader_clusters`` does without them.  With ``within``, a further column of ``payloads``, only
    sessions of one value of it find each other, and no others meet.
    """
    payloads = payloads.where("hash is not null")
    targets = probes(payloads)
    if within:
        # The value is a further part: sessions of others don't even meet.
        payloads = payloads.where(F.col("part").isNotNull() & F.col(within).isNotNull())
        targets = targets.join(payloads.select("part", "idx", within).distinct(), ["part", "idx"]).withColumn("part", F.struct("part", within))
        payloads = payloads.withColumn("part", F.struct("part", within))
    nodes = _hashes(targets.select("part", "hash"), payloads.select("part", "hash"))
    scored = kept(_scored(nodes).select("i", "j", "score"))
    # Pairs, of which there may be many, are rows of numbers from here on.
    parts = kept(nodes.select("part").distinct().withColumn("pid", F.monotonically_increasing_id()))
    known = kept(nodes.join(parts, "part").select("part", "hash", "id", "pid"))
    found = targets.join(known, ["part", "hash"]).select("pid", F.col("idx").alias("a"), "probes", F.col("id").alias("i")).join(scored, "i")
    if threshold > 0:  # else any score is above it
        found = found.groupBy("pid", "a", "j", "probes").agg((F.sum("score") / F.col("probes")).alias("mean")).where(F.col("mean") > threshold)
    owners = payloads.select("part", "hash", "idx").distinct().join(known, ["part", "hash"]).select(F.col("id").alias("j"), F.col("idx").alias("b"))
    found = found.join(owners, "j").where("a <> b").select("pid", "a", "b").distinct().join(parts, "pid").select("part", "a", "b")
    return found.select("part.part", "a", "b", f"part.{within}") if within else found


#: Links are rows if they are at most so many times the rows of the graph that stands for them otherwise; so many of them, once counted, are
#: followed in one task, one session after the other, which saves what is left of a long chain its rounds.
FEW_LINKS, ONE_TASK = 4, 100_000


class _Graph:
    """Sessions, payloads and what payloads have in common, as nodes; links between sessions are paths, never rows.

    ``steps`` are tables of edges ``(a, b)`` that lead from a session by its probes to payloads ``node``; ``owns`` are the payloads of each
    session.  A value travels along them from sessions to those they find, or back; at each node the least goes on.
    """

    def __init__(self, steps: list[DataFrame], owns: DataFrame):
        self.steps, self.owns = steps, owns

    def found(self, values: DataFrame) -> DataFrame:
        """``(part, idx, v)``: of ``values(a, v)`` at sessions, the least that comes to each session that is found."""
        for step in self.steps:
            values = step.join(values, "a").groupBy(F.col("b").alias("a")).agg(F.min("v").alias("v"))
        return self.owns.join(values.withColumnRenamed("a", "node"), "node").groupBy("part", "idx").agg(F.min("v").alias("v"))

    def back(self, values: DataFrame) -> DataFrame:
        """``(a, v)``: of ``values(part, idx, v)`` the least at any session that each session finds."""
        back = self.owns.join(values, ["part", "idx"]).groupBy(F.col("node").alias("b")).agg(F.min("v").alias("v"))
        for step in reversed(self.steps):
            back = step.join(back, "b").groupBy(F.col("a").alias("b")).agg(F.min("v").alias("v"))
        return back.withColumnRenamed("b", "a")

    def only(self, live: DataFrame) -> _Graph:
        """The graph of sessions ``live(part, idx, asks)`` alone; what it replaces is forgotten."""
        first = kept(self.steps[0].join(live.where("asks").select(F.struct("part", "idx").alias("a")), "a", "left_semi"))
        owns = kept(self.owns.join(live, ["part", "idx"], "left_semi"))
        forget(self.steps[0], self.owns)
        return _Graph([first, *self.steps[1:]], owns)

    def forget(self) -> None:
        forget(*self.steps, self.owns)

    def shortest(self) -> _Graph | _Links:
        """The links as rows where these are known to be no more than FEW_LINKS times the graph's own rows, else the graph."""
        ways = self.steps[0].groupBy("b").agg(F.count("*").cast("decimal(38,0)").alias("v"))
        for step in self.steps[1:]:
            ways = step.join(ways.withColumnRenamed("b", "a"), "a").groupBy("b").agg(F.sum("v").alias("v"))
        owners = self.owns.groupBy(F.col("node").alias("b")).agg(F.count("*").cast("decimal(38,0)").alias("n"))
        many = ways.join(owners, "b").agg(F.coalesce(F.sum(F.least(F.col("v"), F.lit(10**18)) * F.least(F.col("n"), F.lit(10**18))), F.lit(0))).first()[0]
        if many > FEW_LINKS * (self.owns.count() + sum(step.count() for step in self.steps)):
            return self
        links = self.steps[0].select(F.col("a").alias("from"), "b")
        for step in self.steps[1:]:
            links = links.withColumnRenamed("b", "a").join(step, "a").select("from", "b").distinct()
        links = kept(links.withColumnRenamed("b", "node").join(self.owns, "node").select(F.col("from").alias("a"), "part", "idx").distinct())
        self.forget()
        return _Links(links)


class _Links:
    """The same as a ``_Graph``, where links ``(a, part, idx)`` are few enough to be rows."""

    def __init__(self, links: DataFrame):
        self.links = links

    def found(self, values: DataFrame) -> DataFrame:
        return self.links.join(values, "a").groupBy("part", "idx").agg(F.min("v").alias("v"))

    def back(self, values: DataFrame) -> DataFrame:
        return self.links.join(values, ["part", "idx"]).groupBy("a").agg(F.min("v").alias("v"))

    def only(self, live: DataFrame) -> _Links:
        left = self.links.join(live.where("asks").select(F.struct("part", "idx").alias("a")), "a", "left_semi").join(live, ["part", "idx"], "left_semi")
        left = kept(left.select("a", "part", "idx"))
        self.forget()
        return _Links(left)

    def forget(self) -> None:
        forget(self.links)


def _followed(links: DataFrame) -> DataFrame:
    """``(part, idx, asks, leader)`` of all who lead or are taken along links ``(a, part, idx)`` that fit one task."""
    rows = links.select("part", F.col("a.idx").alias("from"), "idx")
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([T.StructField("part", kinds["part"]), T.StructField("idx", kinds["idx"]), T.StructField("leader", kinds["idx"])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        part, start, end = ([str(x) for x in table["part"].to_pylist()], table["from"].to_pylist(), table["idx"].to_pylist())
        taken, out = set(), []
        for (of, leader), ways in groupby(sorted(range(len(part)), key=lambda i: (part[i], start[i], end[i])), key=lambda i: (part[i], start[i])):
            free = [i for i in ways if end[i] != leader and (of, end[i]) not in taken]
            if free and (of, leader) not in taken:
                out += [(free[0], leader, leader), *((i, end[i], leader) for i in free)]
                taken |= {(of, leader), *((of, end[i]) for i in free)}
        at, idx, leader = zip(*out, strict=True) if out else ((), (), ())
        kind = table["idx"].type
        columns = [table["part"].combine_chunks().take(pa.array(at, pa.int64())), pa.array(idx, kind), pa.array(leader, kind)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "idx", "leader"])

    return rows.coalesce(1).mapInArrow(run, schema).select("part", "idx", F.lit(False).alias("asks"), "leader")


def _sum_of(*columns: str) -> list:
    """A count and two sums of 64-bit hashes: what sets of the same rows share and others don't."""
    return [F.count("*").alias("_n"), *(F.sum(F.xxhash64(*columns, F.lit(seed)).cast("decimal(38,0)")).alias(f"_s{seed}") for seed in (1, 2))]


_SUMS = ["_n", "_s1", "_s2"]


def _common_grams(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(a, b)``: for each of ``nodes(part, node, hash)`` what it has in common with others that it scores with; and a table to forget.

    Two hashes score more than 0 exactly if they are equal once shortened or share seven characters at one block size.  Runs of
    characters that the same hashes share are one node, and those of a single hash none.
    """
    of = kept(nodes.select("part", "node", F.explode(grams(F.col("hash"))).alias("gram")))
    classes = of.groupBy("part", "gram").agg(*_sum_of("node")).where("_n > 1")
    first = classes.groupBy("part", *_SUMS).agg(F.min("gram").alias("gram"))
    several = of.join(first.select("part", "gram"), ["part", "gram"]).select(F.col("node").alias("a"), F.struct("part", "gram").alias("b"))
    equal = nodes.select(F.col("node").alias("a"), F.struct("part", F.concat(F.lit("="), shortened(F.col("hash"))).alias("gram")).alias("b"))
    return several.unionByName(equal), of


def _graph(payloads: DataFrame, threshold: float) -> tuple[_Graph, DataFrame]:
    """The graph of sessions, and ``(part, idx, as_idx)``: the session that stands for each of those with the same payloads.

    Sessions with the same payloads and probes differ only in who comes first: the two with the smallest idx of each are in
    the graph, the others fare as the second.
    """
    rows = kept(numbered(payloads).select("part", "idx", "pos", "hash"))
    asked = probes(rows)
    sums = rows.groupBy("part", "idx").agg(*_sum_of("pos", "hash"))
    place = F.row_number().over(Window.partitionBy("part", *_SUMS).orderBy("idx"))
    two = kept(sums.withColumn("place", place).where("place <= 2"))
    second = two.where("place = 2").select("part", *_SUMS, F.col("idx").alias("as_idx"))
    stands = kept(sums.join(second, ["part", *_SUMS], "left").select("part", "idx", F.when(F.col("idx") > F.col("as_idx"), F.col("as_idx")).otherwise(F.col("idx")).alias("as_idx")))
    rows_of_two, asked = (x.join(two.select("part", "idx"), ["part", "idx"], "left_semi") for x in (rows, asked))
    nodes = kept(rows_of_two.select("part", "hash").distinct().withColumn("node", F.monotonically_increasing_id()))
    owns = kept(rows_of_two.select("part", "idx", "hash").distinct().join(nodes, ["part", "hash"]).select("part", "idx", "node"))
    if threshold <= 0:
        asks = kept(asked.select("part", "idx", "hash").distinct().join(nodes, ["part", "hash"]).select(F.struct("part", "idx").alias("a"), F.col("node").alias("b")))
        common, of = _common_grams(nodes)
        common = kept(common)
        forget(of)
        steps = [asks, common, common.select(F.col("b").alias("a"), F.col("a").alias("b"))]
    else:
        # Sessions with the same probes find the same payloads: each such profile, named after its first session, is a node.
        profiles = asked.groupBy("part", "idx", "probes").agg(*_sum_of("pos", "hash")).withColumn("first", F.min("idx").over(Window.partitionBy("part", "probes", *_SUMS)))
        asks = kept(profiles.select(F.struct("part", "idx").alias("a"), F.struct("part", F.col("first").alias("idx")).alias("b")))
        ask = asked.join(profiles.where("idx = first").select("part", "idx"), ["part", "idx"], "left_semi").withColumnRenamed("hash", "a")
        scored = alike(ask.select("part", F.col("a").alias("hash")), nodes.select("part", "hash"))
        means = ask.join(scored, ["part", "a"]).groupBy("part", "idx", "b", "probes").agg((F.sum("score") / F.col("probes")).alias("mean")).where(F.col("mean") > threshold)
        finds = kept(means.withColumnRenamed("b", "hash").join(nodes, ["part", "hash"]).select(F.struct("part", "idx").alias("a"), F.col("node").alias("b")))
        steps = [asks, finds]
    forget(rows, two, nodes)
    return _Graph(steps, owns), stands


#: Sessions take their turns in one task for each part while they have at most about so many rows; where turns end is found among so many ranges.
CHUNK_ROWS, RANGES = 1 << 20, 4096


def _turns(table: pa.Table) -> pa.Table:
    """``(pid, s, leads)``: who leads of a part's sessions whose turn it is, and the last session decided (``leads`` false) where that isn't all.

    ``table`` is ``(pid, s, hub, kind, n)``: hubs of these sessions (kind 0, those by which they ask 1), of some sessions outside (2), and
    how many sessions outside a hub has (3).  A leader takes all that have a hub by which it asks, so a hub is worked off once.  Whether anyone
    is free behind a hub can be open only if all known sessions outside were taken before and there are more: there the turns end.
    """
    s, hub, kind, n = (table[c].to_numpy() for c in ("s", "hub", "kind", "n"))
    hubs, h = np.unique(hub, return_inverse=True)
    real = kind < 3
    ids, x = np.unique(s[real], return_inverse=True)
    outside = np.zeros(len(hubs), np.int64)
    outside[h[~real]] = n[~real]
    more = (outside > np.bincount(h[kind == 2], minlength=len(hubs))).tolist()
    of = h[real]
    owners = x[np.argsort(of, kind="stable")].tolist()
    size = np.bincount(of, minlength=len(hubs))
    end = np.cumsum(size)
    begin, end = (end - size).tolist(), end.tolist()
    asks = kind[real] == 1
    by = np.argsort(x[asks], kind="stable")
    asking, at = np.unique(x[asks][by], return_index=True)
    asked = np.split(of[asks][by], at[1:])
    taken, leaders, last = bytearray(len(ids)), [], None

    def another(hub: int, a: int) -> bool:
        """Whether the hub has a free session but ``a``; those taken leave its list."""
        low, top = begin[hub], end[hub]
        while top > low and taken[owners[top - 1]]:
            top -= 1
        found = top > low
        if found and owners[top - 1] == a:
            k = top - 1
            while k > low and taken[owners[k - 1]]:
                k -= 1
            owners[k], top, found = a, k + 1, k > low
        end[hub] = top
        return found

    for a, ways in zip(asking.tolist(), asked, strict=True):
        if taken[a]:
            continue
        ways = ways.tolist()
        if any(another(way, a) for way in ways):
            leaders.append(a)
            for way in ways:
                for i in range(begin[way], end[way]):
                    taken[owners[i]] = 1
                end[way] = begin[way]
        elif any(more[way] for way in ways):
            last = int(ids[a]) - 1
            break
    out = ids[leaders].tolist() if leaders else []
    found = [(i, True) for i in out] + ([(last, False)] if last is not None else [])
    return pa.table({"pid": pa.array([table["pid"][0].as_py()] * len(found), pa.int64()), "s": pa.array([i for i, _ in found], pa.int64()), "leads": pa.array([x for _, x in found], pa.bool_())})


def _hub_rows(graph: _Graph, sessions: DataFrame) -> DataFrame:
    """``(pid, s, hub, asks, due)``: what each session's payloads have in common with others, as numbers, and whether it asks by it."""
    asks, common = graph.steps[:2]
    hubs = kept(common.select("b").distinct().withColumn("hub", F.monotonically_increasing_id()))
    of = common.join(hubs, "b").select(F.col("a").alias("node"), "hub")
    asked = asks.select("a.part", "a.idx", F.col("b").alias("node"), F.lit(True).alias("asks"))
    mine = graph.owns.join(asked, ["part", "idx", "node"], "left").join(sessions, ["part", "idx"]).select("pid", "s", "node", F.coalesce("asks", F.lit(False)).alias("asks"))
    rows = kept(mine.join(of, "node").groupBy("pid", "s", "hub").agg(F.max("asks").alias("asks")).withColumn("due", F.lit(True)))
    forget(hubs)
    return rows


def _asked_for(rows: DataFrame) -> DataFrame:
    """Rows of hubs that several sessions have and by which one is still to ask."""
    useful = rows.groupBy("hub").agg(F.count("*").alias("n"), F.max("asks").alias("asked")).where("n > 1 and asked")
    return rows.join(useful.select("hub"), "hub", "left_semi").select("pid", "s", "hub", "asks", "due")


def _in_order(graph: _Graph, stands: DataFrame) -> DataFrame:
    """``leader_clusters`` at threshold 0: sessions take their turns by the numbers of their order, very many at once.

    Of each part those that come next, as far as CHUNK_ROWS go, are decided in one task, which knows of others what it needs: how many have a hub
    and up to four of them. Then leaders take theirs with a join, and what is left goes on without hubs that nobody asks by.
    Rounds are as many as such tasks, however long chains of sessions that depend on each other are.
    """
    sessions = kept(ranked(stands.where("idx = as_idx").select("part", "idx"), [F.col("part"), F.col("idx")], "s").select("part", "idx", F.col("s").cast("long").alias("s"), F.xxhash64("part").alias("pid")))
    every = _hub_rows(graph, sessions)
    graph.forget()
    rows = kept(_asked_for(every))
    forget(every)
    width = max(1, -(-sessions.count() // RANGES))
    place = F.floor(F.col("s") / width)
    rounds = []
    while not rows.isEmpty():
        # As many rows as parts and ranges.
        ranges = rows.where("due").groupBy("pid", place.alias("r")).agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("pid").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cuts = kept(ranges.withColumn("before", before).where(F.col("before") < CHUNK_ROWS).groupBy("pid").agg(((F.max("r") + 1) * width - 1).alias("cut")))
        now = rows.join(F.broadcast(cuts), "pid", "left").withColumn("inside", F.col("due") & (F.col("s") <= F.coalesce("cut", F.lit(-1)))).drop("cut")
        near = kept(now.join(now.where("inside and asks").select("hub").distinct(), "hub", "left_semi"))
        some = [f(F.struct(F.xxhash64("s", F.lit(seed)), "s"))["s"] for seed in (1, 2) for f in (F.min, F.max)]
        beyond = kept(near.where("not inside").groupBy("pid", "hub").agg(F.count("*").alias("n"), F.array(*some).alias("some")))
        known = beyond.select(F.explode("some").alias("s")).distinct()
        no, one = F.lit(0).cast("long"), lambda k: F.lit(k).cast("int").alias("kind")
        told = near.where("inside").select("pid", "s", "hub", F.col("asks").cast("int").alias("kind"), no.alias("n"))
        told = told.unionByName(near.where("not inside").join(known, "s", "left_semi").select("pid", "s", "hub", one(2), no.alias("n")))
        told = told.unionByName(beyond.select("pid", no.alias("s"), "hub", one(3), "n"))
        turns = kept(told.groupBy("pid").applyInArrow(_turns, "pid long, s long, leads boolean"))
        led = rows.where("asks").join(turns.where("leads").select("s"), "s", "left_semi").groupBy("hub").agg(F.min("s").alias("lead"))
        rounds.append(kept(rows.join(led, "hub").groupBy("s").agg(F.min("lead").alias("lead"))))
        last = cuts.join(turns.where("not leads").select("pid", "s"), "pid", "left").select("pid", F.coalesce("s", "cut").alias("last"))
        left = rows.join(rounds[-1], "s", "left_anti").join(F.broadcast(last), "pid", "left").withColumn("due", F.col("due") & (F.col("s") > F.coalesce("last", F.lit(-1))))
        old, rows = rows, kept(_asked_for(left.withColumn("asks", F.col("asks") & F.col("due"))))
        forget(old, cuts, near, beyond, turns)
    forget(rows)
    if not rounds:
        return stands.select("part", "idx", F.lit(None).cast(stands.schema["idx"].dataType).alias("leader"))
    found = kept_together(rounds).join(sessions.select("part", F.col("idx").alias("as_idx"), "s"), "s")
    clusters = found.join(sessions.select(F.col("s").alias("lead"), F.col("idx").alias("leader")), "lead").select("part", "as_idx", "leader")
    return stands.join(clusters, ["part", "as_idx"], "left").select("part", "idx", "leader")


def leader_clusters(payloads: DataFrame, threshold: float = 0.0) -> DataFrame:
    """``(part, idx, leader)``: in order of idx, a free session takes all free sessions that it finds; ``leader`` is null for loners.

    Finding isn't symmetric, so a session that found none may still be taken later.  Rows are those of payloads and of what distinct payloads
    have in common, however many sessions find each other (or the links themselves, where counting shows that they are few); no
    part is ever held in one task.  At threshold 0 sessions take their turns many at once (``_in_order``).

    Else a session's turn has come as soon as no earlier one that is still to come can touch it or any session that it finds.  Each
    session is told the first that may touch it, each asks back for the least of these among those it finds: all whose own idx comes
    back take theirs at once, round by round.
    """
    graph, stands = _graph(payloads, threshold)
    if threshold <= 0:
        return _in_order(graph, stands)
    graph = graph.shortest()
    live = stands.where("idx = as_idx").select("part", "idx", F.lit(True).alias("asks"))
    rounds, size = [], None
    while True:
        now, asking = live.agg(F.count("*"), F.coalesce(F.max("asks"), F.lit(False))).first()
        if not asking:
            break
        if size is None or now * 4 < size:
            graph = graph.only(live) if size else graph
            graph = graph.shortest() if size and isinstance(graph, _Graph) else graph
            size = now
            if isinstance(graph, _Links) and graph.links.count() <= ONE_TASK:
                rounds.append(kept(_followed(graph.links)))
                break
        touched = graph.found(live.where("asks").select(F.struct("part", "idx").alias("a"), F.col("idx").alias("v")))
        first = live.join(touched, ["part", "idx"], "left").select("part", "idx", "asks", F.least("v", F.when(F.col("asks"), F.col("idx"))).alias("v"))
        first = kept(first.where("v is not null"))  # whoever nobody can touch any more stays alone
        answers = graph.back(first.select("part", "idx", "v")).select("a.part", "a.idx", F.col("v").alias("least"))
        turn = first.where("asks and v = idx").join(answers, ["part", "idx"], "left").where("least is null or least >= idx").select("part", F.col("idx").alias("v"), F.lit(True).alias("turn"))
        told = first.join(turn, ["part", "v"], "left").withColumn("leader", F.when(F.col("turn") & (F.col("v") != F.col("idx")), F.col("v")))
        heads = told.where("leader is not null").select("part", F.col("leader").alias("idx"), F.col("leader").alias("own")).distinct()
        told = told.join(heads, ["part", "idx"], "left")
        asks = F.col("asks") & ~(F.coalesce("turn", F.lit(False)) & (F.col("v") == F.col("idx")))
        rounds.append(kept(told.select("part", "idx", asks.alias("asks"), F.coalesce("leader", "own").alias("leader"))))
        forget(first)
        live = rounds[-1].where("leader is null").select("part", "idx", "asks")
    graph.forget()
    if not rounds:
        return stands.select("part", "idx", F.lit(None).cast(stands.schema["idx"].dataType).alias("leader"))
    clusters = kept_together(rounds).where("leader is not null").select("part", F.col("idx").alias("as_idx"), "leader")
    return stands.join(clusters, ["part", "as_idx"], "left").select("part", "idx", "leader")


def same_address_links(payloads: DataFrame, sessions: DataFrame, threshold: float = 0.0) -> DataFrame:
    """``links`` between sessions of one source address; ``sessions`` is ``(part, idx, ip_src)``. Sessions of other addresses never meet."""
    of = kept(payloads.join(sessions.where("ip_src is not null").select("part", "idx", "ip_src"), ["part", "idx"]))
    return links(of, threshold, "ip_src")


def middle_hash(payloads: DataFrame) -> DataFrame:
    """``(part, idx, hash)``: the payload at half of each session."""
    return numbered(payloads).where(F.col("pos") == F.floor(F.col("n") * 0.5)).select("part", "idx", "hash")


def representatives(clusters: DataFrame, payloads: DataFrame, sessions: DataFrame, small: DataFrame) -> DataFrame:
    """``(part, idx, kind, name, hash)`` of leaders and loners.

    ``kind`` is empty for clusters with more members (the leader apart) than ``limit`` of
    ``small`` (``part, limit``; 0 where it has no row), S for smaller ones, L for loners.  Names are
    ``proto[_S|_L]_idx_date_country_domain_ip``, with None for nulls.
    """
    members = clusters.where("leader is not null").groupBy("part", "leader").agg((F.count("*") - 1).alias("members")).withColumnRenamed("leader", "idx")
    heads = members.unionByName(clusters.where("leader is null").select("part", "idx", F.lit(None).cast("long").alias("members")))
    known = heads.join(small.select("part", "limit"), "part", "left").withColumn("kind", F.when(F.col("members").isNull(), "L").when(F.col("members") > F.coalesce("limit", F.lit(0)), "").otherwise("S"))
    tag = F.when(F.col("kind") != "", F.col("kind"))
    words = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("idx", "date", "country", "domain", "ip_src")]
    named = known.join(sessions, ["part", "idx"]).withColumn("name", F.concat_ws("_", F.coalesce("proto", F.lit("None")), tag, *words))
    return named.join(middle_hash(payloads), ["part", "idx"]).select("part", "idx", "kind", "name", "hash")


def average_linkage(hashes: DataFrame) -> DataFrame:
    """``(part, round, a, b, distance, size)``: the average-linkage tree of ``(part, idx, hash)`` as far as anything scores.

    The distance is 100 less the mean score over all pairs, unlike pairs included; clusters are called by their smallest
    idx.  Equal hashes are 0 apart and merge first, in round 0, one row for each, without meeting in pairs; from then on a
    hash stands for all that have it.  Pairs that are nearest to each other merge at once, which for average
    linkage gives the tree of one merge after the other.  All that is left
    at the end is 100 apart.
    """
    equal = Window.partitionBy("part", "hash").orderBy("idx")
    numbered_ = hashes.where("hash is not null").select("part", "idx", "hash").withColumn("size", F.row_number().over(equal).cast("long")).withColumn("a", F.first("idx").over(equal))
    same = kept(numbered_)
    steps = [same.where("size > 1").select("part", F.lit(0).alias("round"), "a", F.col("idx").alias("b"), F.lit(0.0).alias("distance"), "size")]
    heads = kept(same.groupBy("part", "hash").agg(F.min("idx").alias("x"), F.count("*").alias("n")))
    scored = alike(heads.select("part", "hash"), heads.select("part", "hash"))
    l, r = (heads.select("part", F.col("x").alias(x), F.col("hash").alias(h), F.col("n").alias(n)) for x, h, n in (("x", "a", "n"), ("y", "b", "m")))
    sums = kept(scored.join(l, ["part", "a"]).join(r, ["part", "b"]).where("x <> y").select("part", "x", "y", (F.col("score") * F.col("n") * F.col("m")).cast("long").alias("s")))
    sizes = heads.select("part", "x", "n")
    turn, merges = 0, []
    while not sums.isEmpty():
        turn += 1
        both = sums.join(sizes, ["part", "x"]).join(sizes.select("part", F.col("x").alias("y"), F.col("n").alias("m")), ["part", "y"])
        order = F.struct(-F.col("s") / (F.col("n") * F.col("m")), F.least("x", "y"), F.greatest("x", "y"))
        best = both.withColumn("o", order).groupBy("part", "x").agg(F.min_by(F.struct("y", "s", "n", "m"), "o").alias("best")).select("part", "x", "best.*")
        back = best.select("part", F.col("x").alias("y"), F.col("y").alias("x"))
        merged = kept(best.join(back, ["part", "x", "y"], "left_semi").where("x < y").withColumn("round", F.lit(turn)))
        merges.append(merged)
        moved = merged.select("part", F.col("y").alias("old"), F.col("x").alias("new"))
        old = sums
        for side in ("x", "y"):
            sums = sums.join(moved.withColumnRenamed("old", side), ["part", side], "left").withColumn(side, F.coalesce("new", side)).drop("new")
        sums = kept(sums.where("x <> y").groupBy("part", "x", "y").agg(F.sum("s").alias("s")))
        old_sizes, sizes = sizes, kept(sizes.join(moved.withColumnRenamed("old", "x"), ["part", "x"], "left").select("part", F.coalesce("new", "x").alias("x"), "n").groupBy("part", "x").agg(F.sum("n").alias("n")))
        forget(old, old_sizes)
    forget(heads, sums, sizes)
    if merges:
        size = F.col("n") * F.col("m")
        steps.append(kept_together(merges).select("part", "round", F.col("x").alias("a"), F.col("y").alias("b"), (100 - F.col("s") / size).alias("distance"), (F.col("n") + F.col("m")).alias("size")))
    return steps[0] if len(steps) == 1 else steps[0].unionByName(steps[1])
