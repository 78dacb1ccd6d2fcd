"""Groups with many equal sets, their figures, and stored sessions, against plain Python."""

import math
import os
import random
import time

from pyspark.sql import functions as F

from flowlark.operators import behaviour as B
from flowlark.operators import groups as G
from flowlark.operators.scratch import kept
from flowlark.sources import stores
from flowlark.sources.packets import from_events
from flowlark.streaming.sessions import session_windows


def greedy(edges, threshold):
    sets = {}
    for ip, c in edges:
        sets.setdefault(ip, set()).add(c)
    total, out = len({c for _, c in edges}), {}

    def score(a, b):
        i, p = len(a & b), max(len(a), len(b)) / total
        return p * (i / math.sqrt(len(a) * len(b))) + (1 - p) * (i / len(a | b))

    for ip in sorted(sets, key=lambda x: (-len(sets[x]), x)):
        if ip not in out:
            taken = [x for x in sets if x not in out and x != ip and score(sets[ip], sets[x]) > threshold]
            out |= dict.fromkeys([ip, *taken], ip)
    return out


def test_groups_with_copies(spark):
    rng = random.Random(3)
    kinds = [rng.sample(range(12), rng.randint(1, 6)) for _ in range(25)]
    edges = [(ip, c) for ip in range(90) for c in (kinds[0] if ip % 3 == 0 else kinds[ip % 25])]
    df = spark.createDataFrame(edges + edges[:20], "ip long, cluster long")
    for threshold in (0.2, 0.5, 0.9):
        assert {r.ip: r.leader for r in B.groups(df, threshold).collect()} == greedy(edges, threshold)
    assert B.groups(df.limit(0), 0.5).count() == 0


def test_leader_whose_neighbours_all_went_first(spark, monkeypatch):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 5), (4, 5)], "a long, b long")
    monkeypatch.setattr(B, "pair_scores", lambda edges, threshold: pairs)
    edges = spark.createDataFrame([(i, i) for i in range(1, 6)], "ip long, cluster long")
    ranked = edges.select("ip", F.struct(F.lit(-1).alias("n"), "ip").alias("_r"))
    assert {r.ip: r.leader for r in B._by_pairs(edges, ranked, 0.5).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 3}


def test_group_figures(spark):
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "ip long, leader long")
    rows = [(1, "x", "p", "A", 10), (1, "y", "p", None, 5), (2, "x", "p", "A", 7), (3, "x", "q", "B", 1), (2, "z", "q", "A", 1), (None, "x", "q", "A", 1)]
    sessions = spark.createDataFrame(rows, "ip long, cluster string, proto string, country string, time long")
    edges = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "x"), (3, "x")], "ip long, cluster string")
    assert [r.ip for r in G.loners(groups).collect()] == [3]
    rolled = G.rollup(G.sessions_of(sessions, edges, G.grouped(groups)))
    assert [tuple(r) for r in rolled.collect()] == [(1, 3, 2, 2, 1, 1, 5, 10)]
    assert sorted(tuple(r) for r in G.size_histograms(rolled).collect()) == [("clusters", 2, 1), ("ips", 2, 1)]
    known = spark.createDataFrame([("b", ["x"]), ("a", ["x", "y"])], "intention string, clusters array<string>")
    assert sorted((r.cluster, r.intention) for r in G.with_intention(sessions, known).collect()) == [("x", "a")] * 4 + [("y", "a"), ("z", "probing")]
    assert {r.cluster: r.ips for r in G.with_total(edges).collect()} == {"x": 3, "y": 1, "stat": 4}
    assert sorted((r.cluster, r.time) for r in G.latest(sessions.where("ip = 1"), ["ip"], ["time"]).collect()) == [("x", 10)]
    hours = G.hours_of_largest(sessions, 2, 2).collect()
    assert sorted(tuple(r) for r in hours) == [(2, "y", -1, 0), (2, "y", 0, 1)]
    assert G.hours_of_largest(sessions.limit(0)).count() == 0


def test_names_and_days(spark):
    df = spark.createDataFrame([("1",), ("12",), ("0203",), (None,)], "d string")
    assert [r[0] for r in df.select(G.month_day(F.col("d"))).collect()] == ["0101", "0112", "0203", None]
    assert [r[0] for r in df.select(G.alias(F.col("d"), {"1": "one"})).collect()] == ["one", "12", "0203", None]


def test_stored_sessions(spark, tmp_path):
    df = spark.createDataFrame([("i1", "0106", 1), ("i1", "0107", 2), ("i2", "0106", 3), (None, "0106", 4)], "isp string, date string, x int")
    stores.write_sessions(df, f"{tmp_path}/s")
    assert [r.x for r in stores.read_sessions(spark, f"{tmp_path}/s", isp=["i1"], date=["0106"]).collect()] == [1]
    assert stores.read_sessions(spark, f"{tmp_path}/s").count() == 4


def test_capture_listing(spark, tmp_path):
    for name in ("a/snort.log.1578268800", "a/snort.log.1578268900", "snort.log.12", "snort_log.1578268800", "other"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"abc")
    assert sorted((r.bytes, r.start) for r in stores.capture_listing(spark, str(tmp_path)).collect()) == [(3, 1578268800.0), (3, 1578268900.0)]


def test_stream_gives_the_same_sessions(spark, tmp_path):
    table = from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    table.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = session_windows(stream, "6 hours").writeStream.format("memory").queryName("streamed").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start()
    run.awaitTermination()
    assert sorted(map(str, spark.table("streamed").collect())) == sorted(map(str, session_windows(table, "6 hours").collect()))


def test_dense_sets_are_scored_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(f"ip{i}", c) for i in range(150) for c in rng.sample(range(70), rng.randint(1, 40))]
    df = spark.createDataFrame(edges + edges[:9], "ip string, cluster long")
    monkeypatch.setattr(B, "BLOCK", 40)
    monkeypatch.setattr(B, "STRIP", 16)
    for threshold in (0.0, 0.3, 0.5):
        monkeypatch.setattr(B, "FEW_BEHAVIOURS", 1024)
        found = B.pair_scores(df, threshold)
        # Pairs leave as they are scored: nothing is shuffled after that.
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
        assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(B, "FEW_BEHAVIOURS", 0)
        wanted = {tuple(r) for r in B.pair_scores(df, threshold).collect()}
        rows = [tuple(r) for r in found.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == wanted and wanted


def test_retained_edges_are_worked_out_once(spark):
    """What several steps of a group query read is a written table, not the events again for each."""
    from flowlark.plans import group_queries as Q

    edges, _ = Q._all(spark, "/root/testdata/sf0.001")
    assert edges.inputFiles() and not any("events.parquet" in f for f in edges.inputFiles())


def test_sets_whose_hashes_meet_are_compared(spark, monkeypatch):
    rng = random.Random(8)
    kinds = [rng.sample(range(9), 3) for _ in range(12)]
    edges = [(ip, c) for ip in range(40) for c in kinds[ip % 12]]
    monkeypatch.setattr(B.F, "xxhash64", lambda *columns: F.lit(7).cast("long"))
    df = spark.createDataFrame(edges, "ip long, cluster long")
    same = {r.ip: r.same for r in B._like_sets(B._once(df)).collect()}
    sets = {ip: frozenset(kinds[ip % 12]) for ip in range(40)}
    assert all(sets[ip] == sets[to] for ip, to in same.items()) and {ip for ip, to in same.items() if sets[ip] == sets[0]} == {ip for ip, to in same.items() if to == 0}
    assert {r.ip: r.leader for r in B.groups(df, 0.4).collect()} == greedy(edges, 0.4)


def test_rows_of_an_address_stand_together(spark):
    """So counts by address shuffle a row for each, not all edges; few keys are broadcast to what they keep."""
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, *"abcdefghijkl", f"own{i}"]), i) for i in range(900)]
    sessions = spark.createDataFrame(rows, "ip long, cluster string, time long").repartition(5)
    edges = B.prune(sessions)
    places = edges.withColumn("f", F.input_file_name()).groupBy("ip").agg(F.countDistinct("f").alias("n"), F.min("f").alias("f")).collect()
    assert len(places) > 40 and all(r.n == 1 and r.f for r in places)
    found = G.retained(sessions, edges)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    groups = B.groups(edges, 0.3)
    wanted = sorted(map(tuple, G.sessions_of(sessions, edges, groups).select("ip", "cluster", "time", "leader").collect()))
    assert sorted(map(tuple, found.join(groups, "ip").select("ip", "cluster", "time", "leader").collect())) == wanted and wanted


def test_written_tables_leave_nothing_shuffled(spark):
    blocks = lambda: set(disk.getAllBlocks().mkString("\n").split("\n"))
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = blocks(), spark.conf.get(key, None)
    assert kept(spark.range(50_000).repartition(7, "id").groupBy((F.col("id") % 1000).alias("k")).count()).count() == 1000
    deadline = time.time() + 10
    left = lambda: [b for b in blocks() - before if "shuffle_" in b and b.endswith("data")]
    while len(left()) > 4 and time.time() < deadline:  # files go in the background; those of count() stay for a while
        time.sleep(0.2)
    assert len(left()) <= 4
    assert spark.conf.get(key, None) == setting


def test_groups_leave_no_table_of_edges(spark):
    rng = random.Random(5)
    edges = [(ip, c) for ip in range(60) for c in rng.sample(range(10), rng.randint(2, 6))]
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    assert {r.ip: r.leader for r in B.groups(spark.createDataFrame(edges, "ip long, cluster long"), 0.6).collect()} == greedy(edges, 0.6)
    left = [f"{folder}/{x}" for x in set(os.listdir(folder)) - before if any(f.endswith(".parquet") for f in os.listdir(f"{folder}/{x}"))]
    assert not [p for p in left if {"ip", "cluster"} <= set(spark.read.parquet(p).columns) or {"a", "b"} <= set(spark.read.parquet(p).columns)]


def test_blocks_do_not_multiply(spark, monkeypatch):
    """Blocks are shuffled once for each other, so many sets make large blocks, compared in smaller ones."""
    monkeypatch.setattr(B, "FEW_BEHAVIOURS", 1024)
    monkeypatch.setattr(B, "BLOCK", 16)
    monkeypatch.setattr(B, "STRIP", 8)
    monkeypatch.setattr(B, "BLOCKS", 9)
    written, write = [], B.kept
    monkeypatch.setattr(B, "kept", lambda df: written.append(write(df)) or written[-1])
    r = random.Random(3)
    sets = {i: set(r.sample(range(70), r.randrange(1, 60))) for i in range(400)}
    df = spark.createDataFrame([(i, f"c{c}") for i, s in sets.items() for c in s], "ip long, cluster string")
    got = {(x.a, x.b): (x.common, round(x.score, 9)) for x in B.pair_scores(df, 0.2).collect()}
    blocks = [t for t in written if "bits" in t.columns]
    assert [t.count() for t in blocks] == [9]
    total = len(set().union(*sets.values()))
    want = {}
    for a in sets:
        for b in range(a + 1, 400):
            common, n, m = len(sets[a] & sets[b]), len(sets[a]), len(sets[b])
            p = max(n, m) / total
            score = p * (common / (n * m) ** 0.5) + (1 - p) * (common / (n + m - common))
            if score > 0.2:
                want[a, b] = (common, round(score, 9))
    assert got == want
