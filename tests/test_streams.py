"""Streams of captures and hours, and maps in parts, against plain Python."""

import json
from collections import Counter

from pyspark.sql import functions as F

from flowlark.functions import lists as L
from flowlark.functions.fuzzy import hash_bytes
from flowlark.operators import groups as G
from flowlark.plans import session_queries as Q
from flowlark.sources.packets import read_captures
from flowlark.streaming import captures, hours

DIR = "/root/testdata/sf0.001"


def record(i, payload="61:62", **more):
    layers = {"country": "DE", "isInternal": False, "frame.len": ["60"], "ip.src": [f"1.0.0.{i}"], "ip.dst": ["2.0.0.1"], "ip.proto": ["6"], "frame.time_epoch": [f"{i}.5"], "tcp.len": ["20"]}
    return {"_source": {"layers": layers | ({"tcp.payload": [payload]} if payload else {}) | more}}


def test_raw_payloads_of_captures(spark, tmp_path):
    raw = "47:45:54:20" * 300
    (tmp_path / "a.json").write_text(json.dumps([record(1, raw), record(2, None), record(3, "0d", **{"tcp.len": ["x"]}), record(4, "0d", **{"frame.time_epoch": []})]))
    got = {r.ip_src[-1]: r.tcp_payload for r in read_captures(spark, str(tmp_path)).collect()}
    assert got == {"1": [hash_bytes(raw.encode()), "1.5", "20"], "2": None, "3": [hash_bytes(b"0d"), "3.5", None], "4": [hash_bytes(b"0d"), None, "20"]}


def test_each_file_is_read_once_and_broken_ones_cost_nothing(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "out")
    (source / "isp").mkdir(parents=True)
    (source / "isp" / "a.json").write_text(json.dumps([record(1), record(2)]))
    (source / "b.json").write_text('[{"_source": {"lay')
    (source / "empty.json").write_text("")

    def run():
        captures.ingest(spark, str(source), path, files_each=1).awaitTermination()
        return sorted(r.ip_src for r in captures.packets(spark, path).collect()), sorted(r.path.rsplit("/", 1)[1] for r in captures.quarantine(spark, path).collect())

    assert run() == (["1.0.0.1", "1.0.0.2"], ["b.json"])
    assert run() == (["1.0.0.1", "1.0.0.2"], ["b.json"])
    (source / "c.json").write_text(json.dumps([record(3), {"other": 1}]))
    packets, broken = run()
    assert packets == ["1.0.0.1", "1.0.0.2", "1.0.0.3"] and broken == ["b.json", "c.json"]
    last = spark.read.parquet(f"{path}/packets").agg(F.max("version")).first()[0]
    schema = captures.T.StructType([*captures.JSON_SCHEMA.fields, captures.T.StructField("_corrupt_record", captures.T.StringType()), captures.T.StructField("path", captures.T.StringType())])
    again = spark.read.schema(schema).option("multiLine", True).json(str(source / "c.json")).withColumn("path", F.lit("c.json"))
    captures.store(again, last, path)  # the last batch once more, as after a failure
    assert captures.packets(spark, path).count() == 3


def test_hours_with_late_rows_set_apart(spark, tmp_path):
    def arrive(times):
        rows = spark.createDataFrame([("6" if i % 2 else None, t) for i, t in enumerate(times)], "ip_proto string, frame_time_epoch double")
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        hours.follow(source, f"{tmp_path}/state", 3600.0).awaitTermination()

    arrive([7200.0, 7300.0, 20000.0, None])
    arrive([16400.0, 16399.0, 10.0, 25000.0])  # an hour behind 20000 is not late, a second more is
    assert sorted(r.frame_time_epoch for r in hours.late(spark, f"{tmp_path}/state").collect()) == [10.0, 16399.0]
    got = {(r.ip_proto, r.hour): r.n for r in hours.hours(spark, f"{tmp_path}/state").collect()}
    want = Counter({(None, 2): 1, ("6", 2): 1, (None, 5): 1, (None, 4): 1, ("6", 6): 1})
    assert got == {(p, h): want[p, h] for p in (None, "6") for h in range(1, 7)}
    both = {(r.ip_proto, r.hour): r.n for r in hours.hours(spark, f"{tmp_path}/state", with_late=True).collect()}
    assert both["6", 4] == 1 and both[None, 0] == 1 and both["6", 0] == 0 and len(both) == 2 * 8


def test_hour_windows_on_tables_and_streams(spark, tmp_path):
    rows = Q.packets(spark, DIR).select("ip_proto", "frame_time_epoch")
    want = {(r.ip_proto, r.hour): r.n for r in Q.hourly_grid(spark, DIR).where("n > 0").collect()}
    assert {(r.ip_proto, r.hour): r.n for r in hours.hour_windows(rows).collect()} == want
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = hours.hour_windows(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "1 hour")
    stream.writeStream.outputMode("complete").format("memory").queryName("by_hour").trigger(availableNow=True).start().awaitTermination()
    assert {(r.ip_proto, r.hour): r.n for r in spark.table("by_hour").collect()} == want


def test_maps_in_parts(spark):
    n = 60_000
    rows = spark.range(n).select(F.lit(1).alias("g"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("ip"), F.col("id").cast("string"))).alias("ip"), (F.col("id") % 977).alias("time"))
    rows = rows.union(spark.createDataFrame([(None, "a", 5), (None, "a", None), (None, "a", 5), (2, None, 1), (2, "b", 1)], "g int, ip string, time long"))
    parts = G.in_parts(rows, ["g"], "ip", "time", 500).cache()
    sizes = parts.select("g", F.aggregate(F.map_values("entries"), F.lit(0), lambda a, x: a + F.size(x)).alias("n")).collect()
    assert max(r.n for r in sizes) <= 500 and sum(r.n for r in sizes) == n + 4 and parts.select("g", "part").distinct().count() == parts.count()
    back = G.from_parts(parts, ["g"], "ip", "time")
    assert back.exceptAll(rows.where("ip is not null")).count() == 0 and back.count() == n + 4
    assert G.in_parts(rows.limit(0), ["g"], "ip", "time").count() == 0
    spread = parts.select("g", F.explode(F.map_keys("entries")).alias("ip")).where("ip <> 'hot'").groupBy("g", "ip").count().where("count > 1").count()
    assert spread <= 300  # only where a full part ends


def test_lists_in_one_order(spark):
    rows = spark.createDataFrame([("a", 3.0, "x", None), ("a", 1.0, "z", "p"), ("a", 1.0, "y", "q"), ("a", 9000.0, None, "r"), ("a", None, "n", "n"), ("b", 1.0, "w", "s")], "k string, time double, country string, place string")
    got = {(r.k, r.span): (r.times, r.country, r.place) for r in G.ordered_lists(rows, ["k"], ["country", "place"]).collect()}
    assert got == {("a", 0): ([1.0, 1.0, 3.0], ["y", "z", "x"], ["p", "q", None]), ("a", 2): ([9000.0], [None], ["r"]), ("b", 0): ([1.0], ["w"], ["s"])}


def test_cases_are_looked_up_again_on_the_next_day(spark):
    cases = spark.sql("SELECT * FROM VALUES (DATE'2020-01-06', 'x', 5d), (DATE'2020-01-06', 'x', 5d), (DATE'2020-01-06', 'x', 7d), (DATE'2020-01-06', 'y', 5d), (DATE'2020-01-31', 'x', 1d), (DATE'2020-01-06', 'x', 9d) AS t(date, proto, session_time)")
    sessions = spark.sql("SELECT * FROM VALUES (DATE'2020-01-06', 'x', 5d, 1), (DATE'2020-01-07', 'x', 5d, 2), (DATE'2020-01-07', 'x', 7d, 3), (DATE'2020-01-07', 'x', 7d, 4), (DATE'2020-02-01', 'x', 1d, 5), (DATE'2020-01-08', 'x', 9d, 6) AS t(date, proto, session_time, id)")
    assert sorted((r.session_time, r.days_on, r.id) for r in G.case_sessions(cases, sessions).collect()) == [(1.0, 1, 5), (5.0, 0, 1), (7.0, 1, 3), (7.0, 1, 4)]


def test_markers_in_first_lines(spark):
    rows = [(1, [b"GET /?comment=1"]), (2, [b"a\ncomment=1"]), (3, [b"a\rcomment=", None]), (4, []), (5, None), (6, [b"\xff\xfecomment=\x00", b"x"]), (7, [None]), (8, [b"comment"])]
    got = {r.id for r in spark.createDataFrame(rows, "id int, p array<binary>").where(L.any_begins(F.col("p"), "comment=")).collect()}
    assert got == {1, 3, 6}


def test_captures_become_clusters(spark):
    got = {r.idx: r.leader for r in Q.capture_clusters(spark, DIR).collect()}
    users = {r.conv_id: 167837696 + r.conv_id for r in spark.read.parquet(f"{DIR}/conversations.parquet").where("role = 'user' and text is not null").collect()}
    assert set(got) <= set(users.values()) and any(v is not None for v in got.values())


def test_capture_files_grow_in_number_not_in_size(spark, monkeypatch):
    """A file is read by one task, so packets, not files, are bounded; the clusters stay the same."""
    before = {r.idx: r.leader for r in Q.capture_clusters(spark, DIR).collect()}
    monkeypatch.setattr(Q, "FILE_PACKETS", 10)
    folder, many = Q._captures(spark, DIR)
    n = spark.read.parquet(f"{DIR}/conversations.parquet").count()
    held = Counter(r.path for r in spark.read.option("multiLine", True).json(f"{folder}/captures/file=*[0-9]").select(F.col("_metadata.file_path").alias("path")).collect())
    assert many == -(-n // 10) and sum(held.values()) == n and len(held) > 4
    assert {r.idx: r.leader for r in Q.capture_clusters(spark, DIR).collect()} == before
