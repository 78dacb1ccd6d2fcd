"""Operators at their edges: far times, many networks, hot behaviours, stored results."""

import random

from pyspark.sql import functions as F

from flowlark.functions import lists as L
from flowlark.functions.fuzzy import compare_hashes, hash_bytes, hash_texts, register
from flowlark.operators import behaviour as B
from flowlark.operators import fuzzy_clusters as C
from flowlark.operators import groups as G
from flowlark.operators import report
from flowlark.operators import sessions as S
from flowlark.sources import stores
from flowlark.sources.packets import from_conversations, from_events

DAY = 86400.0


def test_the_last_file_reaches_as_far_as_times_go(spark):
    starts = [0.0, 50.0, 50.0, 3 * DAY, None]
    times = [0.0, 0.5, 50.0, 50.5, 51.0, 100.0, 2 * DAY, 3 * DAY, 3 * DAY + 0.5, 40 * DAY, 4000 * DAY, None]
    t, f = spark.createDataFrame([(x,) for x in times], "t double"), spark.createDataFrame([(x,) for x in starts], "start double")
    ends = {0.0: 51.0, 50.0: 3 * DAY + 1, 3 * DAY: float("inf")}
    want = sorted((x, s) for x in times if x is not None for s, e in ends.items() if s < x < e)
    assert sorted(map(tuple, S.capture_files(t, f).collect())) == want and (4000 * DAY, 3 * DAY) in want
    latest = {r.t: r.start for r in S.latest_start(t, f).collect()}
    assert latest == {x: None if x is None else max((s for s in ends if s <= x), default=None) for x in times}
    assert S.capture_files(t, f.where("start > 1e12")).count() == 0 and S.capture_files(t.where("t is null"), f).count() == 0


def test_many_networks(spark):
    nets = spark.range(20_000).select((F.lit(167772160) + F.col("id") * 512).alias("lo"), (F.lit(167772160) + F.col("id") * 512 + 255).alias("hi")).union(spark.createDataFrame([(0, 167772159)], "lo long, hi long"))
    rows = [("10.0.0.5", True), ("10.0.1.5", False), ("10.156.63.1", False), ("10.156.62.1", True), ("11.0.0.0", False), ("1.2.3.4", True), (None, None)]
    got = S.containing(spark.createDataFrame(rows, "ip_dst string, want boolean"), nets, "ip_dst").collect()
    assert len(got) == 7 and all(r.inside == r.want for r in got)
    out = S.directed(spark.createDataFrame([(*r, "x") for r in rows], "ip_dst string, want boolean, inside string"), nets).collect()
    assert len(out) == 6 and all(r.isOutbound != r.want for r in out)


def test_first_packet_of_one_time_without_ids(spark):
    packets = from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).drop("event_id").withColumn("frame_time_epoch", F.floor(F.col("frame_time_epoch") / 86400) * 86400.0)
    ends = ["ip_src", "ip_dst", "tcp_srcport", "udp_dstport", "country", "session_time"]
    one, two = (sorted(map(str, S.sessions(packets.repartition(n, F.rand(n)), 1.0).select(*ends).collect())) for n in (2, 7))
    assert one == two


def test_outbound_sessions(spark):
    rows = [(1, 0.0, 10, ["3:a:b", "0", "10"]), (2, 5.0, 20, ["3:a:b", "5", "20"])]
    packets = spark.createDataFrame(rows, "event_id long, frame_time_epoch double, tcp_len int, tcp_payload array<string>").selectExpr("*", "true as isOutbound", "'10.0.0.1' as ip_src", "'10.0.0.2' as ip_dst", "'6' as ip_proto", "1 as tcp_srcport", "2 as tcp_dstport", "cast(null as int) as udp_srcport", "cast(null as int) as udp_dstport", "50 as frame_len", "20 as tcp_hdr_len", "cast(null as int) as udp_length", "7 as icmp_length", "5 as icmp_length_original_datagram", "'eth:ip' as frame_protocols", "'c' as country", "'d' as domain", "'i' as isp")
    full = S.sessions(packets)
    assert S.inbound(full, "o").count() == 1 and S.inbound(full, "i").count() == 0
    r = full.first()
    assert (r.icmp_o_tt_length, r.icmp_i_tt_length, r.icmp_tt_original_datagram_length, r.icmp_o_avg_datagram_length) == (14, None, 10, 5.0)
    assert [(x.pos, x.size, x.hash) for x in S.payload_rows(full, ["ip_src"], "o").collect()] == [(0, 3, "3:a:b"), (1, 3, "3:a:b")]


def test_hashes_alike_once_shortened(spark):
    hashes = ["3:AAAA:B", "3:AAAAA:B", "3:AAA:B", "3:AAAA:C", "6:AAAA:B", "3:XAAAAY:ZZZZZ", "3:XAAAY:ZZZ", "48:abcdefghijklm:nopqrstuv", "48:abcdefghijklx:nopqrstuv", None]
    df = spark.createDataFrame([("p", h) for h in hashes] + [("q", "3:AAAA:B")], "part string, hash string")
    got = {(r.part, r.a, r.b): r.score for r in C.alike(df, df).collect()}
    known = [h for h in hashes if h]
    want = {("p", a, b): compare_hashes(a, b) for a in known for b in known if compare_hashes(a, b) > 0}
    assert got == want | {("q", "3:AAAA:B", "3:AAAA:B"): 100} and want["p", "3:AAAA:B", "3:AAAAA:B"] == 100


def test_hashes_of_batches_are_those_of_single_payloads():
    r = random.Random(4)
    texts = [bytes(r.choices(b"abc \n", k=r.choice([0, 1, 7, 60, 900, 5000]))) for _ in range(120)] + [b"", b"x" * 20_000, bytes(3000), bytes(r.choices(range(256), k=70_000))]
    assert hash_texts(texts) == [hash_bytes(t) for t in texts] and hash_texts([]) == []


def test_links_within_one_address(spark):
    r = random.Random(2)
    base = [bytes(r.choices(b"abcdefgh ", k=2000)) for _ in range(3)]
    near = [hash_bytes(b + b"tail") for b in base]
    payloads = spark.createDataFrame([("p", i, 0, h) for i, h in enumerate([*map(hash_bytes, base), *near])], "part string, idx int, pos int, hash string")
    sessions = spark.createDataFrame([("p", i, ip) for i, ip in enumerate(["a", "a", "b", "a", "b", "b"])], "part string, idx int, ip_src string")
    every = {(x.a, x.b) for x in C.links(payloads).collect()}
    got = {(x.a, x.b, x.ip_src) for x in C.same_address_links(payloads, sessions).collect()}
    of = dict(enumerate("aababb"))
    assert {(0, 3), (3, 0), (1, 4), (2, 5)} <= every
    assert got == {(a, b, of[a]) for a, b in every if of[a] == of[b]} and (0, 3, "a") in got and not {x for x in got if x[:2] == (1, 4)}


def test_a_behaviour_that_very_many_share(spark):
    n = 20_000
    own = spark.range(n).select(F.col("id").cast("string").alias("ip"), F.explode(F.array(F.lit("hot"), F.concat(F.lit("x"), F.col("id").cast("string")), F.concat(F.lit("y"), (F.col("id") % 1000).cast("string")))).alias("cluster"))
    got = B.groups(own, 0.3).groupBy("leader").count().collect()
    assert len(got) == 1000 and {r["count"] for r in got} == {20}
    assert B.groups(own, 0.15).select("leader").distinct().count() == 1
    assert B.pair_scores(own, 0.3).count() == 1000 * 20 * 19 // 2


def test_pairs_above_any_threshold(spark):
    r = random.Random(6)
    sets = {f"i{i}": {f"c{int(r.random() ** 3 * 30)}" for _ in range(r.choice([1, 2, 3, 9, 14, 25]))} for i in range(60)}
    df = spark.createDataFrame([(i, c) for i, s in sets.items() for c in s], "ip string, cluster string")
    total = len(set().union(*sets.values()))
    for threshold in (0.0, 0.05, 0.2, 0.5, 0.8, 0.95):
        want = {}
        for a in sets:
            for b in sets:
                x, y, c = len(sets[a]), len(sets[b]), len(sets[a] & sets[b])
                p = max(x, y) / total
                score = p * c / (x * y) ** 0.5 + (1 - p) * c / (x + y - c)
                if a < b and c and score > threshold:
                    want[a, b] = (c, round(score, 9))
        assert {(r.a, r.b): (r.common, round(r.score, 9)) for r in B.pair_scores(df, threshold).collect()} == want


def test_stored_results(spark, tmp_path):
    rows = spark.createDataFrame([("tcp", 1, "a"), ("udp", 2, None)], "proto string, idx int, hash string")
    stores.write_results({"clusters": rows, "sizes": rows.groupBy("idx").count()}, str(tmp_path / "r"))
    assert [tuple(r) for r in stores.read_results(spark, str(tmp_path / "r"), "clusters", proto=["udp"]).select("proto", "idx", "hash").collect()] == [("udp", 2, None)]
    assert stores.read_results(spark, str(tmp_path / "r"), "sizes").count() == 2
    stores.write_packets_json(rows, str(tmp_path / "j"))
    assert sorted(map(tuple, spark.read.schema(rows.schema).json(str(tmp_path / "j")).collect())) == [("tcp", 1, "a"), ("udp", 2, None)]


def test_reports_with_key_payloads(spark, tmp_path):
    rows = spark.createDataFrame([("g", "1.1.1.1", "DE", "c2", "tcp", "pay two"), ("g", "1.1.1.2", None, "c1", "tcp", None), ("g", "1.1.1.1", "AT", "c2", "udp", "a first"), ("h", "2.2.2.2", "FR", None, None, None)], "group_id string, ip string, country string, cluster string, protocol string, key_payload string")
    r = report.group_rows(rows).where("group_id = 'g'").first()
    assert (r.cluster.cluster_id, r.cluster.cluster_key_payload, r.country.group_country, r.number_of_protocols) == (["c1", "c2"], ["-", "a first"], ["AT", "DE"], 2)
    report.write_group_xml(rows, str(tmp_path / "x"))
    back = {x.group_id: x for x in report.read_group_xml(spark, str(tmp_path / "x")).collect()}
    assert len(back) == 2 and (back["g"].cluster_id, back["g"].cluster_key_payload) == (["c1", "c2"], ["-", "a first"])
    assert {x.group_id: x.cluster_key_payload for x in report.from_group_xml(report.group_xml(rows)).collect()}["g"] == ["-", "a first"]
    assert "<cluster_key_payload>a first</cluster_key_payload>" in report.group_xml(rows).where("group_id = 'g'").first().xml


def test_networks_of_a_settings_file(spark, tmp_path):
    (tmp_path / "s.yml").write_text("Other: 1\nTrap:\n  - 10.0.1.0/24\n  - '192.168.0.7/31'  # two\n  - none\n  - 10.0.1.0/24\n")
    got = sorted(map(tuple, stores.read_networks(spark, str(tmp_path / "s.yml")).collect()))
    assert got == [("10.0.1.0/24", 167772416, 167772671), ("192.168.0.7/31", 3232235526, 3232235527)]


def test_group_figures(spark):
    found = spark.createDataFrame([(1, "a", "c1", "tcp", "DE", 5), (1, "b", "c2", "udp", "AT", 6), (1, "b", "c2", "udp", None, 7), (2, "c", "c1", "tcp", "FR", 1)], "leader int, ip string, cluster string, proto string, country string, time long")
    r = {x.leader: x for x in G.statistics(found).collect()}
    assert (r[1].sessions, r[1].ip_num, r[1].country_set, r[1].proto_set, r[1].unique_cluster_num) == (3, 2, ["AT", "DE", "None"], ["tcp", "udp"], 2)
    assert r[2].main_country == "FR" and r[1].unique_country_num == 3
    unknown = found.where("leader = 1").withColumn("country", F.when(F.col("ip") == "zz", "x"))
    assert G.statistics(unknown).first().main_country == "None"
    assert {(x.value, x.n, x.portion) for x in G.shares(found.where("leader = 1"), "country").collect()} == {("DE", 1, 1 / 3), ("AT", 1, 1 / 3), ("None", 1, 1 / 3)}
    assert {(x.value, x.n) for x in G.shares(found.where("leader = 1"), "cluster").collect()} == {("c1", 1), ("c2", 2)}


def test_lists_hours_and_sql_functions(spark):
    one = spark.range(1).select(
        L.positions_of(F.array(F.lit("a"), F.lit(None), F.lit("a")), F.lit("a")).alias("p"), L.gather(F.array(F.lit(5), F.lit(6)), F.array(F.lit(1), F.lit(7))).alias("g"),
        L.without_empty(F.array(F.lit(""), F.lit(None), F.lit("x"))).alias("w"), L.hour_epoch(F.lit("1970-01-02 3")).alias("h"), L.hour_epoch(F.lit("no")).alias("n"),
    ).first()
    assert tuple(one) == ([0, 2], [6, None], ["x"], 97200, None)
    items = F.array(*(F.array(F.lit("h"), F.lit(t), F.lit(n)) for t, n in (("10", "1000"), ("9", "99"), ("8", "1000"))))
    orders = spark.range(1).select(*(L.sorted_payloads(items, by, old) for by, old in (("size", True), ("size", False), ("time", True), ("time", False)))).first()
    assert [[x[1] for x in o] for o in orders] == [["10", "8", "9"], ["9", "10", "8"], ["10", "8", "9"], ["8", "9", "10"]]
    assert [x.file for x in spark.createDataFrame([("s/0106/isp/snort.log.1",), ("f",)], "p string").select(*S.path_parts(F.col("p"))).collect()] == ["snort.log.1", "f"]
    register(spark)
    r = spark.sql("SELECT fuzzy_hash('abc') AS h, fuzzy_compare('3:AAAA:B', '3:AAAAA:B') AS c, ip_to_long('10.0.1.255') AS n").first()
    assert (r.h, r.c, r.n) == (hash_bytes(b"abc"), 100, 167772671)


def test_conversations_as_packets(spark):
    turns = spark.createDataFrame([(1, 0, "user", "héllo"), (1, 1, "assistant", None), (1, 2, "user", "again"), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    full = S.sessions(from_conversations(turns)).collect()
    assert len(full) == 1 and full[0].session_tt_packet == 3
    assert [x[0] for x in full[0].tcp_i_payload_list] == [hash_bytes("héllo".encode()), hash_bytes(b"again")] and full[0].tcp_o_payload_list == []
    assert full[0].tcp_i_tt_payload_length == 11
