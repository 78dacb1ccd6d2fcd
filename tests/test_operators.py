"""Hand-computed cases."""

from pyspark.sql import functions as F

from flowlark.functions.net import common_prefix, hex_text, ip_to_long
from flowlark.operators import behaviour as B
from flowlark.operators import sessions as S
from flowlark.sources.packets import JSON_SCHEMA, flatten, from_events
from flowlark.streaming.sessions import session_windows

PACKET = "event_id long, frame_time_epoch double, isOutbound boolean, ip_src string, ip_dst string, ip_proto string, tcp_srcport int, tcp_dstport int, udp_srcport int, udp_dstport int, frame_len int"


def test_gap_is_strict_and_directions_are_one(spark):
    rows = [(1, 0.0, False, "2.0.0.0", "10.0.0.0", "6", 5, 80, None, None, 1), (2, 120.0, True, "10.0.0.0", "2.0.0.0", "6", 80, 5, None, None, 1), (3, 240.5, False, "2.0.0.0", "10.0.0.0", "6", 5, 80, None, None, 1), (4, 240.5, False, "2.0.0.0", "10.0.0.0", "6", 5, 80, None, None, 1)]
    marked = S.with_session(spark.createDataFrame(rows, PACKET)).collect()
    assert sorted((r.event_id, r.group_id) for r in marked) == [(1, 0), (2, 0), (3, 1), (4, 1)]
    assert {r.min_ip for r in marked} == {"2.0.0.0"}
    assert sorted(r.packets for r in session_windows(spark.createDataFrame(rows, PACKET)).collect()) == [2, 2]


def test_null_ports_are_one_conversation(spark):
    rows = [(1, 0.0, False, "1.0.0.1", "1.0.0.2", "1", None, None, None, None, 1), (2, 1.0, False, "1.0.0.1", "1.0.0.2", "1", None, None, None, None, 1)]
    assert {r.group_id for r in S.with_session(spark.createDataFrame(rows, PACKET)).collect()} == {0}


def test_full_session_has_46_columns(spark):
    assert len(S.sessions(from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))).columns) == 46


def test_functions(spark):
    one = spark.range(1).select(
        ip_to_long(F.lit("10.0.1.255")).alias("ip"), common_prefix(F.lit("eth:ip:tcp"), F.lit("eth:ip:tcp:http")).alias("a"),
        common_prefix(F.lit("eth:ip"), F.lit("eth:ip:udp")).alias("b"), common_prefix(F.lit("x"), F.lit("y")).alias("c"), hex_text(F.lit("47:45:54:0d:0a")).alias("h"),
    ).first()
    assert tuple(one) == (167772671, "eth:ip:tcp", "eth:ip", "", "GET  ")


def test_crawler_filter_is_null_safe(spark):
    rows = spark.createDataFrame([(None, None), ("X", None), ("X", "Y"), ("a", "Y")], "domain string, isp string")
    assert S.without_crawler(rows, "X", "Y").count() == 3


def test_prune_and_score(spark):
    e = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "2"), ("c", "1"), ("d", "3")], "ip string, cluster string")
    kept = B.prune(e)
    assert sorted(map(tuple, kept.collect())) == [("a", "1"), ("a", "2"), ("b", "1"), ("b", "2")]
    assert B.pair_scores(kept).first().score == 1.0


def test_groups_match_the_greedy_order(spark):
    import random

    random.seed(4)
    edges = sorted({(f"i{random.randrange(40):02d}", f"c{random.randrange(25)}") for _ in range(160)})
    df = spark.createDataFrame(edges, "ip string, cluster string")
    for threshold in (0.1, 0.3, 0.6):
        score = {(r.a, r.b): r.score for r in B.pair_scores(df).collect()}
        sets = {}
        for ip, c in edges:
            sets.setdefault(ip, set()).add(c)
        free, leader = set(sets), {}
        for ip in sorted(sets, key=lambda x: (-len(sets[x]), x)):
            if ip in free:
                mine = {x for x in free if x != ip and score.get((min(x, ip), max(x, ip)), 0) > threshold}
                leader |= {x: ip for x in mine | {ip}}
                free -= mine | ({ip} if mine else set())
        assert {r.ip: r.leader for r in B.groups(df, threshold).collect()} == leader


def test_json_packets(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text('[{"_source": {"layers": {"country": "DE", "isInternal": false, "frame.len": ["60", "9"], "ip.src": ["1.2.3.4"], "frame.time_epoch": ["1.5"], "tcp.len": ["x"]}}}]')
    r = flatten(spark.read.schema(JSON_SCHEMA).option("multiLine", True).json(str(path))).first()
    assert (r.country, r.frame_len, r.ip_src, r.frame_time_epoch, r.tcp_len, r.udp_length) == ("DE", 60, "1.2.3.4", 1.5, None, None)
