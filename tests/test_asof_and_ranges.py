"""As-of joins, range databases and sessions against plain Python, with hot keys and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from flowlark.operators import ranges as R
from flowlark.operators import sessions as S
from flowlark.operators.asof import asof

PACKET = "event_id long, frame_time_epoch double, isOutbound boolean, ip_src string, ip_dst string, ip_proto string, tcp_srcport int, tcp_dstport int, udp_srcport int, udp_dstport int, frame_len int"


def tables(spark, times, starts):
    return spark.createDataFrame([(x,) for x in times], "t double").repartition(3), spark.createDataFrame([(x,) for x in starts], "start double").repartition(2)


@pytest.mark.parametrize("part_rows", [1 << 20, 7])
@pytest.mark.parametrize("starts", [[0.0, 10.0, 10.5, 11.0, 11.0, 30.0, 500.0, None], [5.0], []])
def test_asof_modes(spark, part_rows, starts):
    r = random.Random(1)
    times = [r.choice([0.0, 5.0, 10.0, 10.25, 10.5, 11.0, 11.9, 12.0, 20.0, 20.5, 400.0, -3.0, r.uniform(-10, 600)]) for _ in range(80)] + [None, 265.0]
    known = sorted({s for s in starts if s is not None})
    t, f = tables(spark, times, starts)
    distinct = {x for x in times if x is not None}
    got = {mode: sorted(map(tuple, asof(t, f, mode, 1.0, part_rows).collect()), key=str) for mode in ("floor", "nearest", "overlap")}
    assert got["floor"] == sorted(((x, max((s for s in known if s <= x), default=None)) for x in distinct), key=str)
    near = {x: min(known, key=lambda s: (abs(s - x), s), default=None) for x in distinct}
    assert got["nearest"] == sorted(((x, s, None if s is None or s == known[0] else known[known.index(s) - 1]) for x, s in near.items()), key=str)
    ends = {s: (known[i + 1] + 1.0 if i + 1 < len(known) else float("inf")) for i, s in enumerate(known)}
    assert got["overlap"] == sorted(((x, s) for x in distinct for s, e in ends.items() if s < x < e), key=str)


def test_an_instant_that_many_share_is_met_once(spark):
    t = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, F.col("id") / 10).otherwise(7.5).cast("double").alias("t"))
    f = spark.range(500).select((F.col("id") * 40).cast("double").alias("start"))
    got = S.latest_start(t, f).where("start <> floor(t / 40) * 40").count()
    assert got == 0 and S.latest_start(t, f).count() == 200_000
    assert S.capture_files(t.where("t > 40"), f, 0.0).count() == t.where("t > 40 and t % 40 <> 0").count()


def test_files_of_spans(spark):
    files = [100.0, 200.0, 5000.0, 9000.0, 9100.0]
    spans = [(1, 150.0, 160.0), (2, 250.0, 9050.0), (3, 50.0, 90.0), (4, 50.0, 100.0), (5, 100.0, 100.0), (6, 9999.0, 20_000.0)]
    got = {(r.id, r.start) for r in S.files_of(spark.createDataFrame(spans, "id int, first double, last double"), spark.createDataFrame([(x,) for x in files], "start double")).collect()}
    want = set()
    for i, a, b in spans:
        begun = [s for s in files if s <= a]
        want |= {(i, s) for s in begun[-2:]} | {(i, s) for s in files if a < s <= b}
    assert got == want


def test_ranges_nest_and_overlap(spark):
    r = random.Random(3)
    base = 10 * 256**3 - 200  # over the edge of a prefix
    tables, plain = [], []
    for name in ("city", "domain", "isp"):
        rows = []
        for i in range(60):
            lo = base + r.randrange(400)
            rows.append((lo, lo + r.choice([0, 1, 5, 60, 300]), f"{name}{i}"))
        rows += [(base + 50, base + 90, "twice"), (base + 50, base + 90, "again"), (base + 50, base + 90, "again"), (0, 2**32 - 1, "all") if name == "isp" else (base, base, "one"), (9, 3, "inverted")]
        plain.append(rows)
        tables.append((spark.createDataFrame([*rows, (None, 5, "x")], f"lo long, hi long, {name} string"), [name]))
    cut = R.elementary(tables)
    got = sorted(map(tuple, cut.collect()))
    assert all(a[1] < b[0] for a, b in zip(got, got[1:]))
    numbers = [base + i for i in range(-3, 720)] + [0, 2**32 - 1]
    address = lambda n: ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    rows = spark.createDataFrame([(address(n), n) for n in numbers] + [("fe80::1", -1), (None, -1), ("1.2.3", -1), (address(base), base)], "ip string, n long")
    found = R.located(rows, cut, "ip", ["city", "domain", "isp"]).collect()
    assert len(found) == len(numbers) + 4
    for x in found:
        want = [min(((-lo, hi, v) for lo, hi, v in side if lo <= x.n <= hi), default=(0, 0, None))[2] for side in plain]
        assert [x.city, x.domain, x.isp] == want


def test_range_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("network,country,more\n10.0.0.0/8,DE,1\n10.1.0.0/16,AT,2\nbad,FR,3\n::1/64,XX,4\n1.2.3.4/99,YY,1\n")
    (tmp_path / "b.csv").write_text("lo,hi,isp\n10.0.0.0,10.0.0.255,one\n167772672,167772700,two\n5,x,none\n9,1,none\n")
    a, b = R.read_ranges(spark, str(tmp_path / "a.csv"), ["country"]), R.read_ranges(spark, str(tmp_path / "b.csv"), ["isp", "missing"])
    assert {r.country for r in a.collect()} <= {"DE", "AT", "YY"} and sorted((r.lo, r.hi, r.isp, r.missing) for r in b.collect()) == [(167772160, 167772415, "one", None), (167772672, 167772700, "two", None)]
    cut = R.elementary([(a, ["country"]), (b, ["isp"])])
    rows = spark.createDataFrame([("10.0.0.7",), ("10.1.0.7",), ("10.0.2.5",), ("11.0.0.0",)], "ip string")
    assert sorted((r.ip, r.country, r.isp) for r in R.located(rows, cut, "ip", ["country", "isp"]).collect()) == [("10.0.0.7", "DE", "one"), ("10.0.2.5", "DE", "two"), ("10.1.0.7", "AT", None), ("11.0.0.0", None, None)]


def brute_sessions(rows, gap):
    out, seen = {}, {}
    for i, key, t in sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2] or 0)):
        n, last = seen.get(key, (0, None))
        if t is not None and last is not None and t - last > gap:
            n += 1
        seen[key] = (n, t if t is not None else last)
        out[i] = n
    return out


@pytest.mark.parametrize("gap", [120.0, 1.0, 0.0])
def test_sessions_are_numbered_as_packet_by_packet(spark, gap):
    r = random.Random(int(gap))
    rows = [(i, r.randrange(3), r.choice([None, float(r.randrange(0, 5000, 60)), r.uniform(0, 5000), -r.uniform(0, 300)])) for i in range(400)]
    packets = spark.createDataFrame([(i, t, False, f"1.0.0.{k}", "9.0.0.0", "6", 5, 80, None, None, 1) for i, k, t in rows], PACKET).repartition(5)
    assert {x.event_id: x.group_id for x in S.with_session(packets, gap).collect()} == brute_sessions(rows, gap)


def test_a_hot_conversation_is_spread(spark):
    """Half of the packets are one conversation; what is put in order are its spans."""
    packets = spark.range(200_000).select(
        F.col("id").alias("event_id"), (F.col("id") * 0.25 + F.when(F.col("id") > 150_000, 500).otherwise(0)).cast("double").alias("frame_time_epoch"), F.lit(False).alias("isOutbound"),
        F.when(F.col("id") % 2 == 0, "10.0.0.1").otherwise(F.concat(F.lit("11.0.0."), (F.col("id") % 250).cast("string"))).alias("ip_src"), F.lit("12.0.0.1").alias("ip_dst"), F.lit("6").alias("ip_proto"),
        F.lit(1).alias("tcp_srcport"), F.lit(2).alias("tcp_dstport"), F.lit(None).cast("int").alias("udp_srcport"), F.lit(None).cast("int").alias("udp_dstport"), F.lit(1).alias("frame_len"),
    )
    got = S.with_session(packets).where("ip_src = '10.0.0.1'").groupBy("group_id").count().collect()
    assert sorted((r.group_id, r["count"]) for r in got) == [(0, 75_001), (1, 24_999)]


def test_addresses_that_are_no_ipv4(spark):
    rows = [(1, 0.0, False, "fe80::1", "fe80::2", "6", 5, 80, None, None, 1), (2, 1.0, True, "fe80::2", "fe80::1", "6", 80, 5, None, None, 1), (3, 1.0, False, "1.0.0.1", None, "6", 80, 5, None, None, 1), (4, 1.0, False, "1.0.0.1", "1.0.0.2", "6", 80, 5, None, None, 1)]
    packets = spark.createDataFrame(rows, PACKET)
    assert [r.event_id for r in S.addressed(packets).collect()] == [4]
    marked = S.with_session(packets).where("event_id < 3").collect()
    assert {(r.min_ip, r.max_ip, r.group_id) for r in marked} == {("fe80::1", "fe80::2", 0)}


def test_session_spans_are_worked_out_once(spark):
    """From spans as from packets; the files of spans read a written table, not the packets again for each step."""
    rows = [(1, 0.0, "2.0.0.0"), (2, 100.0, "2.0.0.0"), (3, 300.0, "2.0.0.0"), (4, None, "2.0.0.0"), (5, 7.0, None), (6, None, "3.0.0.0"), (7, 4000.0, "2.0.0.0")]
    packets = spark.createDataFrame([(i, t, False, a, "10.0.0.0", "6", 5, 80, None, None, 1) for i, t, a in rows], "event_id long, frame_time_epoch double, isOutbound boolean, ip_src string, ip_dst string, ip_proto string, tcp_srcport int, tcp_dstport int, udp_srcport int, udp_dstport int, frame_len int")
    names = [*S.KEYS, "group_id"]
    for gap in (0.0, 120.0, 250.0):
        plain = S.with_session(packets, gap).groupBy(*names).agg(F.min("frame_time_epoch").alias("first"), F.max("frame_time_epoch").alias("last"))
        spans = S.session_spans(packets, gap)
        assert sorted(map(str, spans.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    times = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("event_id").cast("double").alias("first"), (F.col("event_id") + 9000.0).alias("last"))
    found = S.files_of(times, spark.createDataFrame([(0.0,), (3600.0,), (7300.0,)], "start double"))
    assert found.count() > 0 and not any("events.parquet" in f for f in found.inputFiles())
