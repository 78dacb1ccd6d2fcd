"""Queries on packets and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlark.functions import lists as L
from flowlark.functions.net import cidr_range, common_prefix, hex_text, ip_to_long
from flowlark.operators import fuzzy_clusters as C
from flowlark.operators import groups as G
from flowlark.operators import ranges as R
from flowlark.operators import sessions as S
from flowlark.operators.scratch import kept, new_folder
from flowlark.sources.packets import PACKETS_SQL, from_conversations, from_events, read_captures
from flowlark.streaming import captures, hours

GAP = 21600.0


def packets(spark: SparkSession, d: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{d}/events.parquet"))


_NUM = "CAST(split_part({0}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({0}, '.', 2) AS BIGINT) * 65536 + CAST(split_part({0}, '.', 3) AS BIGINT) * 256 + CAST(split_part({0}, '.', 4) AS BIGINT)"
_S, _D = _NUM.format("ip_src"), _NUM.format("ip_dst")
_SESSION_SQL = f"""WITH {PACKETS_SQL}, keyed AS (
  SELECT *, CASE WHEN {_S} < {_D} THEN ip_src ELSE ip_dst END AS min_ip, CASE WHEN {_S} > {_D} THEN ip_src ELSE ip_dst END AS max_ip, least(sport, dport) AS min_port, greatest(sport, dport) AS max_port FROM packets),
gaps AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY min_ip, max_ip, min_port, max_port, ip_proto ORDER BY t) > {{gap}} THEN 1 ELSE 0 END AS g FROM keyed),
marked AS (SELECT *, CAST(sum(g) OVER (PARTITION BY min_ip, max_ip, min_port, max_port, ip_proto ORDER BY t) AS BIGINT) AS group_id FROM gaps) """
_BY = "GROUP BY min_ip, max_ip, min_port, max_port, ip_proto, group_id"


def sessionize(gap: float):
    def query(spark: SparkSession, d: str) -> DataFrame:
        marked = S.with_session(packets(spark, d), gap)
        return marked.groupBy(*S.KEYS, "group_id").agg(F.count("*").alias("packets"), F.sum("frame_len").alias("bytes"), F.min("frame_time_epoch").alias("first_time"), F.max("frame_time_epoch").alias("last_time"))

    sql = _SESSION_SQL.format(gap=gap) + f"SELECT min_ip, max_ip, min_port, max_port, ip_proto, group_id, count(*) AS packets, CAST(sum(frame_len) AS BIGINT) AS bytes, min(t) AS first_time, max(t) AS last_time FROM marked {_BY}"
    return query, sql


def session_window(spark: SparkSession, d: str) -> DataFrame:
    """The same sessions by Spark's own session windows: a gap of exactly 120 s stays in one."""
    from flowlark.streaming.sessions import session_windows

    return session_windows(packets(spark, d), "120 seconds").select("ip_proto", "min_ip", "max_ip", "packets", "bytes")


_TEXT_COLUMNS = ["ip_src", "ip_dst", "ip_proto", "tcp_srcport", "tcp_dstport", "udp_srcport", "udp_dstport", "country", "domain", "isp", "frame_i_common_protocols", "frame_o_common_protocols", "frame_i_max_protocols", "frame_o_max_protocols"]
_COUNTS = ["session_tt_packet", "session_i_tt_packet", "session_o_tt_packet", "session_tt_frame_length", "session_i_tt_frame_length", "session_o_tt_frame_length", "udp_tt_length", "udp_i_tt_length", "udp_o_tt_length", "udp_i_avg_length", "udp_o_avg_length", "tcp_hdr_len_sum", "tcp_tt_payload_length", "tcp_i_tt_payload_length", "tcp_o_tt_payload_length", "tcp_i_avg_payload_length", "tcp_o_avg_payload_length"]


def session_full(spark: SparkSession, d: str) -> DataFrame:
    full = S.sessions(packets(spark, d), GAP)
    times = F.array_join(F.transform("session_time_list", lambda x: F.round(x * 1000).cast("long").cast("string")), ",")
    return full.select("session_time", F.col("session_duration").cast("double").alias("session_duration"), times.alias("times"), *_TEXT_COLUMNS, *_COUNTS, F.size("tcp_i_payload_list").alias("i_payloads"), F.size("tcp_o_payload_list").alias("o_payloads"))


def _three(column: str, names: tuple[str, str, str], kind: str) -> str:
    return ", ".join(f"CAST(sum({column}) {f} AS {kind}) AS {n}" for n, f in zip(names, ("", "FILTER (NOT isout)", "FILTER (isout)"), strict=True))


def _prefix(f: str, name: str) -> str:
    low, high = f"min(path) FILTER ({f})", f"max(path) FILTER ({f})"
    return f"CASE WHEN {low} IS NULL THEN NULL ELSE substr({low}, 1, coalesce(list_min(list_filter(range(1, 1 + least(length({low}), length({high}))), lambda i: substr({low}, i, 1) <> substr({high}, i, 1))) - 1, least(length({low}), length({high})))) END AS {name}"


_FULL_SQL = _SESSION_SQL.format(gap=GAP) + f"""SELECT min(t) AS session_time, CAST(CAST(max(t) - min(t) AS FLOAT) AS DOUBLE) AS session_duration,
  array_to_string(list_transform(list_sort(list(t)), lambda x: CAST(CAST(round(x * 1000) AS BIGINT) AS VARCHAR)), ',') AS times,
  arg_min(CASE WHEN isout THEN ip_dst ELSE ip_src END, struct_pack(a := t, b := event_id)) AS ip_src, arg_min(CASE WHEN isout THEN ip_src ELSE ip_dst END, struct_pack(a := t, b := event_id)) AS ip_dst, ip_proto,
  CASE WHEN ip_proto = '6' THEN arg_min(CASE WHEN isout THEN dport ELSE sport END, struct_pack(a := t, b := event_id)) END AS tcp_srcport, CASE WHEN ip_proto = '6' THEN arg_min(CASE WHEN isout THEN sport ELSE dport END, struct_pack(a := t, b := event_id)) END AS tcp_dstport,
  CASE WHEN ip_proto = '17' THEN arg_min(CASE WHEN isout THEN dport ELSE sport END, struct_pack(a := t, b := event_id)) END AS udp_srcport, CASE WHEN ip_proto = '17' THEN arg_min(CASE WHEN isout THEN sport ELSE dport END, struct_pack(a := t, b := event_id)) END AS udp_dstport,
  min(country) AS country, min(domain) AS domain, min(isp) AS isp, {_prefix("NOT isout", "frame_i_common_protocols")}, {_prefix("isout", "frame_o_common_protocols")},
  arg_max(path, struct_pack(a := length(path), b := -t)) FILTER (NOT isout) AS frame_i_max_protocols, arg_max(path, struct_pack(a := length(path), b := -t)) FILTER (isout) AS frame_o_max_protocols,
  CAST(count(*) AS INT) AS session_tt_packet, CAST(count(*) FILTER (NOT isout) AS INT) AS session_i_tt_packet, CAST(count(*) FILTER (isout) AS INT) AS session_o_tt_packet,
  {_three("frame_len", ("session_tt_frame_length", "session_i_tt_frame_length", "session_o_tt_frame_length"), "BIGINT")}, {_three("udp_length", ("udp_tt_length", "udp_i_tt_length", "udp_o_tt_length"), "INT")},
  avg(udp_length) FILTER (NOT isout) AS udp_i_avg_length, avg(udp_length) FILTER (isout) AS udp_o_avg_length, CAST(sum(tcp_hdr_len) AS BIGINT) AS tcp_hdr_len_sum,
  {_three("tcp_len", ("tcp_tt_payload_length", "tcp_i_tt_payload_length", "tcp_o_tt_payload_length"), "INT")}, avg(tcp_len) FILTER (NOT isout) AS tcp_i_avg_payload_length, avg(tcp_len) FILTER (isout) AS tcp_o_avg_payload_length,
  CAST(count(*) FILTER (NOT isout AND tcp) AS INT) AS i_payloads, CAST(count(*) FILTER (isout AND tcp) AS INT) AS o_payloads FROM marked {_BY}"""  # fmt: skip


def inbound_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = S.inbound(S.sessions(packets(spark, d), GAP), "i")
    return kept.select("ip_src", "ip_dst", "session_time", "session_i_tt_packet", "session_i_tt_frame_length")


_INBOUND_SQL = f"""SELECT ip_src, ip_dst, session_time, session_i_tt_packet, session_i_tt_frame_length FROM ({_FULL_SQL}) WHERE session_duration > CAST(CAST(0.1 AS FLOAT) AS DOUBLE) AND session_i_tt_packet > 1 AND session_i_tt_frame_length > 0 AND i_payloads > 0
  AND (coalesce(tcp_i_tt_payload_length > 0, false) OR coalesce(udp_i_tt_length > 0, false) OR coalesce(session_i_tt_frame_length > 0, false))"""


def crawler_filter(spark: SparkSession, d: str) -> DataFrame:
    return S.without_crawler(packets(spark, d), "d1", "isp1").groupBy("domain", "isp").agg(F.count("*").alias("packets"))


def proto_filter(spark: SparkSession, d: str) -> DataFrame:
    """Sessions per protocol that both directions' longest paths name."""
    full = S.sessions(packets(spark, d), GAP).select("frame_i_max_protocols", "frame_o_max_protocols")
    named = full.withColumn("proto", F.explode(F.array(*map(F.lit, ("http", "data", "tcp", "udp")))))
    both = named.where(F.col("frame_i_max_protocols").contains(F.col("proto")) & F.col("frame_o_max_protocols").contains(F.col("proto")))
    return both.groupBy("proto").agg(F.count("*").alias("sessions"))


def _payload_rows(spark: SparkSession, d: str) -> DataFrame:
    """A user's inbound payloads in (legacy) order of their length as text."""
    rows = packets(spark, d).where("tcp_payload is not null and not isOutbound")
    ordered = rows.groupBy("ip_src").agg(F.array_sort(F.collect_list(F.struct(F.col("tcp_payload")[2].alias("len"), F.col("event_id").alias("id"), F.col("tcp_payload")[0].alias("hash")))).alias("items"))
    return ordered


def payload_explode(spark: SparkSession, d: str) -> DataFrame:
    out = _payload_rows(spark, d).select("ip_src", F.posexplode("items").alias("pos", "x"))
    return out.select("ip_src", "pos", F.split("x.hash", ":")[0].cast("int").alias("size"), "x.hash", "x.len")


_PAYLOADS = f"WITH {PACKETS_SQL}, p AS (SELECT ip_src, event_id AS id, CAST(frame_len AS VARCHAR) AS len, '3:' || event_type || ':x' AS hash FROM packets WHERE tcp AND NOT isout), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY ip_src ORDER BY len, id) - 1 AS INT) AS pos, count(*) OVER (PARTITION BY ip_src) AS n FROM p) "


def quartile_pick(spark: SparkSession, d: str) -> DataFrame:
    """Each address's payloads at the quartiles of its list: a position counts once, the last only behind four others."""
    listed = _payload_rows(spark, d).withColumn("n", F.size("items"))
    at = F.array_distinct(F.array(*(F.floor(F.col("n") * q).cast("int") for q in (0.25, 0.5, 0.75))))
    at = F.when(F.col("n") > 4, F.array_union(at, F.array(F.col("n") - 1))).otherwise(at)
    return listed.select("ip_src", F.explode(at).alias("pos"), "items").select("ip_src", "pos", F.element_at("items", F.col("pos") + 1)["len"].alias("len"))


def ip_long(spark: SparkSession, d: str) -> DataFrame:
    return packets(spark, d).groupBy("ip_src").agg(F.count("*").alias("n")).select("ip_src", ip_to_long(F.col("ip_src")).alias("number"), "n")


def cidr_inbound(spark: SparkSession, d: str) -> DataFrame:
    nets = spark.createDataFrame([("192.168.0.0/30",), ("10.0.1.0/24",)], "cidr string")
    lo, hi = cidr_range(F.col("cidr"))
    return S.containing(packets(spark, d), nets.select(lo.alias("lo"), hi.alias("hi")), "ip_dst").groupBy("inside", "isOutbound").agg(F.count("*").alias("n"))


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    """Address ranges of 64 users each, named after nations."""
    base = spark.read.parquet(f"{d}/nation.parquet").select((F.lit(167772160) + F.col("n_nationkey").cast("long") * 64).alias("lo"), "n_name")
    return base.select("lo", (F.col("lo") + 63).alias("hi"), F.col("n_name").alias("place"))


def geo_range_join(spark: SparkSession, d: str) -> DataFrame:
    return S.range_lookup(packets(spark, d), _ranges(spark, d), "ip_src", ["place"]).groupBy("place").agg(F.count("*").alias("n"), F.countDistinct("ip_src").alias("addresses"))


def geo_positions(spark: SparkSession, d: str) -> DataFrame:
    """Where addresses are on the map, as far as a range holds them."""
    ranges = _ranges(spark, d).withColumns({"lat": (F.col("lo") % 160 - 80).cast("double"), "lon": (F.col("lo") % 350 - 175).cast("double")})
    found = S.range_lookup(packets(spark, d).select("ip_src").distinct(), ranges, "ip_src", ["place", "lat", "lon"])
    return found.groupBy("place", "lat", "lon").agg(F.count("*").alias("addresses"))


def geo_databases(spark: SparkSession, d: str) -> DataFrame:
    """Packets by country, domain and provider of their source, from three tables of ranges that nest and overlap.

    Nations have ranges of 64 addresses; suppliers of 1 to 40 anywhere among them; regions wide ones, each inside the one before.
    """
    base, top = 167772160, 167772160 + 1600
    nations = spark.read.parquet(f"{d}/nation.parquet").select((F.lit(base) + F.col("n_nationkey").cast("long") * 64).alias("lo"), F.col("n_name").alias("country"))
    suppliers = spark.read.parquet(f"{d}/supplier.parquet").select((F.lit(base) + F.pmod(F.col("s_suppkey") * 37, F.lit(1500))).cast("long").alias("lo"), "s_suppkey", F.col("s_name").alias("domain"))
    regions = spark.read.parquet(f"{d}/region.parquet").select((F.lit(base) + F.col("r_regionkey").cast("long") * 100).alias("lo"), (F.lit(top) - F.col("r_regionkey").cast("long") * 150).alias("hi"), F.col("r_name").alias("provider"))
    cut = R.elementary([
        (nations.select("lo", (F.col("lo") + 63).alias("hi"), "country"), ["country"]),
        (suppliers.select("lo", (F.col("lo") + F.pmod("s_suppkey", F.lit(40))).alias("hi"), "domain"), ["domain"]), (regions, ["provider"]),
    ])
    found = R.located(packets(spark, d).drop("country", "domain"), cut, "ip_src", ["country", "domain", "provider"])
    return found.groupBy("country", "domain", "provider").agg(F.count("*").alias("packets"), F.countDistinct("ip_src").alias("addresses"))


def _innermost(name: str, table: str, lo: str, hi: str) -> str:
    """The answer of one table for each address: the range that begins last, of those the shortest, of those the least name."""
    return f"(SELECT ip_src, arg_min(v, struct_pack(a := -lo, b := hi, c := v)) AS {name} FROM a JOIN (SELECT {lo} AS lo, {hi} AS hi, {table[0]}_name AS v FROM {table}) ON n BETWEEN lo AND hi GROUP BY 1)"


_DATABASES_SQL = f"WITH {PACKETS_SQL}, a AS (SELECT DISTINCT ip_src, {_S} AS n FROM packets), q AS (SELECT p.ip_src, c.country AS country, s.domain AS domain, r.provider FROM packets p LEFT JOIN {_innermost('country', 'nation', '167772160 + CAST(n_nationkey AS BIGINT) * 64', '167772160 + CAST(n_nationkey AS BIGINT) * 64 + 63')} c USING (ip_src) LEFT JOIN {_innermost('domain', 'supplier', '167772160 + s_suppkey * 37 % 1500', '167772160 + s_suppkey * 37 % 1500 + s_suppkey % 40')} s USING (ip_src) LEFT JOIN {_innermost('provider', 'region', '167772160 + CAST(r_regionkey AS BIGINT) * 100', '167773760 - CAST(r_regionkey AS BIGINT) * 150')} r USING (ip_src)) SELECT country, domain, provider, count(*) AS packets, count(DISTINCT ip_src) AS addresses FROM q GROUP BY 1, 2, 3"

_GEO_SQL = f"WITH {PACKETS_SQL}, r AS (SELECT 167772160 + CAST(n_nationkey AS BIGINT) * 64 AS lo, n_name AS place FROM nation) SELECT place, count(*) AS n, count(DISTINCT ip_src) AS addresses FROM packets LEFT JOIN r ON {_S} BETWEEN lo AND lo + 63 GROUP BY place"


def file_range_join(spark: SparkSession, d: str) -> DataFrame:
    """Packets that each six-hour capture file may hold."""
    times = packets(spark, d).select(F.col("frame_time_epoch").alias("t"))
    files = times.select((F.floor(F.col("t") / 21600) * 21600).cast("double").alias("start")).distinct()
    return S.capture_files(times, files, 1.0).groupBy("start").agg(F.count("*").alias("packets"))


_FILE_SQL = f"WITH {PACKETS_SQL}, f AS (SELECT DISTINCT CAST(floor(t / 21600) * 21600 AS DOUBLE) AS start FROM packets), e AS (SELECT start, lead(start) OVER (ORDER BY start) + 1 AS fin FROM f) SELECT start, count(*) AS packets FROM packets JOIN e ON t > start AND (fin IS NULL OR t < fin) GROUP BY start"


def lcp_protocols(spark: SparkSession, d: str) -> DataFrame:
    by = packets(spark, d).groupBy("ip_src").agg(F.min("frame_protocols").alias("a"), F.max("frame_protocols").alias("b"), F.max_by("frame_protocols", F.struct(F.length("frame_protocols"), "frame_protocols")).alias("longest"))
    return by.select("ip_src", common_prefix(F.col("a"), F.col("b")).alias("common"), "longest")


_LCP_SQL = f"WITH {PACKETS_SQL}, m AS (SELECT ip_src, min(path) AS a, max(path) AS b, arg_max(path, struct_pack(n := length(path), p := path)) AS longest FROM packets GROUP BY 1) SELECT ip_src, substr(a, 1, coalesce(list_min(list_filter(range(1, 1 + least(length(a), length(b))), lambda i: substr(a, i, 1) <> substr(b, i, 1))) - 1, least(length(a), length(b)))) AS common, longest FROM m"


def hourly_grid(spark: SparkSession, d: str) -> DataFrame:
    """Packets of each protocol in every hour of the data, from the hour before, zeros included."""
    binned = packets(spark, d).select("ip_proto", F.floor(F.col("frame_time_epoch") / 3600).alias("hour")).groupBy("ip_proto", "hour").agg(F.count("*").alias("n"))
    span = binned.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).select(F.explode(F.sequence(F.col("a") - 1, F.col("b"))).alias("hour"))
    grid = span.crossJoin(F.broadcast(binned.select("ip_proto").distinct()))
    return grid.join(binned, ["ip_proto", "hour"], "left").select("ip_proto", "hour", F.coalesce("n", F.lit(0)).alias("n"))


_HOUR_SQL = f"WITH {PACKETS_SQL}, b AS (SELECT ip_proto, CAST(floor(t / 3600) AS BIGINT) AS hour, count(*) AS n FROM packets GROUP BY 1, 2), g AS (SELECT unnest(range(min(hour) - 1, max(hour) + 1)) AS hour FROM b) SELECT p.ip_proto, g.hour, coalesce(b.n, 0) AS n FROM g CROSS JOIN (SELECT DISTINCT ip_proto FROM b) p LEFT JOIN b ON b.ip_proto = p.ip_proto AND b.hour = g.hour"


def co_sort_lists(spark: SparkSession, d: str) -> DataFrame:
    """Times of each user with their countries and types in the same order."""
    by = packets(spark, d).groupBy("ip_src").agg(F.array_sort(F.collect_list(F.struct("frame_time_epoch", "event_id", "frame_protocols"))).alias("x"))
    return by.select("ip_src", F.array_join(F.transform("x", lambda v: v["event_id"].cast("string")), ",").alias("ids"), F.array_join(F.transform("x", lambda v: v["frame_protocols"]), ",").alias("paths"))


_COSORT_SQL = f"WITH {PACKETS_SQL} SELECT ip_src, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY t, event_id) AS ids, string_agg(path, ',' ORDER BY t, event_id) AS paths FROM packets GROUP BY 1"


def next_day_retry(spark: SparkSession, d: str) -> DataFrame:
    """Error times looked up among the same day's purchases of a user; what isn't found, on the next day."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    wanted, there = e.where("event_type = 'error'"), e.where("event_type = 'purchase'").select("user_id", "day").distinct()
    same = wanted.join(there, ["user_id", "day"], "left_semi").select("event_id", F.lit(0).alias("days_on"))
    rest = wanted.join(there, ["user_id", "day"], "left_anti").withColumn("day", F.date_add("day", 1)).join(there, ["user_id", "day"], "left_semi")
    return same.union(rest.select("event_id", F.lit(1)))


_RETRY_SQL = "WITH e AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day FROM events), w AS (SELECT * FROM e WHERE event_type = 'error'), p AS (SELECT DISTINCT user_id, day FROM e WHERE event_type = 'purchase'), s AS (SELECT event_id, CAST(0 AS INT) AS days_on FROM w SEMI JOIN p USING (user_id, day)), r AS (SELECT * FROM w ANTI JOIN p USING (user_id, day)) SELECT * FROM s UNION ALL SELECT event_id, CAST(1 AS INT) FROM r WHERE EXISTS (SELECT 1 FROM p WHERE p.user_id = r.user_id AND p.day = r.day + 1)"


def hex_decode(spark: SparkSession, d: str) -> DataFrame:
    """Page addresses as colon-separated hex, and back to text."""
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.regexp_replace(F.lower(F.hex(F.encode("url", "UTF-8"))), "(..)(?=.)", "$1:").alias("payload"))
    return pages.select("page_id", "payload", hex_text(F.col("payload")).alias("decoded"))


def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = packets(spark, d).select("event_id", F.struct("ip_src", "ip_dst", "frame_len").alias("x"))
    return rows.select("event_id", F.from_json(F.to_json("x"), "ip_src string, ip_dst string, frame_len int").alias("y")).select("event_id", "y.*")


def _partly_addressed(spark: SparkSession, d: str) -> DataFrame:
    """Packets of which short frames hold no address."""
    return packets(spark, d).withColumn("ip_src", F.when(F.col("frame_len") >= 28, F.col("ip_src")))


def addressed_packets(spark: SparkSession, d: str) -> DataFrame:
    return S.addressed(_partly_addressed(spark, d)).groupBy("ip_proto").agg(F.count("*").alias("packets"), F.sum("frame_len").alias("bytes"))


def _traps(spark: SparkSession) -> DataFrame:
    nets = spark.createDataFrame([("192.168.0.0/31",), ("10.0.1.0/24",)], "cidr string")
    lo, hi = cidr_range(F.col("cidr"))
    return nets.select(lo.alias("lo"), hi.alias("hi"))


def trap_direction(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with the direction that follows from the trap networks."""
    full = S.sessions(S.directed(packets(spark, d), _traps(spark)), GAP)
    return full.groupBy("ip_proto").agg(*(F.sum(c).cast("long").alias(n) for c, n in (("session_tt_packet", "packets"), ("session_i_tt_packet", "inbound"), ("session_o_tt_packet", "outbound"))), F.count("*").alias("sessions"))


def times_scan(spark: SparkSession, d: str) -> DataFrame:
    """Packets at exactly the times of those whose path ends in data, whoever sent them."""
    p = packets(spark, d)
    return S.at_times(p, p.where(F.col("frame_protocols").endswith("data")).select(F.col("frame_time_epoch").alias("t"))).groupBy("ip_proto", "frame_protocols").agg(F.count("*").alias("packets"))


def _first_packets(packets: DataFrame) -> DataFrame:
    """A capture file begins with each country's first packet."""
    return packets.groupBy("country").agg(F.min("frame_time_epoch").alias("start")).select("start")


def latest_file(spark: SparkSession, d: str) -> DataFrame:
    """Packets by the latest capture file that starts with or before them."""
    p = packets(spark, d)
    return S.latest_start(p.select(F.col("frame_time_epoch").alias("t")), _first_packets(p)).groupBy("start").agg(F.count("*").alias("packets"))


def nearest_file(spark: SparkSession, d: str) -> DataFrame:
    """Packets by the capture file that starts nearest to them, before or after, and the file before that."""
    p = packets(spark, d)
    files = p.where("event_id % 500 = 7").select(F.floor("frame_time_epoch").cast("double").alias("start"))
    return S.nearest_start(p.select(F.col("frame_time_epoch").alias("t")), files).groupBy("start", "previous").agg(F.count("*").alias("packets"))


def session_files(spark: SparkSession, d: str) -> DataFrame:
    """Capture files to read for each session of six hours' gap: the one it begins in, that before, and all that begin until it ends."""
    p = packets(spark, d)
    files = p.select((F.floor(F.col("frame_time_epoch") / 7200) * 7200).cast("double").alias("start")).distinct()
    return S.files_of(S.session_spans(p, GAP), files).groupBy("start").agg(F.count("*").alias("sessions"))


def path_fields(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", *S.path_parts(F.col("url")))


def session_icmp(spark: SparkSession, d: str) -> DataFrame:
    """Events that aren't TCP as ICMP: no ports, so the addresses alone make a conversation."""
    udp = packets(spark, d).where("ip_proto = '17'")
    none = F.lit(None).cast("int")
    icmp = udp.withColumns({"ip_proto": F.lit("1"), "udp_srcport": none, "udp_dstport": none, "icmp_length": F.col("udp_length"), "icmp_length_original_datagram": F.col("frame_len") - 28, "udp_length": none})
    return S.sessions(icmp, GAP).select("session_time", "ip_src", "ip_dst", "udp_tt_length", *_ICMP)


_ICMP = ["icmp_tt_length", "icmp_i_tt_length", "icmp_o_tt_length", "icmp_i_avg_length", "icmp_o_avg_length", "icmp_tt_original_datagram_length", "icmp_i_tt_datagram_length", "icmp_o_tt_datagram_length", "icmp_i_avg_datagram_length", "icmp_o_avg_datagram_length"]
_ICMP_SQL = f"""WITH {PACKETS_SQL}, keyed AS (SELECT *, udp_length AS l, frame_len - 28 AS o, CASE WHEN {_S} < {_D} THEN ip_src ELSE ip_dst END AS min_ip, CASE WHEN {_S} > {_D} THEN ip_src ELSE ip_dst END AS max_ip FROM packets WHERE NOT tcp),
gaps AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY min_ip, max_ip ORDER BY t) > {GAP} THEN 1 ELSE 0 END AS g FROM keyed), marked AS (SELECT *, sum(g) OVER (PARTITION BY min_ip, max_ip ORDER BY t) AS group_id FROM gaps)
SELECT min(t) AS session_time, arg_min(CASE WHEN isout THEN ip_dst ELSE ip_src END, struct_pack(a := t, b := event_id)) AS ip_src, arg_min(CASE WHEN isout THEN ip_src ELSE ip_dst END, struct_pack(a := t, b := event_id)) AS ip_dst, CAST(NULL AS INT) AS udp_tt_length,
  {_three("l", ("icmp_tt_length", "icmp_i_tt_length", "icmp_o_tt_length"), "INT")}, avg(l) FILTER (NOT isout) AS icmp_i_avg_length, avg(l) FILTER (isout) AS icmp_o_avg_length,
  {_three("o", ("icmp_tt_original_datagram_length", "icmp_i_tt_datagram_length", "icmp_o_tt_datagram_length"), "INT")}, avg(o) FILTER (NOT isout) AS icmp_i_avg_datagram_length, avg(o) FILTER (isout) AS icmp_o_avg_datagram_length
FROM marked GROUP BY min_ip, max_ip, group_id"""


def role_positions(spark: SparkSession, d: str) -> DataFrame:
    """Where users speak in each conversation, and how long what they say is."""
    turns = spark.read.parquet(f"{d}/conversations.parquet").where("conv_id is not null")
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    places = L.positions_of(F.col("x.role"), F.lit("user"))
    lengths = F.transform(L.gather(F.col("x.text"), places), lambda t: F.length(t))
    said = F.size(L.without_empty(F.col("x.text")))
    return listed.select("conv_id", F.array_join(F.transform(places, lambda i: i.cast("string")), ",").alias("places"), F.array_join(F.transform(lengths, lambda n: n.cast("string")), ",", "-").alias("lengths"), said.alias("said"))


_ROLES_SQL = """WITH c AS (SELECT conv_id, list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn, role, text) AS x FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
p AS (SELECT conv_id, x, list_filter(range(len(x)), lambda i: x[i + 1].role IS NOT DISTINCT FROM 'user') AS spots FROM c)
SELECT conv_id, array_to_string(spots, ',') AS places, array_to_string(list_transform(spots, lambda i: coalesce(CAST(length(x[i + 1].text) AS VARCHAR), '-')), ',') AS lengths, CAST(len(list_filter(x, lambda y: y.text IS NOT NULL AND length(y.text) > 0)) AS INT) AS said FROM p"""


def hour_labels(spark: SparkSession, d: str) -> DataFrame:
    """Events by the hour in words, and the hour's second again."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.concat_ws(" ", F.to_date("ts").cast("string"), F.hour("ts").cast("string")).alias("label"))
    return e.groupBy("label").agg(F.count("*").alias("n")).select("label", (L.hour_epoch(F.col("label")) - L.hour_epoch(F.lit("2000-01-01 0"))).alias("seconds"), "n")


def payload_order(spark: SparkSession, d: str) -> DataFrame:
    """Each address's inbound payload lengths in order as texts and as numbers."""
    p = packets(spark, d).where("tcp_payload is not null and not isOutbound").groupBy("ip_src").agg(F.array_sort(F.collect_list("tcp_payload")).alias("x"))
    return p.select("ip_src", *(F.array_join(F.transform(L.sorted_payloads(F.col("x"), legacy=old), lambda t: t[2]), ",").alias(n) for old, n in ((True, "as_text"), (False, "as_numbers"))))


def noise_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as clusters of payload bytes, and whether the first line of any holds a marker."""
    turns = spark.read.parquet(f"{d}/conversations.parquet").groupBy("conv_id").agg(F.collect_list(F.encode("text", "UTF-8")).alias("payloads"))
    return turns.select("conv_id", L.any_begins(F.col("payloads"), "tion ").alias("noise"))


def session_cases(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that analysts listed by day, protocol and time; what began after noon they listed a day early."""
    spans = S.with_session(packets(spark, d), GAP).groupBy(*S.KEYS, "group_id").agg(F.min("frame_time_epoch").alias("session_time"), F.count("*").alias("packets"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("session_time") / 86400).cast("int"))
    rows = spans.select(day.alias("date"), F.col("ip_proto").alias("proto"), "session_time", "packets")
    cases = rows.where("packets > 1").select(F.when(F.col("session_time") % 86400 >= 43200, F.date_sub("date", 1)).otherwise(F.col("date")).alias("date"), "proto", "session_time")
    return G.case_sessions(cases, rows).select(F.col("date").cast("string").alias("date"), "proto", "session_time", "days_on", "packets")


_CASES_SQL = _SESSION_SQL.format(gap=GAP) + f""", r AS (SELECT CAST(floor(min(t) / 86400) AS BIGINT) AS day, ip_proto AS proto, min(t) AS session_time, count(*) AS packets FROM marked {_BY}),
c AS (SELECT DISTINCT day - CASE WHEN session_time - day * 86400 >= 43200 THEN 1 ELSE 0 END AS day, proto, session_time FROM r WHERE packets > 1),
f AS (SELECT c.*, 0 AS days_on, packets FROM c JOIN r USING (day, proto, session_time) UNION ALL SELECT c.*, 1, packets FROM (SELECT * FROM c ANTI JOIN r USING (day, proto, session_time)) c JOIN r ON r.day = c.day + 1 AND r.proto = c.proto AND r.session_time = c.session_time)
SELECT CAST(DATE '1970-01-01' + CAST(day AS INT) AS VARCHAR) AS date, proto, session_time, CAST(days_on AS INT) AS days_on, packets FROM f"""


def intention_lists(spark: SparkSession, d: str) -> DataFrame:
    """Times, countries and places of packets in one order for each kind of path, a list for each day."""
    rows = packets(spark, d).select(F.col("frame_protocols").alias("intention"), F.col("frame_time_epoch").alias("time"), "country", F.concat_ws("/", F.lit("at"), "domain").alias("place"))
    found = G.ordered_lists(rows, ["intention"], ["country", "place"], 86400.0)
    return found.select("intention", F.col("span").alias("day"), F.array_join(F.transform("times", lambda t: F.round(t * 1000).cast("long").cast("string")), ",").alias("times"), F.array_join("country", ",").alias("countries"), F.array_join("place", ",").alias("places"))


_LISTS_SQL = f"WITH {PACKETS_SQL} SELECT path AS intention, CAST(floor(t / 86400) AS BIGINT) AS day, string_agg(CAST(CAST(round(t * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY t) AS times, string_agg(country, ',' ORDER BY t, country) AS countries, string_agg('at' || coalesce('/' || domain, ''), ',' ORDER BY t, 'at' || coalesce('/' || domain, '')) AS places FROM packets GROUP BY 1, 2"


def hour_stream(spark: SparkSession, d: str) -> DataFrame:
    """The hourly grid from a stream of three batches, the last of which holds much that is late."""
    folder = new_folder(spark)
    rows = packets(spark, d).select("ip_proto", "frame_time_epoch")
    for part in ("frame_time_epoch % 97 < 40", "frame_time_epoch % 97 >= 40 and frame_time_epoch % 2 < 1", "frame_time_epoch % 97 >= 40 and frame_time_epoch % 2 >= 1"):
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{folder}/packets")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/packets")
    hours.follow(source, f"{folder}/state", 86400.0).awaitTermination()
    return hours.hours(spark, f"{folder}/state", with_late=True)


def session_parts(spark: SparkSession, d: str) -> DataFrame:
    """Maps from addresses to their times for each country, in parts of at most 50 times, and read back."""
    parts = kept(G.in_parts(packets(spark, d), ["country"], "ip_src", "frame_time_epoch", 50))
    largest = parts.select(F.max(F.aggregate(F.map_values("entries"), F.lit(0), lambda a, x: a + F.size(x))).alias("largest"))
    rows = G.from_parts(parts, ["country"], "ip_src", "frame_time_epoch").groupBy("country", "ip_src").agg(F.count("*").alias("times"), F.min("frame_time_epoch").alias("first"), F.max("frame_time_epoch").alias("last"))
    return rows.crossJoin(F.broadcast(largest)).select("country", "ip_src", "times", "first", "last", (F.col("largest") <= 50).alias("bounded"))


#: Packets of a capture file, about: a file is read by one task.
FILE_PACKETS = 2000


def _captures(spark: SparkSession, d: str) -> tuple[str, int]:
    """Conversations as capture files of raw payloads, as many as packets need and how many that is, and one file that is broken."""
    folder = new_folder(spark)
    texts = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text")
    many = max(4, -(-texts.count() // FILE_PACKETS))
    raw = F.regexp_replace(F.lower(F.hex(F.encode("text", "UTF-8"))), "(..)(?=.)", "$1:")
    p = from_conversations(texts.withColumn("text", F.coalesce("text", F.lit("")))).drop("tcp_payload")
    keys = [(60 * F.col("turn")).cast("double"), F.concat(F.lit("10.1."), F.floor(F.col("conv_id") / 256).cast("string"), F.lit("."), F.pmod("conv_id", F.lit(256)).cast("string"))]
    payload = texts.where("text is not null").groupBy(keys[0].alias("frame_time_epoch"), keys[1].alias("ext")).agg(F.min(raw).alias("raw"))
    p = p.withColumn("ext", F.when(F.col("isOutbound"), F.col("ip_dst")).otherwise(F.col("ip_src"))).join(payload, ["frame_time_epoch", "ext"], "left")
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(F.col(c).cast("string")))
    fields = {"frame.len": "frame_len", "frame.protocols": "frame_protocols", "frame.time_epoch": "frame_time_epoch", "ip.src": "ip_src", "ip.dst": "ip_dst", "ip.proto": "ip_proto", "tcp.srcport": "tcp_srcport", "tcp.dstport": "tcp_dstport", "tcp.hdr_len": "tcp_hdr_len", "tcp.len": "tcp_len", "tcp.payload": "raw"}
    layers = F.struct("country", "domain", "isp", F.col("isOutbound").alias("isInternal"), *(one(c).alias(n) for n, c in fields.items()))
    record = F.to_json(F.struct(F.struct(layers.alias("layers")).alias("_source")))
    # A long conversation goes on in other files.
    files = p.groupBy(F.pmod(F.xxhash64("ext", F.floor(F.col("frame_time_epoch") / 6000)), F.lit(many)).alias("file")).agg(F.concat(F.lit("["), F.concat_ws(",\n", F.collect_list(record)), F.lit("]")).alias("value"))
    files.write.partitionBy("file").text(f"{folder}/captures")
    spark.createDataFrame([("[{\"_source\": {\"layers\"",)], "value string").coalesce(1).write.mode("append").text(f"{folder}/captures/file=broken")
    return folder, many


def capture_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Captures read file by file as a stream, twice, beside a broken one: packets, bytes and payloads of each protocol."""
    folder, many = _captures(spark, d)
    for _ in range(2):
        captures.ingest(spark, f"{folder}/captures", f"{folder}/stored", files_each=many // 2).awaitTermination()
    found = captures.packets(spark, f"{folder}/stored").groupBy("ip_proto").agg(F.count("*").alias("packets"), F.sum("frame_len").alias("bytes"), F.count("tcp_payload").alias("payloads"))
    return found.crossJoin(captures.quarantine(spark, f"{folder}/stored").agg(F.count("*").alias("broken")))


def capture_clusters(spark: SparkSession, d: str) -> DataFrame:
    """From captures with raw payloads to clusters of sessions whose inbound payloads look alike."""
    full = S.sessions(read_captures(spark, f"{_captures(spark, d)[0]}/captures/file=*[0-9]"), 120.0)
    part = F.struct(F.col("ip_proto").alias("proto"), F.lit("20200106").alias("date"))
    payloads = kept(S.payload_rows(full.withColumn("idx", ip_to_long(F.col("ip_src"))).withColumn("part", part), ["part", "idx"]))
    return C.leader_clusters(payloads).select("idx", "leader")


FOUND = {
    "noise_payloads": (noise_payloads, r"SELECT conv_id, coalesce(bool_or(regexp_matches(text, '^[^\n]*tion ')), false) AS noise FROM conversations GROUP BY 1"),
    "session_cases": (session_cases, _CASES_SQL),
    "intention_lists": (intention_lists, _LISTS_SQL),
    "hour_stream": (hour_stream, _HOUR_SQL),
    "session_parts": (session_parts, f"WITH {PACKETS_SQL} SELECT country, ip_src, count(*) AS times, min(t) AS first, max(t) AS last, true AS bounded FROM packets GROUP BY 1, 2"),
    "capture_ingest": (capture_ingest, "SELECT '6' AS ip_proto, count(*) AS packets, CAST(sum(40 + octet_length(encode(coalesce(text, '')))) AS BIGINT) AS bytes, count(text) AS payloads, CAST(1 AS BIGINT) AS broken FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL"),
    "capture_clusters": (capture_clusters, None),
    "addressed_packets": (addressed_packets, f"WITH {PACKETS_SQL} SELECT ip_proto, count(*) AS packets, CAST(sum(frame_len) AS BIGINT) AS bytes FROM packets WHERE frame_len >= 28 GROUP BY 1"),
    "trap_direction": (trap_direction, f"WITH {PACKETS_SQL.replace('packets AS (', 'plain AS (', 1)}, packets AS (SELECT * REPLACE (NOT (({_D}) BETWEEN 3232235520 AND 3232235521 OR ({_D}) BETWEEN 167772416 AND 167772671) AS isout) FROM plain), " + _SESSION_SQL.format(gap=GAP).split(", keyed AS", 1)[1].join(["keyed AS", ""]) + f", s AS (SELECT ip_proto, count(*) AS n, count(*) FILTER (NOT isout) AS i, count(*) FILTER (isout) AS o FROM marked {_BY}) SELECT ip_proto, CAST(sum(n) AS BIGINT) AS packets, CAST(sum(i) AS BIGINT) AS inbound, CAST(sum(o) AS BIGINT) AS outbound, count(*) AS sessions FROM s GROUP BY 1"),
    "times_scan": (times_scan, f"WITH {PACKETS_SQL} SELECT ip_proto, path AS frame_protocols, count(*) AS packets FROM packets WHERE t IN (SELECT t FROM packets WHERE ends_with(path, 'data')) GROUP BY 1, 2"),
    "latest_file": (latest_file, f"WITH {PACKETS_SQL}, f AS (SELECT DISTINCT min(t) AS start FROM packets GROUP BY country) SELECT start, count(*) AS packets FROM packets ASOF LEFT JOIN f ON t >= start GROUP BY 1"),
    "nearest_file": (nearest_file, f"WITH {PACKETS_SQL}, f AS (SELECT DISTINCT floor(t) AS start FROM packets WHERE event_id % 500 = 7), o AS (SELECT start, lag(start) OVER (ORDER BY start) AS previous FROM f), b AS (SELECT event_id, t, o.start AS s1, o.previous AS p1 FROM packets ASOF LEFT JOIN o ON t >= o.start), a AS (SELECT b.*, o.start AS s2, o.previous AS p2 FROM b ASOF LEFT JOIN o ON b.t <= o.start), n AS (SELECT *, s1 IS NULL OR (s2 IS NOT NULL AND s2 - t < t - s1) AS later FROM a) SELECT CASE WHEN later THEN s2 ELSE s1 END AS start, CASE WHEN later THEN p2 ELSE p1 END AS previous, count(*) AS packets FROM n GROUP BY 1, 2"),
    "session_files": (session_files, _SESSION_SQL.format(gap=GAP) + f", s AS (SELECT row_number() OVER () AS id, min(t) AS a, max(t) AS b FROM marked {_BY}), f AS (SELECT DISTINCT CAST(floor(t / 7200) * 7200 AS DOUBLE) AS start FROM packets), o AS (SELECT start, lag(start) OVER (ORDER BY start) AS previous FROM f), x AS (SELECT id, o.start, previous FROM s ASOF JOIN o ON s.a >= o.start), r AS (SELECT id, start FROM x UNION SELECT id, previous FROM x WHERE previous IS NOT NULL UNION SELECT id, start FROM s JOIN f ON start > a AND start <= b) SELECT start, count(*) AS sessions FROM r GROUP BY 1"),
    "path_fields": (path_fields, "SELECT page_id, string_split(url, '/')[-3] AS date, string_split(url, '/')[-2] AS isp, string_split(url, '/')[-1] AS file FROM pages"),
    "session_icmp": (session_icmp, _ICMP_SQL),
    "role_positions": (role_positions, _ROLES_SQL),
    "hour_labels": (hour_labels, "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) || ' ' || hour(ts) AS label, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) - 946684800 AS seconds, count(*) AS n FROM events GROUP BY 1, 2"),
    "payload_order": (payload_order, f"WITH {PACKETS_SQL} SELECT ip_src, string_agg(CAST(frame_len AS VARCHAR), ',' ORDER BY CAST(frame_len AS VARCHAR)) AS as_text, string_agg(CAST(frame_len AS VARCHAR), ',' ORDER BY frame_len) AS as_numbers FROM packets WHERE tcp AND NOT isout GROUP BY 1"),
    "sessions": sessionize(120.0),
    "sessions_6h": sessionize(GAP),
    "session_window": (session_window, _SESSION_SQL.format(gap=120.0) + f"SELECT ip_proto, min_ip, max_ip, packets, bytes FROM (SELECT ip_proto, min_ip, max_ip, count(*) AS packets, CAST(sum(frame_len) AS BIGINT) AS bytes FROM marked {_BY})"),
    "session_full": (session_full, _FULL_SQL),
    "inbound_filter": (inbound_filter, _INBOUND_SQL),
    "crawler_filter": (crawler_filter, f"WITH {PACKETS_SQL} SELECT domain, isp, count(*) AS packets FROM packets WHERE domain IS DISTINCT FROM 'd1' OR isp IS DISTINCT FROM 'isp1' GROUP BY 1, 2"),
    "proto_filter": (proto_filter, f"SELECT proto, count(*) AS sessions FROM ({_FULL_SQL}), (SELECT unnest(['http', 'data', 'tcp', 'udp']) AS proto) WHERE contains(frame_i_max_protocols, proto) AND contains(frame_o_max_protocols, proto) GROUP BY 1"),
    "payload_explode": (payload_explode, _PAYLOADS + "SELECT ip_src, pos, CAST(split_part(hash, ':', 1) AS INT) AS size, hash, len FROM o"),
    "quartile_pick": (quartile_pick, _PAYLOADS + "SELECT ip_src, pos, len FROM o WHERE pos IN (CAST(floor(n * 0.25) AS INT), CAST(floor(n * 0.5) AS INT), CAST(floor(n * 0.75) AS INT)) OR (n > 4 AND pos = n - 1)"),
    "ip_to_long": (ip_long, f"WITH {PACKETS_SQL} SELECT ip_src, {_S} AS number, count(*) AS n FROM packets GROUP BY 1, 2"),
    "cidr_inbound": (cidr_inbound, f"WITH {PACKETS_SQL} SELECT ({_D}) BETWEEN 3232235520 AND 3232235523 OR ({_D}) BETWEEN 167772416 AND 167772671 AS inside, isout AS \"isOutbound\", count(*) AS n FROM packets GROUP BY 1, 2"),
    "geo_range_join": (geo_range_join, _GEO_SQL),
    "geo_databases": (geo_databases, _DATABASES_SQL),
    "geo_positions": (geo_positions, f"WITH {PACKETS_SQL}, a AS (SELECT DISTINCT ip_src FROM packets), r AS (SELECT 167772160 + CAST(n_nationkey AS BIGINT) * 64 AS lo, n_name AS place FROM nation) SELECT place, CAST(lo % 160 - 80 AS DOUBLE) AS lat, CAST(lo % 350 - 175 AS DOUBLE) AS lon, count(*) AS addresses FROM a LEFT JOIN r ON {_S} BETWEEN lo AND lo + 63 GROUP BY 1, 2, 3"),
    "file_range_join": (file_range_join, _FILE_SQL),
    "lcp_protocols": (lcp_protocols, _LCP_SQL),
    "hourly_grid": (hourly_grid, _HOUR_SQL),
    "co_sort_lists": (co_sort_lists, _COSORT_SQL),
    "next_day_retry": (next_day_retry, _RETRY_SQL),
    "hex_decode": (hex_decode, "SELECT page_id, array_to_string(list_transform(range(0, length(hex(encode(url))) // 2), lambda i: lower(substr(hex(encode(url)), CAST(2 * i + 1 AS BIGINT), 2))), ':') AS payload, url AS decoded FROM pages"),
    "json_roundtrip": (json_roundtrip, f"WITH {PACKETS_SQL} SELECT event_id, ip_src, ip_dst, frame_len FROM packets"),
}
