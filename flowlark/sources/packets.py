"""Packets: decoded captures in JSON, and the event table read as packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlark.functions.fuzzy import fuzzy_hash
from flowlark.functions.lists import payload_triple

_TEXT = ["country", "domain", "isp"]
_FIELDS = ["frame.len", "frame.protocols", "frame.time_epoch", "ip.src", "ip.dst", "ip.proto", "tcp.srcport", "tcp.dstport", "tcp.hdr_len", "tcp.len", "tcp.payload", "udp.srcport", "udp.dstport", "udp.length", "icmp.length", "icmp.length.original_datagram"]
_INTS = {"frame.len", "tcp.srcport", "tcp.dstport", "tcp.hdr_len", "tcp.len", "udp.srcport", "udp.dstport", "udp.length", "icmp.length", "icmp.length.original_datagram"}

#: Decoded captures: every leaf is an array of texts, as a packet may hold several headers.
JSON_SCHEMA = T.StructType([T.StructField("_source", T.StructType([T.StructField("layers", T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXT] + [T.StructField("isInternal", T.BooleanType())] + [T.StructField(c, T.ArrayType(T.StringType())) for c in _FIELDS]
))]))])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Packets from multi-line JSON files below ``path``; the schema is given, never inferred."""
    return flatten(spark.read.schema(JSON_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).json(path))


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Packets from captures whose ``tcp.payload`` is still raw, as colon-separated hex: it becomes hash, time and length, as sessions keep it."""
    return hashed(flatten(spark.read.schema(JSON_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).json(path)))


def hashed(packets: DataFrame) -> DataFrame:
    """``flatten``ed packets with the fuzzy hash of their raw payload, its packet's time and length as texts; null without a payload.

    A packet whose time or length is missing keeps its hash, with null there.  The hash is of the hex text, as it stands.
    """
    raw = F.get("tcp_payload", F.lit(0))
    triple = payload_triple(fuzzy_hash(raw), F.col("frame_time_epoch"), F.col("tcp_len"))
    return packets.withColumn("tcp_payload", F.when(raw.isNotNull(), triple))


def flatten(raw: DataFrame) -> DataFrame:
    """One row per packet: of each array the first value, which is the outermost header's."""

    def first(name: str):
        value = F.get(F.col(f"`{name}`"), F.lit(0))
        return value.try_cast("int") if name in _INTS else value.try_cast("double") if name == "frame.time_epoch" else value

    flat = raw.select("_source.layers.*")
    plain = [F.col(c) for c in _TEXT] + [F.col("isInternal").alias("isOutbound")]
    return flat.select(*plain, *(F.col(f"`{c}`").alias("tcp_payload") if c == "tcp.payload" else first(c).alias(c.replace(".", "_")) for c in _FIELDS))


def from_events(events: DataFrame) -> DataFrame:
    """The event table as packets between a user's address and four trap addresses."""
    k = F.get_json_object("props", "$.k").cast("int")
    user, tcp = F.col("user_id"), F.pmod(k, F.lit(2)) == 0
    out = F.col("event_type").isin("error", "signup")
    ext = F.concat(F.lit("10.0."), F.floor(user / 256).cast("string"), F.lit("."), F.pmod(user, F.lit(256)).cast("string"))
    trap = F.concat(F.lit("192.168.0."), F.pmod("event_id", F.lit(4)).cast("string"))
    ext_port, trap_port = (1024 + F.pmod(k, F.lit(5))).cast("int"), (80 + F.pmod(F.col("event_id"), F.lit(2))).cast("int")
    size = F.floor("value").cast("int")
    src_port, dst_port = F.when(out, trap_port).otherwise(ext_port), F.when(out, ext_port).otherwise(trap_port)
    return events.select(
        "event_id",
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) / 1e6d").alias("frame_time_epoch"),
        out.alias("isOutbound"), F.when(out, trap).otherwise(ext).alias("ip_src"), F.when(out, ext).otherwise(trap).alias("ip_dst"),
        F.when(tcp, "6").otherwise("17").alias("ip_proto"),
        F.when(tcp, src_port).alias("tcp_srcport"), F.when(tcp, dst_port).alias("tcp_dstport"),
        F.when(~tcp, src_port).alias("udp_srcport"), F.when(~tcp, dst_port).alias("udp_dstport"),
        size.alias("frame_len"), F.when(tcp, size - 40).alias("tcp_len"), F.when(tcp, F.lit(20)).alias("tcp_hdr_len"), F.when(~tcp, size - 8).alias("udp_length"),
        F.lit(None).cast("int").alias("icmp_length"), F.lit(None).cast("int").alias("icmp_length_original_datagram"),
        F.when(tcp, F.array(F.concat(F.lit("3:"), F.col("event_type"), F.lit(":x")), F.col("event_id").cast("string"), size.cast("string"))).alias("tcp_payload"),
        F.concat(F.lit("eth:ip:"), F.when(tcp, "tcp").otherwise("udp"), F.when(F.col("event_type") == "click", ":http").when(F.col("event_type") == "view", ":http:data").otherwise("")).alias("frame_protocols"),
        F.concat(F.lit("C"), F.pmod(user, F.lit(7)).cast("string")).alias("country"),
        F.when(F.pmod(user, F.lit(5)) > 0, F.concat(F.lit("d"), F.pmod(user, F.lit(5)).cast("string"))).alias("domain"),
        F.when(F.pmod(user, F.lit(3)) > 0, F.concat(F.lit("isp"), F.pmod(user, F.lit(3)).cast("string"))).alias("isp"),
    )


def from_conversations(turns: DataFrame) -> DataFrame:
    """Conversations as packets: a turn a minute, users outside, each text a payload told by its fuzzy hash."""
    user = F.col("role") == "user"
    ext = F.concat(F.lit("10.1."), F.floor(F.col("conv_id") / 256).cast("string"), F.lit("."), F.pmod("conv_id", F.lit(256)).cast("string"))
    size, time = F.octet_length("text").cast("int"), (F.col("turn") * 60).cast("double")
    none = F.lit(None).cast("int")
    return turns.where("conv_id is not null and turn is not null").select(
        time.alias("frame_time_epoch"), (~user).alias("isOutbound"), F.when(user, ext).otherwise("192.168.1.1").alias("ip_src"), F.when(user, "192.168.1.1").otherwise(ext).alias("ip_dst"),
        F.lit("6").alias("ip_proto"), F.when(user, 40000).otherwise(443).alias("tcp_srcport"), F.when(user, 443).otherwise(40000).alias("tcp_dstport"), none.alias("udp_srcport"), none.alias("udp_dstport"),
        (size + 40).alias("frame_len"), size.alias("tcp_len"), F.lit(20).alias("tcp_hdr_len"), none.alias("udp_length"), none.alias("icmp_length"), none.alias("icmp_length_original_datagram"),
        payload_triple(fuzzy_hash("text"), time, size).alias("tcp_payload"), F.lit("eth:ip:tcp:data").alias("frame_protocols"), F.lit("C0").alias("country"), F.lit("d0").alias("domain"), F.lit("isp0").alias("isp"),
    )


#: The same adapter for DuckDB.
PACKETS_SQL = """packets AS (
  SELECT event_id, epoch_us(ts) / 1e6 AS t, isout, CASE WHEN isout THEN trap ELSE ext END AS ip_src, CASE WHEN isout THEN ext ELSE trap END AS ip_dst,
    CASE WHEN tcp THEN '6' ELSE '17' END AS ip_proto, CASE WHEN isout THEN tport ELSE eport END AS sport, CASE WHEN isout THEN eport ELSE tport END AS dport, tcp,
    size AS frame_len, CASE WHEN tcp THEN size - 40 END AS tcp_len, CASE WHEN tcp THEN 20 END AS tcp_hdr_len, CASE WHEN NOT tcp THEN size - 8 END AS udp_length,
    'eth:ip:' || CASE WHEN tcp THEN 'tcp' ELSE 'udp' END || CASE event_type WHEN 'click' THEN ':http' WHEN 'view' THEN ':http:data' ELSE '' END AS path,
    event_type, 'C' || (user_id % 7) AS country, CASE WHEN user_id % 5 > 0 THEN 'd' || (user_id % 5) END AS domain, CASE WHEN user_id % 3 > 0 THEN 'isp' || (user_id % 3) END AS isp, user_id
  FROM (SELECT *, event_type IN ('error', 'signup') AS isout, k % 2 = 0 AS tcp, '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS ext, '192.168.0.' || (event_id % 4) AS trap,
          CAST(1024 + k % 5 AS INT) AS eport, CAST(80 + event_id % 2 AS INT) AS tport, CAST(floor(value) AS INT) AS size
        FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)))"""
