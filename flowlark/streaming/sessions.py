"""Sessions by Spark's session windows: the same code for tables and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlark.functions.net import higher_ip, lower_ip
from flowlark.operators.sessions import KEYS


def session_windows(packets: DataFrame, gap: str = "120 seconds", late: str | None = None) -> DataFrame:
    """Packets and bytes of each conversation's sessions; ``late`` sets a stream's watermark.

    Times are shifted by a microsecond's width of nothing: a gap of exactly ``gap``
    stays in one session.  Packets without a time are left out.
    """
    tcp = F.col("tcp_srcport").isNotNull()
    keyed = packets.select(
        F.timestamp_micros(F.round(F.col("frame_time_epoch") * 1e6).cast("long")).alias("ts"), "ip_proto", "frame_len",
        lower_ip(F.col("ip_src"), F.col("ip_dst")).alias("min_ip"), higher_ip(F.col("ip_src"), F.col("ip_dst")).alias("max_ip"),
        F.when(tcp, F.least("tcp_srcport", "tcp_dstport")).otherwise(F.least("udp_srcport", "udp_dstport")).alias("min_port"),
        F.when(tcp, F.greatest("tcp_srcport", "tcp_dstport")).otherwise(F.greatest("udp_srcport", "udp_dstport")).alias("max_port"),
    )
    if late:
        keyed = keyed.withWatermark("ts", late)
    return keyed.groupBy(*KEYS, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("packets"), F.sum("frame_len").alias("bytes")).select(*KEYS, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "packets", "bytes")
