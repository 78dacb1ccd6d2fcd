"""Packets to bidirectional sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlark.functions.lists import sorted_payloads
from flowlark.functions.net import common_prefix, higher_ip, ip_to_long, lower_ip
from flowlark.operators.asof import asof, previous_starts
from flowlark.operators.scratch import kept

KEYS = ["min_ip", "max_ip", "min_port", "max_port", "ip_proto"]


def with_keys(packets: DataFrame) -> DataFrame:
    """Packets with their conversation's keys; both directions are one."""
    tcp = F.col("tcp_srcport").isNotNull()
    src, dst = F.col("ip_src"), F.col("ip_dst")
    return packets.withColumns({
        "min_ip": lower_ip(src, dst), "max_ip": higher_ip(src, dst),
        "min_port": F.when(tcp, F.least("tcp_srcport", "tcp_dstport")).otherwise(F.least("udp_srcport", "udp_dstport")),
        "max_port": F.when(tcp, F.greatest("tcp_srcport", "tcp_dstport")).otherwise(F.greatest("udp_srcport", "udp_dstport")),
    })


def _numbered(packets: DataFrame, gap: float) -> tuple[DataFrame, DataFrame]:
    """Packets with their keys and ``_span``; and ``(*KEYS, _span, _first, _last, group_id)`` of these spans."""
    # A gap of 0 parts any two times.
    span = F.floor(F.col("frame_time_epoch") / (gap / 2)).cast("double") if gap > 0 else F.col("frame_time_epoch")
    keyed = with_keys(packets).withColumn("_span", span)
    spans = keyed.groupBy(*KEYS, "_span").agg(F.min("frame_time_epoch").alias("_first"), F.max("frame_time_epoch").alias("_last"))
    order = Window.partitionBy(*KEYS).orderBy("_span")
    apart = F.when(F.col("_first") - F.lag("_last").over(order) > gap, 1).otherwise(0)
    return keyed, spans.withColumn("_apart", apart).withColumn("group_id", F.sum("_apart").over(order))


def session_spans(packets: DataFrame, gap: float = 120.0) -> DataFrame:
    """``(*KEYS, group_id, first, last)``: from when to when each session of ``with_session`` lasts; packets don't have to be told theirs for that."""
    return _numbered(packets, gap)[1].groupBy(*KEYS, "group_id").agg(F.min("_first").alias("first"), F.max("_last").alias("last"))


def with_session(packets: DataFrame, gap: float = 120.0) -> DataFrame:
    """Packets with their conversation's keys and ``group_id``: how many gaps of more than ``gap`` seconds came before.

    Packets at one instant share a session; those without a time belong to the first.  No two packets within a span of half a gap
    are in different sessions, so spans, not packets, are put in order: each carries its first and last time, a conversation's spans
    are numbered, and packets take the number of theirs.  A conversation of very many packets is thus spread over its spans.
    """
    keyed, numbered = _numbered(packets, gap)
    names = [*KEYS, "_span"]
    numbered = numbered.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(names)), "group_id")
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(names)]
    return keyed.join(numbered, same, "left").drop("_span", *(f"_k{i}" for i in range(len(names))))


def sessions(packets: DataFrame, gap: float = 120.0) -> DataFrame:
    """One row of 46 columns per session (totals, inbound and outbound parts, endpoints, paths, payloads).

    Packets without both addresses belong to none.  Inbound and outbound parts without packets are null sums, 0 counts and empty
    lists.  Endpoints are those of the first packet, the outer side as source.
    """
    t, out = F.col("frame_time_epoch"), F.col("isOutbound")

    def when_in(c) -> Column:
        return F.when(~out, c)

    def when_out(c) -> Column:
        return F.when(out, c)

    def three(column: str, names: tuple[str, str, str], kind: str) -> list[Column]:
        return [F.sum(x).cast(kind).alias(n) for x, n in zip((F.col(column), when_in(F.col(column)), when_out(F.col(column))), names, strict=True)]

    def averages(column: str, names: tuple[str, str]) -> list[Column]:
        return [F.avg(when_in(F.col(column))).alias(names[0]), F.avg(when_out(F.col(column))).alias(names[1])]

    # The first packet; of packets at one time the least by id, where there is one, and by all that is asked of it.
    asked = ["ip_src", "ip_dst", "tcp_srcport", "tcp_dstport", "udp_srcport", "udp_dstport", "country", "domain", "isp", "isOutbound"]
    earliest = F.min(F.struct(t.isNull(), t, *(["event_id"] if "event_id" in packets.columns else []), *asked))

    def first(name: str) -> Column:
        return earliest[name]

    def side(a: str, b: str) -> Column:
        return F.when(first("isOutbound"), first(b)).otherwise(first(a))

    def path(when) -> list[Column]:
        p = when(F.col("frame_protocols"))
        return [common_prefix(F.min(p), F.max(p)), F.max_by(p, F.when(p.isNotNull(), F.struct(F.length(p), -t)))]

    def payloads(when) -> Column:
        items = F.array_sort(F.collect_list(F.when(F.col("tcp_payload").isNotNull(), when(F.struct(t, F.col("tcp_payload").alias("p"))))))
        return F.transform(items, lambda x: x["p"])

    (in_common, in_longest), (out_common, out_longest) = path(when_in), path(when_out)
    grouped = with_session(addressed(packets), gap).groupBy(*KEYS, "group_id").agg(
        F.min(t).alias("session_time"), F.sort_array(F.collect_list(t)).alias("session_time_list"), (F.max(t) - F.min(t)).cast("float").alias("session_duration"),
        F.count("ip_src").cast("int").alias("session_tt_packet"), F.count(when_in(F.col("ip_src"))).cast("int").alias("session_i_tt_packet"), F.count(when_out(F.col("ip_src"))).cast("int").alias("session_o_tt_packet"),
        *three("frame_len", ("session_tt_frame_length", "session_i_tt_frame_length", "session_o_tt_frame_length"), "long"),
        *three("udp_length", ("udp_tt_length", "udp_i_tt_length", "udp_o_tt_length"), "int"), *averages("udp_length", ("udp_i_avg_length", "udp_o_avg_length")),
        *three("icmp_length", ("icmp_tt_length", "icmp_i_tt_length", "icmp_o_tt_length"), "int"), *averages("icmp_length", ("icmp_i_avg_length", "icmp_o_avg_length")),
        *three("icmp_length_original_datagram", ("icmp_tt_original_datagram_length", "icmp_i_tt_datagram_length", "icmp_o_tt_datagram_length"), "int"),
        *averages("icmp_length_original_datagram", ("icmp_i_avg_datagram_length", "icmp_o_avg_datagram_length")),
        F.sum("tcp_hdr_len").alias("tcp_hdr_len_sum"),
        *three("tcp_len", ("tcp_tt_payload_length", "tcp_i_tt_payload_length", "tcp_o_tt_payload_length"), "int"), *averages("tcp_len", ("tcp_i_avg_payload_length", "tcp_o_avg_payload_length")),
        side("ip_src", "ip_dst").alias("ip_src"), side("ip_dst", "ip_src").alias("ip_dst"),
        side("tcp_srcport", "tcp_dstport").alias("tcp_srcport"), side("tcp_dstport", "tcp_srcport").alias("tcp_dstport"),
        side("udp_srcport", "udp_dstport").alias("udp_srcport"), side("udp_dstport", "udp_srcport").alias("udp_dstport"),
        *(first(c).alias(c) for c in ("country", "domain", "isp")),
        in_common.alias("frame_i_common_protocols"), out_common.alias("frame_o_common_protocols"), in_longest.alias("frame_i_max_protocols"), out_longest.alias("frame_o_max_protocols"),
        payloads(when_in).alias("tcp_i_payload_list"), payloads(when_out).alias("tcp_o_payload_list"),
    )
    return grouped.drop("min_ip", "max_ip", "min_port", "max_port", "group_id")


def inbound(sessions_: DataFrame, side: str = "i") -> DataFrame:
    """Sessions with payloads in one direction (``i`` or ``o``): longer than 0.1 s, several packets, some bytes."""
    some = F.lit(False)
    for c in (f"tcp_{side}_tt_payload_length", f"udp_{side}_tt_length", f"icmp_{side}_tt_length", f"icmp_{side}_tt_datagram_length", f"session_{side}_tt_frame_length"):
        some = some | F.coalesce(F.col(c) > 0, F.lit(False))
    return sessions_.where((F.col("session_duration") > 0.1) & (F.col(f"session_{side}_tt_packet") > 1) & (F.col(f"session_{side}_tt_frame_length") > 0) & (F.size(f"tcp_{side}_payload_list") > 0) & some)


def without_crawler(rows: DataFrame, domain: str, isp: str) -> DataFrame:
    """All rows but those of both this domain and this provider; nulls count as others."""
    return rows.where(~F.col("domain").eqNullSafe(domain) | ~F.col("isp").eqNullSafe(isp))


def addressed(packets: DataFrame) -> DataFrame:
    """Packets with both addresses as IPv4; the others (none, or IPv6) belong to no conversation."""
    return packets.where(ip_to_long(F.col("ip_src")).isNotNull() & ip_to_long(F.col("ip_dst")).isNotNull())


def containing(packets: DataFrame, networks: DataFrame, ip: str) -> DataFrame:
    """Packets with ``inside``: whether ``ip`` lies in any range of ``networks(lo, hi)``; null without an address.

    A range join on distinct addresses, for any number of networks.
    """
    found = range_lookup(packets, networks.select("lo", "hi", F.lit(True).alias("inside")), ip, ["inside"])
    return found.withColumn("inside", F.when(F.col(ip).isNotNull(), F.coalesce("inside", F.lit(False))))


def directed(packets: DataFrame, traps: DataFrame) -> DataFrame:
    """Packets with ``isOutbound``: false if they go to one of the networks ``traps(lo, hi)``, else true; those without a destination are left out."""
    flagged = containing(packets.drop("isOutbound", "inside").where(F.col("ip_dst").isNotNull()), traps, "ip_dst")
    return flagged.withColumn("isOutbound", ~F.col("inside")).drop("inside")


def at_times(packets: DataFrame, times: DataFrame) -> DataFrame:
    """Packets at exactly one of the times ``t``; each once."""
    return packets.join(times.select(F.col("t").alias("_t")).distinct(), F.col("frame_time_epoch") == F.col("_t"), "left_semi")


def range_lookup(rows: DataFrame, ranges: DataFrame, ip: str, columns: list[str]) -> DataFrame:
    """Left join of each address with the range ``(lo, hi)`` that holds it, if any.

    Ranges are split by /16 prefix, so the join is an equi-join with a residual
    condition, and each distinct address is looked up once.
    """
    number = ip_to_long(F.col(ip))
    distinct = rows.select(ip).where(F.col(ip).isNotNull()).distinct().select(F.col(ip).alias("_ip"), number.alias("_n"))
    parts = ranges.select("lo", "hi", *columns, F.explode(F.sequence(F.shiftright("lo", 16), F.shiftright("hi", 16))).alias("_p"))
    found = distinct.withColumn("_p", F.shiftright("_n", 16)).join(parts, "_p").where("_n between lo and hi")
    found = found.groupBy("_ip").agg(F.min_by(F.struct(*columns), "lo").alias("_x")).select("_ip", "_x.*")
    return rows.join(found, F.col(ip) == F.col("_ip"), "left").drop("_ip")


def capture_files(times: DataFrame, files: DataFrame, overlap: float = 1.0) -> DataFrame:
    """``(t, start)``: the files that may hold each time; a file reaches ``overlap`` seconds into the next, the last one as far as times go."""
    return times.select("t").join(asof(times, files, "overlap", overlap), "t")


def latest_start(times: DataFrame, files: DataFrame) -> DataFrame:
    """``(t, start)``: the latest start that isn't after each time; null before the first file and without a time."""
    return times.join(asof(times, files, "floor"), "t", "left")


def nearest_start(times: DataFrame, files: DataFrame) -> DataFrame:
    """``(t, start, previous)``: the start that is nearest to each time, before or after it, of two the earlier, and the one before that.

    The first start has none before it.
    """
    return times.join(asof(times, files, "nearest"), "t", "left")


def files_of(spans: DataFrame, files: DataFrame) -> DataFrame:
    """``(*spans, start)``: the files to read for all packets from ``first`` to ``last``: the latest that begins by then, its predecessor, all that begin until the end.

    No file is two of these, so nothing has to be made distinct. Spans and starts are written once, as several steps read them.
    """
    columns, spans = spans.columns, kept(spans)
    starts = kept(files.select(F.col("start").cast("double").alias("start")).where("start is not null").distinct())
    back = kept(previous_starts(starts))
    begun = asof(spans.select(F.col("first").alias("t")), starts, "floor").join(back, "start").select(F.col("t").alias("first"), F.array("start", "previous").alias("_starts"))
    both = spans.join(begun, "first").select(*columns, F.explode("_starts").alias("start")).where("start is not null")
    return both.unionByName(_starts_within(spans, starts))


def _starts_within(spans: DataFrame, starts: DataFrame) -> DataFrame:
    """``(*spans, start)`` of starts after ``first`` and not after ``last``, by hours that both touch."""
    hours = spans.where("first < last").withColumn("_h", F.explode(F.sequence(F.floor(F.col("first") / 3600), F.floor(F.col("last") / 3600))))
    found = hours.join(starts.withColumn("_h", F.floor(F.col("start") / 3600)), "_h")
    return found.where("start > first and start <= last").select(*spans.columns, "start")


def path_parts(path: Column) -> list[Column]:
    """``date``, ``isp``, ``file`` of a capture's path ``.../date/isp/file``; null where there are too few parts."""
    parts = F.split(path, "/")
    return [F.try_element_at(parts, F.lit(i)).alias(name) for i, name in ((-3, "date"), (-2, "isp"), (-1, "file"))]


def payload_rows(sessions_: DataFrame, keys: list[str], side: str = "i") -> DataFrame:
    """``(*keys, pos, size, hash)``: the payloads of each session in one direction, in order of their length as text; ``size`` is the hash's block size.

    Packets without a hash and sessions without payloads give no rows.
    """
    listed = sessions_.select(*keys, sorted_payloads(F.col(f"tcp_{side}_payload_list")).alias("_items"))
    return listed.select(*keys, F.posexplode("_items").alias("pos", "_x")).where("_x[0] is not null").select(*keys, "pos", F.split(F.col("_x")[0], ":")[0].try_cast("int").alias("size"), F.col("_x")[0].alias("hash"))
