"""Queries on groups of addresses, their sessions, and loners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlark.operators import behaviour as B
from flowlark.operators import groups as G
from flowlark.operators import report
from flowlark.operators.scratch import forget, kept
from flowlark.plans.behaviour_queries import _PRUNED, _SIZES, _UEDGES, user_edges
from flowlark.plans.session_queries import packets
from flowlark.sources.packets import PACKETS_SQL

THRESHOLD = 0.5
#: An example of what an analyst knows of some clusters.
INTENTIONS = [("buying", ["purchase"]), ("entering", ["signup"])]
ALIASES = {"isp1": "north", "isp2": "south"}


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Events as sessions of users; what they did at which hour of the day is the cluster."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(
        F.col("user_id").alias("ip"), F.concat_ws("_", "event_type", F.hour("ts").cast("string")).alias("cluster"), F.col("event_type").alias("proto"),
        F.concat(F.lit("C"), F.pmod("user_id", F.lit(7)).cast("string")).alias("country"), F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("time"),
    )


def _all(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The retained edges and the groups of their addresses, both written tables as several steps read them."""
    edges = B.prune(sessions(spark, d))
    return edges, B.groups(edges, THRESHOLD)


def _members(spark: SparkSession, d: str) -> DataFrame:
    edges, groups = _all(spark, d)
    found = G.retained(sessions(spark, d), edges).join(kept(G.grouped(groups)), "ip")
    forget(edges, groups)
    return found


#: Going down the order, each address that isn't taken takes those near it.
_WALK = f"""WITH RECURSIVE {_UEDGES}, {_PRUNED}, {_SIZES}, o AS MATERIALIZED (SELECT ip, row_number() OVER (ORDER BY n DESC, ip) AS r FROM n),
close AS MATERIALIZED (SELECT x.r AS r, y.r AS q FROM (SELECT a, b FROM pairs WHERE score > {THRESHOLD} UNION ALL SELECT b, a FROM pairs WHERE score > {THRESHOLD}) p JOIN o x ON x.ip = p.a JOIN o y ON y.ip = p.b),
lists AS MATERIALIZED (SELECT o.r, coalesce(list(q) FILTER (q IS NOT NULL), CAST([] AS BIGINT[])) AS qs FROM o LEFT JOIN close USING (r) GROUP BY 1),
walk AS (SELECT CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS taken, false AS head UNION ALL
  SELECT l.r, CASE WHEN list_contains(w.taken, l.r) THEN w.taken ELSE list_distinct(list_concat(w.taken, l.qs)) END, NOT list_contains(w.taken, l.r) FROM walk w JOIN lists l ON l.r = w.r + 1),
mine AS (SELECT close.r, min(close.q) AS q FROM close JOIN walk ON walk.r = close.q AND walk.head GROUP BY 1),
g AS (SELECT o.ip, coalesce(h.ip, o.ip) AS leader FROM o LEFT JOIN mine USING (r) LEFT JOIN o h ON h.r = mine.q),
sizes AS (SELECT leader, count(*) AS members FROM g GROUP BY 1),
rows AS (SELECT user_id AS ip, event_type || '_' || hour(ts) AS cluster, event_type AS proto, 'C' || (user_id % 7) AS country, epoch_us(ts) // 1000000 AS time FROM events),
kept AS (SELECT rows.*, leader, members FROM rows JOIN e2 USING (ip, cluster) JOIN g USING (ip) JOIN sizes USING (leader)),
found AS (SELECT * FROM kept WHERE members > 1),
rolled AS (SELECT leader, count(*) AS sessions, count(DISTINCT ip) AS ips, count(DISTINCT cluster) AS clusters, count(DISTINCT proto) AS protocols, count(DISTINCT country) AS countries, min(time) AS first_time, max(time) AS last_time FROM found GROUP BY 1) """


def ip_groups(spark: SparkSession, d: str) -> DataFrame:
    edges, groups = _all(spark, d)
    forget(edges)
    return groups


def group_loners(spark: SparkSession, d: str) -> DataFrame:
    """Loners with their country, sessions and behaviours."""
    edges, groups = _all(spark, d)
    alone = G.retained(sessions(spark, d), edges).join(kept(G.loners(groups)), "ip", "left_semi")
    forget(edges, groups)
    return alone.groupBy("ip", "country").agg(F.count("*").alias("sessions"), F.array_join(F.array_sort(F.collect_set("cluster")), ",").alias("clusters"))


def loner_countries(spark: SparkSession, d: str) -> DataFrame:
    """The sixty countries with most loners, ties by name."""
    return group_loners(spark, d).groupBy("country").agg(F.count("*").alias("loners"), F.sum("sessions").alias("sessions")).orderBy(F.desc("loners"), "country").limit(60)


def group_members(spark: SparkSession, d: str) -> DataFrame:
    """One row per member of a group: what a group's maps of times and clusters would hold, summed up."""
    return _members(spark, d).groupBy("leader", "ip", "country").agg(F.count("*").alias("sessions"), F.countDistinct("cluster").alias("clusters"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))


def group_rollup(spark: SparkSession, d: str) -> DataFrame:
    return G.rollup(_members(spark, d))


def group_size_hist(spark: SparkSession, d: str) -> DataFrame:
    return G.size_histograms(G.rollup(_members(spark, d)))


def intention_default(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each group by intention, and their part of the group's."""
    known = spark.createDataFrame(INTENTIONS, "intention string, clusters array<string>")
    n = G.with_intention(_members(spark, d), known, "proto").groupBy("leader", "intention").agg(F.count("*").alias("n"))
    return n.withColumn("portion", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("leader")), 12))


def groups_with_ip(spark: SparkSession, d: str) -> DataFrame:
    """The groups that hold the busiest address of each country (ties: the larger address)."""
    wanted = sessions(spark, d).groupBy("country", "ip").agg(F.count("*").alias("n")).groupBy("country").agg(F.max_by("ip", F.struct("n", "ip")).alias("ip"))
    return ip_groups(spark, d).join(wanted, "ip").select("country", "ip", "leader")


def edge_totals(spark: SparkSession, d: str) -> DataFrame:
    return G.with_total(user_edges(spark, d))


def latest_event(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_id", "event_type", "value")
    return G.latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


def top_cluster_hours(spark: SparkSession, d: str) -> DataFrame:
    return G.hours_of_largest(sessions(spark, d), 1, 10)


def isp_alias(spark: SparkSession, d: str) -> DataFrame:
    return packets(spark, d).groupBy(G.alias(F.col("isp"), ALIASES).alias("isp")).agg(F.count("*").alias("packets"))


def day_labels(spark: SparkSession, d: str) -> DataFrame:
    """Days as their figures alone (in January) or as month and day, all as month and day."""
    e = spark.read.parquet(f"{d}/events.parquet")
    text = F.when(F.month("ts") == 1, F.dayofmonth("ts").cast("string")).otherwise(F.date_format("ts", "MMdd"))
    return e.groupBy(G.month_day(text).alias("day")).agg(F.count("*").alias("n"))


def country_shares(spark: SparkSession, d: str) -> DataFrame:
    """Countries of each group's addresses with their shares; that of every eleventh user is unknown."""
    found = _members(spark, d).withColumn("country", F.when(F.col("ip") % 11 != 0, F.col("country")))
    return G.shares(found, "country").select("leader", "value", "n", F.round("portion", 12).alias("portion"))


def grouped_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the greedy groups."""
    found = G.statistics(_members(spark, d))
    sets = [F.array_join(f"{c}_set", ",").alias(f"{c}_set") for c in ("country", "proto", "cluster")]
    return found.select("leader", "sessions", "ip_num", *sets, "unique_country_num", "unique_protocols_num", "unique_cluster_num", "main_country")


def loner_describe(spark: SparkSession, d: str) -> DataFrame:
    """How many behaviours those have who are alone in their group."""
    edges, groups = _all(spark, d)
    n = edges.join(G.loners(groups), "ip", "left_semi").groupBy("ip").agg(F.count("*").alias("n"))
    q = [F.percentile("n", F.lit(x)).alias(name) for x, name in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))]
    return n.agg(F.count("*").alias("loners"), F.round(F.avg("n"), 9).alias("mean"), F.min("n").alias("low"), F.max("n").alias("high"), *q)


def cluster_members(spark: SparkSession, d: str) -> DataFrame:
    return G.members(sessions(spark, d))


def cluster_manifest(spark: SparkSession, d: str) -> DataFrame:
    return G.manifest(sessions(spark, d)).select("proto", "rank", "cluster", "sessions", "name")


def largest_cluster_times(spark: SparkSession, d: str) -> DataFrame:
    """When the sessions of each protocol's largest cluster were."""
    s = sessions(spark, d)
    return G.times_of(s, G.manifest(s).where("rank = 1"))


def behaviour_country_argmax(spark: SparkSession, d: str) -> DataFrame:
    """The country of most sessions of each cluster; ties by name."""
    n = sessions(spark, d).groupBy("cluster", "country").agg(F.count("*").alias("n"))
    return n.groupBy("cluster").agg(F.min_by("country", F.struct(-F.col("n"), "country")).alias("country"), F.max("n").alias("n"))


def loner_report(spark: SparkSession, d: str) -> DataFrame:
    """A row for each address alone in its group: how many clusters and protocols, its country and the first of its clusters."""
    edges, groups = _all(spark, d)
    alone = kept(G.retained(sessions(spark, d), edges).join(G.loners(groups), "ip", "left_semi"))
    counted = alone.groupBy("ip").agg(F.countDistinct("cluster").alias("clusters"), F.countDistinct("proto").alias("protocols"))
    return counted.join(report.report_rows(alone, ["ip"], {"country": 9, "cluster": 10}), "ip").select("ip", "clusters", "protocols", F.col("country").alias("countries"), F.col("cluster").alias("first_clusters"))


_RANKED = "WITH s AS (SELECT user_id AS ip, event_type || '_' || hour(ts) AS cluster, event_type AS proto, 'C' || (user_id % 7) AS country, epoch_us(ts) // 1000000 AS time FROM events), n AS (SELECT proto, cluster, count(*) AS sessions FROM s GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY proto ORDER BY sessions DESC, cluster) AS INT) AS rank FROM n) "

FOUND = {
    "country_shares": (country_shares, _WALK + ", homes AS (SELECT DISTINCT leader, ip, CASE WHEN ip % 11 <> 0 THEN country ELSE 'None' END AS value FROM found) SELECT leader, value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY leader), 12) AS portion FROM homes GROUP BY 1, 2"),
    "grouped_statistics": (grouped_statistics, _WALK + ", by_country AS (SELECT leader, country, count(DISTINCT ip) AS n FROM found GROUP BY 1, 2), mains AS (SELECT leader, arg_min(country, struct_pack(n := -n, c := country)) AS main_country FROM by_country GROUP BY 1) SELECT leader, count(*) AS sessions, count(DISTINCT ip) AS ip_num, string_agg(DISTINCT country, ',' ORDER BY country) AS country_set, string_agg(DISTINCT proto, ',' ORDER BY proto) AS proto_set, string_agg(DISTINCT cluster, ',' ORDER BY cluster) AS cluster_set, count(DISTINCT country) AS unique_country_num, count(DISTINCT proto) AS unique_protocols_num, count(DISTINCT cluster) AS unique_cluster_num, any_value(main_country) AS main_country FROM found JOIN mains USING (leader) GROUP BY 1"),
    "loner_describe": (loner_describe, _WALK + ", each_loner AS (SELECT ip, count(DISTINCT cluster) AS n FROM kept WHERE members = 1 GROUP BY 1) SELECT count(*) AS loners, round(avg(n), 9) AS mean, min(n) AS low, max(n) AS high, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS q2, quantile_cont(n, 0.75) AS q3 FROM each_loner"),
    "loner_report": (loner_report, _WALK + ", x AS (SELECT ip, list_sort(list(DISTINCT cluster)) AS c, list_sort(list(DISTINCT country)) AS o, count(DISTINCT proto) AS protocols FROM kept WHERE members = 1 GROUP BY 1) SELECT ip, CAST(len(c) AS BIGINT) AS clusters, protocols, array_to_string(o, ', ') AS countries, array_to_string(c[1:10], ', ') || CASE WHEN len(c) > 10 THEN ', ...' ELSE '' END AS first_clusters FROM x"),
    "cluster_members": (cluster_members, _RANKED + "SELECT cluster, ip, country, count(*) AS sessions, min(time) AS first_time, max(time) AS last_time FROM s GROUP BY 1, 2, 3"),
    "cluster_manifest": (cluster_manifest, _RANKED + "SELECT proto, rank, cluster, sessions, 'timelist_' || proto || '_large#' || rank || '_clusterID#' || cluster AS name FROM r"),
    "largest_cluster_times": (largest_cluster_times, _RANKED + "SELECT cluster, time FROM s WHERE cluster IN (SELECT cluster FROM r WHERE rank = 1)"),
    "behaviour_country_argmax": (behaviour_country_argmax, _RANKED + "SELECT cluster, arg_min(country, struct_pack(n := -n, c := country)) AS country, max(n) AS n FROM (SELECT cluster, country, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1"),
    "ip_groups": (ip_groups, _WALK + "SELECT ip, leader FROM g"),
    "group_loners": (group_loners, _WALK + "SELECT ip, country, count(*) AS sessions, string_agg(DISTINCT cluster, ',' ORDER BY cluster) AS clusters FROM kept WHERE members = 1 GROUP BY 1, 2"),
    "loner_countries": (loner_countries, _WALK + "SELECT country, count(DISTINCT ip) AS loners, count(*) AS sessions FROM kept WHERE members = 1 GROUP BY 1 ORDER BY loners DESC, country LIMIT 60"),
    "group_members": (group_members, _WALK + "SELECT leader, ip, country, count(*) AS sessions, count(DISTINCT cluster) AS clusters, min(time) AS first_time, max(time) AS last_time FROM found GROUP BY 1, 2, 3"),
    "group_rollup": (group_rollup, _WALK + "SELECT * FROM rolled"),
    "group_size_hist": (group_size_hist, _WALK + "SELECT 'ips' AS kind, ips AS size, count(*) AS groups FROM rolled GROUP BY 2 UNION ALL SELECT 'clusters', clusters, count(*) FROM rolled GROUP BY 2"),
    "intention_default": (intention_default, _WALK + ", i AS (SELECT leader, CASE proto WHEN 'purchase' THEN 'buying' WHEN 'signup' THEN 'entering' ELSE 'probing' END AS intention FROM found) SELECT leader, intention, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY leader), 12) AS portion FROM i GROUP BY 1, 2"),
    "groups_with_ip": (groups_with_ip, _WALK + ", b AS (SELECT country, ip, count(*) AS n FROM rows GROUP BY 1, 2), w AS (SELECT country, arg_max(ip, struct_pack(n := n, ip := ip)) AS ip FROM b GROUP BY 1) SELECT country, ip, leader FROM w JOIN g USING (ip)"),
    "edge_totals": (edge_totals, f"WITH {_UEDGES} SELECT CASE WHEN GROUPING(cluster) = 1 THEN 'stat' ELSE cluster END AS cluster, count(*) AS ips FROM edges GROUP BY ROLLUP (cluster)"),
    "latest_event": (latest_event, "SELECT user_id, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS event_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS event_type, arg_max(value, struct_pack(t := ts, e := event_id)) AS value FROM events GROUP BY 1"),
    "top_cluster_hours": (top_cluster_hours, "WITH b AS (SELECT event_type || '_' || hour(ts) AS cluster, epoch_us(ts) // 3600000000 AS hour, count(*) AS n FROM events GROUP BY 1, 2), l AS (SELECT cluster, CAST(row_number() OVER (ORDER BY sum(n) DESC, cluster) AS INT) AS rank FROM b GROUP BY 1), h AS (SELECT unnest(range(min(hour) - 1, max(hour) + 1)) AS hour FROM b) SELECT rank, l.cluster, h.hour, coalesce(b.n, 0) AS n FROM l CROSS JOIN h LEFT JOIN b ON b.cluster = l.cluster AND b.hour = h.hour WHERE rank <= 10"),
    "isp_alias": (isp_alias, f"WITH {PACKETS_SQL} SELECT CASE isp WHEN 'isp1' THEN 'north' WHEN 'isp2' THEN 'south' ELSE isp END AS isp, count(*) AS packets FROM packets GROUP BY 1"),
    "day_labels": (day_labels, "SELECT strftime(ts, '%m%d') AS day, count(*) AS n FROM events GROUP BY 1"),
}
