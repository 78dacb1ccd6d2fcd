"""Queries on behaviours, clusters and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlark.operators import behaviour as B
from flowlark.operators import report

#: Customers stand for addresses, their nations for countries, brands of ordered parts for behaviours.
_EDGES = "edges AS (SELECT DISTINCT o_custkey AS ip, p_brand AS cluster FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)"
_PRUNED = "e1 AS (SELECT * FROM edges WHERE cluster IN (SELECT cluster FROM edges GROUP BY 1 HAVING count(*) > 1)), e2 AS (SELECT * FROM e1 WHERE ip IN (SELECT ip FROM e1 GROUP BY 1 HAVING count(*) > 1))"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def session_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row per ordered part: address, behaviour, country."""
    orders, lines = _t(spark, d, "orders").select("o_orderkey", "o_custkey"), _t(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    parts = _t(spark, d, "part").select("p_partkey", "p_brand")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(parts, F.col("p_partkey") == F.col("l_partkey")).select(F.col("o_custkey").alias("ip"), F.col("p_brand").alias("cluster"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return session_rows(spark, d).distinct()


def user_edges(spark: SparkSession, d: str) -> DataFrame:
    """Users and what they did at which hour of the day: a sparser graph."""
    e = _t(spark, d, "events")
    return e.select(F.col("user_id").alias("ip"), F.concat_ws("_", "event_type", F.hour("ts").cast("string")).alias("cluster")).distinct()


_UEDGES = "edges AS (SELECT DISTINCT user_id AS ip, event_type || '_' || hour(ts) AS cluster FROM events)"
_SIZES = "n AS (SELECT ip, count(*) AS n FROM e2 GROUP BY 1), tot AS (SELECT count(DISTINCT cluster) AS total FROM e2), c AS (SELECT x.ip AS a, y.ip AS b, count(*) AS common FROM e2 x JOIN e2 y ON x.cluster = y.cluster AND x.ip < y.ip GROUP BY 1, 2), s AS (SELECT a, b, common, CAST(greatest(p.n, q.n) AS DOUBLE) / total AS w, p.n AS na, q.n AS nb FROM c JOIN n p ON p.ip = a JOIN n q ON q.ip = b, tot), pairs AS (SELECT a, b, common, w * (common / sqrt(CAST(na * nb AS DOUBLE))) + (1 - w) * (CAST(common AS DOUBLE) / (na + nb - common)) AS score FROM s)"


def pair_similarity(spark: SparkSession, d: str) -> DataFrame:
    found = B.pair_scores(B.prune(user_edges(spark, d)), 0.1)
    return found.select("a", "b", "common", F.round("score", 9).alias("score"))


def prune_singletons(spark: SparkSession, d: str) -> DataFrame:
    return B.prune(user_edges(spark, d))


def onehot_edges(spark: SparkSession, d: str) -> DataFrame:
    """Behaviours whose name holds '1' count as one."""
    e = edges(spark, d).select("ip", F.when(F.col("cluster").contains("1"), "ones").otherwise(F.col("cluster")).alias("cluster")).distinct()
    return e.groupBy("cluster").agg(F.count("*").alias("ips"))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with a group: the market segment of the customer."""
    people = _t(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("g"), "c_nationkey")
    nation = _t(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    return session_rows(spark, d).join(people.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")), F.col("ip") == F.col("c_custkey")).select("g", "ip", "cluster", "country")


_GROUPS = "rows AS (SELECT c_mktsegment AS g, o_custkey AS ip, p_brand AS cluster, n_name AS country FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"
_INTENT = "CASE WHEN cluster LIKE '%1' THEN 'scan' WHEN cluster LIKE '%2' THEN 'login' ELSE 'probing' END"


def _intention(column: str = "cluster"):
    return F.when(F.col(column).endswith("1"), "scan").when(F.col(column).endswith("2"), "login").otherwise("probing")


def group_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = _groups(spark, d)
    people = rows.select("g", "ip", "country").distinct()
    country = people.groupBy("g", "country").agg(F.count("*").alias("n"))
    main = country.groupBy("g").agg(F.max_by("country", F.struct("n", "country")).alias("main_country"), F.sum("n").alias("ip_num"), F.count("*").alias("unique_country_num"), F.array_join(F.array_sort(F.collect_list("country")), ",").alias("country_set"))
    clusters = rows.groupBy("g").agg(F.countDistinct("cluster").alias("unique_cluster_num"), F.countDistinct(F.substring("cluster", 1, 7)).alias("unique_protocols_num"), F.count("*").alias("sessions"))
    return main.join(clusters, "g")


def portions(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = _groups(spark, d)
        if kind == "country":
            rows = rows.select("g", "ip", "country").distinct()
        if kind == "intention":
            rows = rows.withColumn("intention", _intention())
        n = rows.groupBy("g", kind).agg(F.count("*").alias("n"))
        return n.withColumn("portion", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("g")), 12))

    source = {"country": "(SELECT DISTINCT g, ip, country FROM rows)", "cluster": "rows", "intention": f"(SELECT *, {_INTENT} AS intention FROM rows)"}[kind]
    return query, f"WITH {_GROUPS} SELECT g, {kind}, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY g), 12) AS portion FROM {source} GROUP BY 1, 2"


def country_argmax(spark: SparkSession, d: str) -> DataFrame:
    """Each country's most frequent behaviour."""
    n = _groups(spark, d).groupBy("country", "cluster").agg(F.count("*").alias("n"))
    return n.groupBy("country").agg(F.max_by("cluster", F.struct("n", "cluster")).alias("cluster"), F.max("n").alias("n"))


def country_pivot(spark: SparkSession, d: str) -> DataFrame:
    rows = _groups(spark, d).withColumn("intention", _intention())
    return rows.groupBy("country").pivot("intention", ["scan", "login", "probing"]).count().na.fill(0)


def sessions_per_ip_hist(spark: SparkSession, d: str) -> DataFrame:
    return session_rows(spark, d).groupBy("ip").agg(F.count("*").alias("sessions")).groupBy("sessions").agg(F.count("*").alias("ips"))


def behaviours_per_ip_hist(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).groupBy("ip").agg(F.count("*").alias("behaviours")).groupBy("behaviours").agg(F.count("*").alias("ips"))


def cluster_in_groups(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d).select("g", "cluster").distinct().groupBy("cluster").agg(F.count("*").alias("groups"))


def rank_clusters(spark: SparkSession, d: str) -> DataFrame:
    n = session_rows(spark, d).groupBy("cluster").agg(F.count("*").alias("n"))
    return B.ranked(n, [F.desc("n"), F.col("cluster")])


def top5_clusters(spark: SparkSession, d: str) -> DataFrame:
    return session_rows(spark, d).groupBy("cluster").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster").limit(5)


def size_describe(spark: SparkSession, d: str) -> DataFrame:
    n = session_rows(spark, d).groupBy("ip").agg(F.count("*").alias("n"))
    q = F.percentile("n", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    one = n.agg(F.count("*").alias("count"), F.round(F.avg("n"), 9).alias("mean"), F.round(F.stddev("n"), 6).alias("std"), F.min("n").alias("low"), F.max("n").alias("high"), q.alias("q"))
    return one.select("count", "mean", "std", "low", "high", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"))


def knee_point(spark: SparkSession, d: str) -> DataFrame:
    sizes = session_rows(spark, d).groupBy("ip").agg(F.count("*").alias("size"))
    return B.knee_points(sizes).select("rank", "size", F.round("change", 12).alias("change"))


_KNEE = "WITH r AS (SELECT count(*) AS size FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_custkey), f AS (SELECT size, count(*) AS f FROM r GROUP BY 1), c AS (SELECT *, sum(f) OVER (ORDER BY f, size DESC ROWS UNBOUNDED PRECEDING) AS cum, sum(f) OVER () AS total FROM f), s AS (SELECT *, (lead(cum) OVER w - cum) / total / (lead(size) OVER w - size) AS slope, lead(size) OVER w AS nx FROM c WINDOW w AS (ORDER BY f, size DESC)), h AS (SELECT nx AS size, abs(lead(slope) OVER (ORDER BY f, s.size DESC) - slope) AS change FROM s) SELECT CAST(rank AS INT) AS rank, size, round(change, 12) AS change FROM (SELECT *, row_number() OVER (ORDER BY change DESC, size) AS rank FROM h WHERE change IS NOT NULL) WHERE rank <= 100"


def noise_filter(spark: SparkSession, d: str) -> DataFrame:
    """Documents but those of sources where a text holds a license line."""
    docs = _t(spark, d, "documents").select("doc_id", "source", "lang", "text")
    noise = docs.where(F.col("text").contains("License")).select("source", "lang").distinct()
    return docs.join(noise, ["source", "lang"], "left_anti").select("doc_id", "source", "lang")


def md5_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Files of one name and digest are one; the first of a name keeps it, others get a number."""
    docs = _t(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("digest"))
    once = docs.groupBy("source", "digest").agg(F.min("doc_id").alias("doc_id"))
    # Numbered by ranges of all, as one source may hold most files.
    placed = B.ranked(once.where("source is not null"), [F.col("source"), F.col("doc_id"), F.col("digest")], "_place")
    first = placed.groupBy("source").agg(F.min("_place").alias("_first"))
    numbered = placed.join(first, "source").withColumn("n", F.col("_place") - F.col("_first") + 1)
    n = F.col("n")
    return numbered.select("doc_id", "digest", F.when(n == 1, F.col("source")).otherwise(F.concat_ws("_", "source", n.cast("string"))).alias("name"))


def report_caps(spark: SparkSession, d: str) -> DataFrame:
    """Report rows: at most ten addresses and nine countries of a group, with an ellipsis where more follow."""
    return report.report_rows(_groups(spark, d), ["g"], {"ip": 10, "country": 9}).select("g", F.col("ip").alias("ips"), F.col("country").alias("countries"))


_CAPS = f"WITH {_GROUPS}, a AS (SELECT g, list_sort(list(DISTINCT ip)) AS i, list_sort(list(DISTINCT country)) AS c FROM rows GROUP BY 1) SELECT g, array_to_string(list_transform(i[1:10], lambda x: CAST(x AS VARCHAR)), ', ') || CASE WHEN len(i) > 10 THEN ', ...' ELSE '' END AS ips, array_to_string(c[1:9], ', ') || CASE WHEN len(c) > 9 THEN ', ...' ELSE '' END AS countries FROM a"


def union_protocols(spark: SparkSession, d: str) -> DataFrame:
    """Per-type tables under one name, ids decorated with the type."""
    e = _t(spark, d, "events").select("event_id", "event_type", "user_id")
    return e.where("event_type is not null").select(F.concat_ws("_", F.col("event_id").cast("string"), "event_type").alias("idx"), "user_id")


def cluster_id_parts(spark: SparkSession, d: str) -> DataFrame:
    from flowlark.functions.net import cluster_part

    e = _t(spark, d, "events").select(F.concat_ws("_", F.date_format("ts", "yyyy-MM-dd"), F.col("user_id").cast("string"), "event_type").alias("id"))
    return e.groupBy("id").agg(F.count("*").alias("n")).select("id", cluster_part(F.col("id"), "day").alias("day"), cluster_part(F.col("id"), "number").alias("number"), cluster_part(F.col("id"), "protocol").alias("protocol"), "n")


def proto_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("sessions"), F.countDistinct("user_id").alias("ips"))


def intention_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Behaviours of each intention, flattened from the groups' lists, in order."""
    by = _groups(spark, d).select("g", "cluster").distinct().withColumn("intention", _intention()).groupBy("g", "intention").agg(F.collect_list("cluster").alias("c"))
    return by.groupBy("intention").agg(F.array_join(F.array_sort(F.flatten(F.collect_list("c"))), ",").alias("clusters"))


FOUND = {
    "onehot_edges": (onehot_edges, f"WITH {_EDGES}, e AS (SELECT DISTINCT ip, CASE WHEN contains(cluster, '1') THEN 'ones' ELSE cluster END AS cluster FROM edges) SELECT cluster, count(*) AS ips FROM e GROUP BY 1"),
    "prune_singletons": (prune_singletons, f"WITH {_UEDGES}, {_PRUNED} SELECT ip, cluster FROM e2"),
    "pair_similarity": (pair_similarity, f"WITH {_UEDGES}, {_PRUNED}, {_SIZES} SELECT a, b, common, round(score, 9) AS score FROM pairs WHERE score > 0.1"),
    "group_stats": (group_stats, f"WITH {_GROUPS}, p AS (SELECT DISTINCT g, ip, country FROM rows), c AS (SELECT g, country, count(*) AS n FROM p GROUP BY 1, 2), m AS (SELECT g, arg_max(country, struct_pack(n := n, c := country)) AS main_country, CAST(sum(n) AS BIGINT) AS ip_num, count(*) AS unique_country_num, string_agg(country, ',' ORDER BY country) AS country_set FROM c GROUP BY 1) SELECT m.*, x.unique_cluster_num, x.unique_protocols_num, x.sessions FROM m JOIN (SELECT g, count(DISTINCT cluster) AS unique_cluster_num, count(DISTINCT substr(cluster, 1, 7)) AS unique_protocols_num, count(*) AS sessions FROM rows GROUP BY 1) x USING (g)"),
    "group_country_portion": portions("country"),
    "group_cluster_portion": portions("cluster"),
    "group_intention_portion": portions("intention"),
    "country_behavior_argmax": (country_argmax, f"WITH {_GROUPS}, n AS (SELECT country, cluster, count(*) AS n FROM rows GROUP BY 1, 2) SELECT country, arg_max(cluster, struct_pack(n := n, c := cluster)) AS cluster, max(n) AS n FROM n GROUP BY 1"),
    "country_intention_pivot": (country_pivot, f"WITH {_GROUPS}, i AS (SELECT country, {_INTENT} AS x FROM rows) SELECT country, count(*) FILTER (x = 'scan') AS scan, count(*) FILTER (x = 'login') AS login, count(*) FILTER (x = 'probing') AS probing FROM i GROUP BY 1"),
    "sessions_per_ip_hist": (sessions_per_ip_hist, f"WITH {_GROUPS}, s AS (SELECT count(*) AS sessions FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_custkey) SELECT sessions, count(*) AS ips FROM s GROUP BY 1"),
    "behaviours_per_ip_hist": (behaviours_per_ip_hist, f"WITH {_EDGES}, s AS (SELECT count(*) AS behaviours FROM edges GROUP BY ip) SELECT behaviours, count(*) AS ips FROM s GROUP BY 1"),
    "cluster_in_groups": (cluster_in_groups, f"WITH {_GROUPS} SELECT cluster, count(DISTINCT g) AS groups FROM rows GROUP BY 1"),
    "rank_clusters": (rank_clusters, "WITH n AS (SELECT p_brand AS cluster, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1) SELECT cluster, n, CAST(row_number() OVER (ORDER BY n DESC, cluster) AS INT) AS rank FROM n"),
    "top5_clusters": (top5_clusters, "SELECT p_brand AS cluster, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1 ORDER BY n DESC, cluster LIMIT 5"),
    "size_describe": (size_describe, "WITH s AS (SELECT count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_custkey) SELECT count(*) AS count, round(avg(n), 9) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS low, max(n) AS high, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS q2, quantile_cont(n, 0.75) AS q3 FROM s"),
    "knee_point": (knee_point, _KNEE),
    "noise_filter": (noise_filter, "SELECT doc_id, source, lang FROM documents WHERE (source, lang) NOT IN (SELECT (source, lang) FROM documents WHERE contains(text, 'License'))"),
    "md5_dedup": (md5_dedup, "WITH o AS (SELECT source, md5(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM o) SELECT doc_id, digest, CASE WHEN n = 1 THEN source ELSE source || '_' || n END AS name FROM n"),
    "report_caps": (report_caps, _CAPS),
    "union_protocols": (union_protocols, "SELECT event_id || '_' || event_type AS idx, user_id FROM events WHERE event_type IN ('click', 'view', 'purchase', 'error', 'signup')"),
    "cluster_id_parts": (cluster_id_parts, "SELECT id, right(split_part(id, '_', 1), 2) AS day, split_part(id, '_', 2) AS number, split_part(id, '_', 3) AS protocol, count(*) AS n FROM (SELECT strftime(ts, '%Y-%m-%d') || '_' || user_id || '_' || event_type AS id FROM events) GROUP BY id"),
    "proto_sessions": (proto_sessions, "SELECT event_type, count(*) AS sessions, count(DISTINCT user_id) AS ips FROM events GROUP BY 1"),
    "intention_arrays": (intention_arrays, f"WITH {_GROUPS} SELECT {_INTENT} AS intention, string_agg(cluster, ',' ORDER BY cluster) AS clusters FROM (SELECT DISTINCT g, cluster FROM rows) GROUP BY 1"),
}
