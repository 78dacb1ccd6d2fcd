"""Queries on fuzzy hashes of payloads: texts stand for payloads, languages for protocols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlark.functions.fuzzy import block_size, fuzzy_hash
from flowlark.functions.net import ip_to_long
from flowlark.operators import behaviour as B
from flowlark.operators import fuzzy_clusters as C
from flowlark.operators import report
from flowlark.operators import sessions as S
from flowlark.operators import trends as T
from flowlark.operators.scratch import kept, new_folder
from flowlark.plans.behaviour_queries import _GROUPS, _groups, session_rows
from flowlark.sources.packets import from_conversations

DAYS = ["20200106", "20200107", "20200108"]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """Three documents in a row, of one language, are a session of one of three days."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "source", "text")
    idx = F.floor(F.col("doc_id") / 3)
    return docs.select("doc_id", "text", "source", idx.alias("idx"), F.struct(F.col("lang").alias("proto"), F.element_at(F.lit(DAYS), (idx % 3 + 1).cast("int")).alias("date")).alias("part"))


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """Payload rows; written once, as hashing is the dearest step."""
    hashed = _docs(spark, d).where("text is not null").select("doc_id", "part", "idx", fuzzy_hash("text").alias("hash"))
    pos = F.row_number().over(Window.partitionBy("part", "idx").orderBy("doc_id")) - 1
    return kept(hashed.select("part", "idx", pos.alias("pos"), "hash"))


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    first = _docs(spark, d).groupBy("part", "idx").agg(F.min_by("source", "doc_id").alias("country"))
    ip = F.concat_ws(".", F.lit("10.0.0"), (F.col("idx") % 8).cast("string"))
    return first.select("part", "part.proto", "part.date", "idx", "country", F.lit(None).cast("string").alias("domain"), ip.alias("ip_src"))


def hashes(spark: SparkSession, d: str) -> DataFrame:
    found = _docs(spark, d).select("doc_id", fuzzy_hash("text").alias("hash"))
    return found.select("doc_id", "hash", block_size(F.col("hash")).alias("block_size"))


def clusters(spark: SparkSession, d: str) -> DataFrame:
    return C.leader_clusters(_payloads(spark, d)).select("part.proto", "part.date", "idx", "leader")


#: Signatures with runs of four are left out, as SQL can't shorten them.
_RUNS = "|".join(c * 4 for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def signature_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of sessions of five documents each, by hashes that SQL can make too: thirty letters of the text are the signature."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "text")
    letters = F.substring(F.regexp_replace("text", "[^A-Za-z]", ""), 60, 30)
    made = docs.select(F.col("lang").alias("part"), F.floor(F.col("doc_id") / 5).alias("idx"), "doc_id", letters.alias("sig")).where(F.length("sig") > 0)
    made = made.withColumn("hash", F.when(~F.col("sig").rlike(_RUNS), F.concat(F.lit("3:"), "sig", F.lit(":"))))
    payloads = kept(made.select("part", "idx", F.row_number().over(Window.partitionBy("part", "idx").orderBy("doc_id")).alias("pos"), "hash"))
    return C.leader_clusters(payloads).select(F.col("part").alias("lang"), "idx", "leader")


_SIGNATURES = f"""WITH RECURSIVE s AS (SELECT lang AS part, doc_id // 5 AS idx, doc_id, substr(regexp_replace(text, '[^A-Za-z]', '', 'g'), 60, 30) AS sig FROM documents),
p AS MATERIALIZED (SELECT part, idx, sig, row_number() OVER (PARTITION BY part, idx ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY part, idx) AS n FROM s WHERE length(sig) > 0 AND NOT regexp_matches(sig, '{_RUNS}')),
r AS MATERIALIZED (SELECT part, idx, row_number() OVER (ORDER BY part, idx) AS r FROM (SELECT DISTINCT part, idx FROM p)),
g AS MATERIALIZED (SELECT DISTINCT r, part, pos IN (CAST(floor(n * 0.25) AS BIGINT), CAST(floor(n * 0.5) AS BIGINT), CAST(floor(n * 0.75) AS BIGINT)) OR (n > 4 AND pos = n - 1) AS asks,
  unnest(list_concat(list_transform(range(1, greatest(length(sig) - 5, 1)), lambda i: substr(sig, CAST(i AS BIGINT), 7)), ['=' || sig])) AS gram FROM p JOIN r USING (part, idx)),
links AS MATERIALIZED (SELECT DISTINCT x.r AS r, y.r AS q FROM g x JOIN g y ON x.part = y.part AND x.gram = y.gram AND x.r <> y.r WHERE x.asks),
lists AS MATERIALIZED (SELECT r.r, coalesce(list(q) FILTER (q IS NOT NULL), CAST([] AS BIGINT[])) AS qs FROM r LEFT JOIN links USING (r) GROUP BY 1),
walk AS (SELECT CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS taken, false AS head UNION ALL
  SELECT l.r, CASE WHEN list_contains(w.taken, l.r) OR len(list_filter(l.qs, lambda x: NOT list_contains(w.taken, x))) = 0 THEN w.taken ELSE list_distinct(list_concat(w.taken, l.qs, [l.r])) END,
    NOT list_contains(w.taken, l.r) AND len(list_filter(l.qs, lambda x: NOT list_contains(w.taken, x))) > 0 FROM walk w JOIN lists l ON l.r = w.r + 1),
heads AS (SELECT r FROM walk WHERE head), mine AS (SELECT links.q AS r, min(links.r) AS lead FROM links JOIN heads ON heads.r = links.r GROUP BY 1)
SELECT r.part AS lang, r.idx, CASE WHEN heads.r IS NOT NULL THEN r.idx ELSE l.idx END AS leader FROM r LEFT JOIN heads ON heads.r = r.r LEFT JOIN mine ON mine.r = r.r LEFT JOIN r l ON l.r = mine.lead"""


def conversation_clusters(spark: SparkSession, d: str) -> DataFrame:
    """From packets with payloads to sessions, and on to clusters of sessions whose inbound payloads look alike."""
    full = S.sessions(from_conversations(spark.read.parquet(f"{d}/conversations.parquet")), 120.0)
    part = F.struct(F.col("ip_proto").alias("proto"), F.lit(DAYS[0]).alias("date"))
    payloads = kept(S.payload_rows(full.withColumn("idx", ip_to_long(F.col("ip_src"))).withColumn("part", part), ["part", "idx"]))
    return C.leader_clusters(payloads).select("idx", "leader")


def same_address(spark: SparkSession, d: str) -> DataFrame:
    return C.same_address_links(_payloads(spark, d), _sessions(spark, d)).select("part.proto", "part.date", "a", "b", "ip_src")


def _heads(spark: SparkSession, d: str) -> DataFrame:
    payloads = _payloads(spark, d)
    found = C.leader_clusters(payloads)
    sizes = found.groupBy("part", F.coalesce("leader", "idx").alias("head")).agg(F.count("*").alias("size"))
    return C.representatives(found, payloads, _sessions(spark, d), B.small_cluster_limit(sizes, ("part",)))


def rep_hash(spark: SparkSession, d: str) -> DataFrame:
    return _heads(spark, d).select("part.proto", "part.date", "idx", "kind", "name", "hash")


def upgma(spark: SparkSession, d: str) -> DataFrame:
    """The tree of all days' clusters and loners of each protocol."""
    tree = C.average_linkage(kept(_heads(spark, d).select("part.proto", "idx", "hash").withColumnRenamed("proto", "part")))
    return tree.select(F.col("part").alias("proto"), "round", "a", "b", F.round("distance", 9).alias("distance"), "size")


def trend_merge(spark: SparkSession, d: str) -> DataFrame:
    payloads = _payloads(spark, d)
    return T.trends(C.leader_clusters(payloads), payloads, DAYS)


def trend_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same, day by day as a stream: a file a batch, the state of earlier days in a table."""
    payloads = _payloads(spark, d)
    heads = kept(T.trend_heads(C.leader_clusters(payloads), payloads))
    folder = new_folder(spark)
    for day in DAYS:
        heads.where(F.col("date") == day).coalesce(1).write.mode("append").parquet(f"{folder}/heads")
    source = spark.readStream.schema(heads.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/heads")
    T.follow(source, f"{folder}/trends", f"{folder}/checkpoint").awaitTermination()
    return T.stored_trends(spark, f"{folder}/trends")


def trend_events(spark: SparkSession, d: str) -> DataFrame:
    """Times, countries and addresses of the sessions of each trend; a session's idx stands for its second of the day."""
    payloads = _payloads(spark, d)
    found = C.leader_clusters(payloads)
    time = F.unix_timestamp("date", "yyyyMMdd") + F.col("idx")
    return T.trend_events(T.trends(found, payloads, DAYS), found, _sessions(spark, d).select("part", "idx", time.alias("session_time"), "country", "ip_src"))


def trend_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Payload hashes of each trend."""
    payloads = _payloads(spark, d)
    found = C.leader_clusters(payloads)
    return T.trend_hashes(T.trends(found, payloads, DAYS), found, payloads)


def small_cluster_thr(spark: SparkSession, d: str) -> DataFrame:
    """Customers are clusters of what they ordered; those without orders are loners."""
    sizes = session_rows(spark, d).groupBy("ip").agg(F.count("*").alias("size"))
    people = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("ip"))
    return B.small_cluster_limit(people.join(sizes, "ip", "left").select(F.coalesce("size", F.lit(1)).alias("size")))


_SMALL = "WITH n AS (SELECT o_custkey AS ip, count(*) AS size FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1), r AS (SELECT coalesce(size, 1) AS size FROM customer LEFT JOIN n ON ip = c_custkey), f AS (SELECT size, count(*) AS f FROM r GROUP BY 1), c AS (SELECT *, sum(f) OVER (ORDER BY f, size DESC ROWS UNBOUNDED PRECEDING) AS cum, sum(f) OVER () AS total FROM f), s AS (SELECT *, (lead(cum) OVER w - cum) / total / (lead(size) OVER w - size) AS slope, lead(size) OVER w AS nx FROM c WINDOW w AS (ORDER BY f, size DESC)), h AS (SELECT nx AS size, abs(lead(slope) OVER (ORDER BY f, s.size DESC) - slope) AS change FROM s), k AS (SELECT *, row_number() OVER (ORDER BY change DESC, size) AS rank FROM h WHERE change IS NOT NULL), q AS (SELECT quantile_cont(size - 1, 0.25) AS q1 FROM r WHERE size > 1) SELECT CAST(coalesce((SELECT arg_min(size - 1, rank) FROM k, q WHERE rank <= 100 AND size < q1), 0) AS BIGINT) AS \"limit\""


def group_xml(spark: SparkSession, d: str) -> DataFrame:
    """Group reports written as XML text and read again."""
    rows = _groups(spark, d)
    return report.from_group_xml(report.group_xml(rows.select(F.col("g").alias("group_id"), "ip", "country", "cluster", F.substring("cluster", 1, 7).alias("protocol")))).select(
        "group_id", "number_of_clusters", "number_of_protocols", F.size("src_ip").alias("ips"), F.array_join("group_country", ",").alias("countries"), F.array_join("cluster_id", ",").alias("clusters")
    )


_XML = f"WITH {_GROUPS} SELECT g AS group_id, count(DISTINCT cluster) AS number_of_clusters, count(DISTINCT substr(cluster, 1, 7)) AS number_of_protocols, CAST(count(DISTINCT ip) AS INT) AS ips, string_agg(DISTINCT country, ',' ORDER BY country) AS countries, string_agg(DISTINCT cluster, ',' ORDER BY cluster) AS clusters FROM rows GROUP BY 1"

FOUND = {
    "fuzzy_hash": (hashes, None),
    "fuzzy_clusters": (clusters, None),
    "signature_clusters": (signature_clusters, _SIGNATURES),
    "conversation_clusters": (conversation_clusters, None),
    "fuzzy_same_address": (same_address, None),
    "rep_hash": (rep_hash, None),
    "upgma": (upgma, None),
    "trend_merge": (trend_merge, None),
    "trend_stream": (trend_stream, None),
    "trend_events": (trend_events, None),
    "trend_hashes": (trend_hashes, None),
    "small_cluster_thr": (small_cluster_thr, _SMALL),
    "group_xml": (group_xml, _XML),
}
