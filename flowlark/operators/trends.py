"""Clusters that go on from day to day, on tables and as a stream of days.

A cluster is told by three payloads: the middle ones of its leader, of its last member and of the member with the largest idx.  It
asks by the first; a trend answers by all three of each of its clusters.  Trends are in the order in which they began: by day, on
one day the largest cluster first, of equally large ones the smaller leader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowlark.operators.fuzzy_clusters import alike, middle_hash
from flowlark.operators.scratch import forget, kept

HASHES = ["key", "last", "largest"]
_HEADS = ["proto", "date", "leader", "size", *HASHES]
#: What is known of the cluster with which a trend began: its day, how many others it has (negative, so that most come first), its leader.
_BEGAN = ["began", "began_size", "first"]


def trend_heads(clusters: DataFrame, payloads: DataFrame) -> DataFrame:
    """``(proto, date, leader, size, key, last, largest)`` of each cluster: members beside the leader, and its three payloads.

    ``clusters`` is ``(part, idx, leader)`` with a ``part`` of ``proto`` and ``date``; its members are in the order of a column
    ``place``, if it has one, else of idx.  Loners are no clusters.
    """
    members = clusters.where("leader is not null and idx <> leader")
    order = "place" if "place" in clusters.columns else "idx"
    ends = members.groupBy("part", "leader").agg(F.count("*").alias("size"), F.max_by("idx", order).alias("last"), F.max("idx").alias("largest"))
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.col(c).alias("idx")) for name, c in zip(HASHES, ("leader", "last", "largest"), strict=True)))).alias("x")
    found = ends.select("part", "leader", "size", asked).select("part", "leader", "size", "x.*").join(middle_hash(payloads), ["part", "idx"])
    heads = found.groupBy("part", "leader", "size").agg(*(F.max(F.when(F.col("name") == name, F.col("hash"))).alias(name) for name in HASHES))
    return heads.select("part.proto", "part.date", "leader", "size", *HASHES)


def _placed(today: DataFrame, known: DataFrame | None) -> DataFrame:
    """One day's heads with their ``trend`` and how it began.

    The best answer of at least 1 from ``known(proto, hash, trend, began, began_size, first)`` counts, of equal ones that of
    the trend which began first; without one a trend begins.  Clusters of one day don't see each other.
    """
    own = [F.concat_ws("_", "date", F.col("leader").cast("string")), F.col("date"), -F.col("size"), F.col("leader")]
    names = ["trend", *_BEGAN]
    if known is None:
        return today.select(*_HEADS, *(x.alias(c) for c, x in zip(names, own, strict=True)))
    scored = alike(today.select(F.col("proto").alias("part"), F.col("key").alias("hash")), known.select(F.col("proto").alias("part"), "hash"))
    answers = scored.join(known.select(F.col("proto").alias("part"), F.col("hash").alias("b"), *names), ["part", "b"])
    best = answers.groupBy(F.col("part").alias("proto"), F.col("a").alias("key")).agg(F.min_by(F.struct(*names), F.struct(-F.col("score"), *_BEGAN)).alias("best"))
    found = today.join(best, ["proto", "key"], "left")
    return found.select(*_HEADS, *(F.coalesce(F.col("best")[c], x).alias(c) for c, x in zip(names, own, strict=True)))


def _answering(placed: DataFrame) -> DataFrame:
    return placed.select("proto", F.explode(F.array(*HASHES)).alias("hash"), "trend", *_BEGAN).distinct()


def trends(clusters: DataFrame, payloads: DataFrame, days: list[str]) -> DataFrame:
    """``(proto, date, leader, trend)``: the trend of each cluster, called ``date_leader`` after the cluster with which it began.

    Clusters placed on one day are seen from the next day on; the days are few and are taken one after the other.
    """
    heads = kept(trend_heads(clusters, payloads))
    known, out = None, None
    for day in sorted(days):
        placed = kept(_placed(heads.where(F.col("date") == day), known))
        known = _answering(placed) if known is None else known.unionByName(_answering(placed)).distinct()
        out = placed if out is None else out.unionByName(placed)
    return (heads.withColumn("trend", F.lit("")) if out is None else out).select("proto", "date", "leader", "trend")


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows written in several versions, those of the last one for each value of ``keys``."""
    last = rows.groupBy(*keys).agg(F.max("version").alias("version"))
    return rows.join(last, [*keys, "version"], "left_semi")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def fold(batch: DataFrame, version: int, path: str) -> None:
    """Brings the trends stored at ``path`` on by one batch of heads, of one day or several.

    Heads and placed clusters are tables of versions, one for each batch.  The days of the batch and all later ones are placed
    anew, one after the other, on what earlier days hold; a version that is written again, or a day that comes again, changes
    nothing, and a day whose clusters come in several batches, late or not, ends as if they had come at once.  Of a cluster that comes
    again, the last version counts.
    """
    spark = batch.sparkSession
    batch.select(*_HEADS).write.mode("overwrite").parquet(f"{path}/heads/version={version}")
    heads = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in batch.select(*_HEADS).schema)}, version long").parquet(f"{path}/heads").where(F.col("version") <= version)
    begin = heads.where(F.col("version") == version).agg(F.min("date")).first()[0]
    if begin is None:
        return
    heads = kept(_latest(heads, ["proto", "date", "leader"]).drop("version").dropDuplicates(["proto", "date", "leader"]))
    known = None
    if version and _exists(spark, f"{path}/placed"):
        before = placed_versions(spark, path).where((F.col("date") < begin) & (F.col("version") < version))
        known = _answering(_latest(before, ["date"]))
    out = None
    for day in [r["date"] for r in heads.where(F.col("date") >= begin).select("date").distinct().orderBy("date").collect()]:
        placed = kept(_placed(heads.where(F.col("date") == day), known))
        known = _answering(placed) if known is None else known.unionByName(_answering(placed)).distinct()
        out = placed if out is None else out.unionByName(placed)
    out.write.mode("overwrite").parquet(f"{path}/placed/version={version}")
    forget(heads)


def placed_versions(spark: SparkSession, path: str) -> DataFrame:
    """All versions of the placed clusters at ``path``."""
    return spark.read.parquet(f"{path}/placed").withColumn("version", F.col("version").cast("long"))


def stored_trends(spark: SparkSession, path: str) -> DataFrame:
    """``(proto, date, leader, trend)`` as the last batches left them."""
    return _latest(placed_versions(spark, path), ["date"]).select("proto", "date", "leader", "trend")


def follow(heads: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Folds a stream of heads into the trends at ``path`` until all that has come is in; started again, it goes on where it was."""
    writer = heads.writeStream.foreachBatch(lambda batch, version: fold(batch, version, path))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def trend_events(found: DataFrame, clusters: DataFrame, sessions: DataFrame) -> DataFrame:
    """The sessions of every trend, leaders and members: ``proto, trend, date, leader, idx`` and what else ``sessions`` (``part, idx, ...``) holds.

    ``found`` is what ``trends`` gives.  Each session stays a row, so no trend becomes one value.
    """
    members = clusters.where("leader is not null").select("part", "idx", "leader", "part.proto", "part.date").join(found, ["proto", "date", "leader"])
    more = [c for c in sessions.columns if c not in ("part", "idx", "proto", "date", "leader", "trend")]
    return members.join(sessions.select("part", "idx", *more), ["part", "idx"]).select("proto", "trend", "date", "leader", "idx", *more)


def trend_hashes(found: DataFrame, clusters: DataFrame, payloads: DataFrame) -> DataFrame:
    """``(proto, trend, date, leader, hash)``: the payloads by which the clusters of each trend answer."""
    heads = trend_heads(clusters, payloads).join(found, ["proto", "date", "leader"])
    return heads.select("proto", "trend", "date", "leader", F.explode(F.array_distinct(F.array(*HASHES))).alias("hash"))
