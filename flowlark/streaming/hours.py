"""Packets by the hour on streams: windows of event time, late rows set apart, hours without packets as zeros."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

HOUR = 3600


def hour_windows(packets: DataFrame, late: str | None = None) -> DataFrame:
    """``(ip_proto, hour, n)``: packets of each protocol in tumbling windows of an hour; ``late`` sets a stream's watermark, behind which rows are lost.

    ``hour`` counts from the epoch.  Packets without a time are left out.
    """
    timed = packets.select("ip_proto", F.timestamp_micros(F.floor(F.col("frame_time_epoch") * 1e6).cast("long")).alias("ts")).where("ts is not null")
    timed = timed.withWatermark("ts", late) if late else timed
    counted = timed.groupBy("ip_proto", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return counted.select("ip_proto", F.floor(F.unix_timestamp("w.start") / HOUR).alias("hour"), "n")


def dense(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``counts(*keys, hour, n)`` with zeros: every key in every hour from the one before the first to the last."""
    span = counts.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).where("a is not null").select(F.explode(F.sequence(F.col("a") - 1, F.col("b"))).alias("hour"))
    found = counts.select(*keys, "hour", F.lit(1).alias("_there"), "n")
    # Keys with all hours by a join on a constant, so that neither side needs to fit a task.
    grid = counts.select(*keys).distinct().withColumn("_one", F.lit(1)).join(span.withColumn("_one", F.lit(1)), "_one").drop("_one")
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"f.{c}")) for c in [*keys, "hour"]]
    return grid.alias("g").join(found.alias("f"), same, "left").select(*(f"g.{c}" for c in [*keys, "hour"]), F.coalesce("f.n", F.lit(0)).alias("n"))


def fold(batch: DataFrame, version: int, path: str, delay: float) -> None:
    """Adds one batch of packets to the hours at ``path``; a batch that comes again replaces itself.

    Packets more than ``delay`` seconds before the latest of earlier batches go to ``path/late`` as they are and aren't counted.
    """
    spark = batch.sparkSession
    seen = None
    if version:
        before = spark.read.schema("latest double, version long").parquet(f"{path}/seen").where(F.col("version") < version)
        seen = before.agg(F.max("latest")).first()[0]
    t = F.col("frame_time_epoch")
    is_late = F.lit(False) if seen is None else t < seen - delay
    timed = batch.where(t.isNotNull())
    timed.where(is_late).write.mode("overwrite").parquet(f"{path}/late/version={version}")
    counted = timed.where(~is_late).groupBy("ip_proto", F.floor(t / HOUR).alias("hour")).agg(F.count("*").alias("n"))
    counted.write.mode("overwrite").parquet(f"{path}/hours/version={version}")
    timed.agg(F.max(t).alias("latest")).write.mode("overwrite").parquet(f"{path}/seen/version={version}")


def follow(packets: DataFrame, path: str, delay: float) -> StreamingQuery:
    """Folds a stream of packets into the hours at ``path`` until all that has come is in; started again, it goes on where it was."""
    writer = packets.writeStream.foreachBatch(lambda batch, version: fold(batch, version, path, delay))
    return writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def late(spark: SparkSession, path: str) -> DataFrame:
    """Packets that came too late."""
    return spark.read.parquet(f"{path}/late").drop("version")


def hours(spark: SparkSession, path: str, with_late: bool = False) -> DataFrame:
    """``(ip_proto, hour, n)`` of all batches, zeros included; with the late ones, if asked for."""
    found = spark.read.parquet(f"{path}/hours").select("ip_proto", "hour", "n")
    if with_late:
        found = found.unionByName(late(spark, path).groupBy("ip_proto", F.floor(F.col("frame_time_epoch") / HOUR).alias("hour")).agg(F.count("*").alias("n")))
    return dense(found.groupBy("ip_proto", "hour").agg(F.sum("n").alias("n")), ["ip_proto"])
