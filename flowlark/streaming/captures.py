"""Captures as they arrive: each file once, what can't be read set apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from flowlark.sources.packets import JSON_SCHEMA, flatten, hashed

_CORRUPT = "_corrupt_record"


def store(batch: DataFrame, version: int, path: str, raw_payloads: bool = True) -> None:
    """Writes a batch of capture records as packets to ``path/packets`` and what is no record to ``path/quarantine``.

    Each batch has a folder of its own, so a batch that comes again after a failure replaces itself.
    """
    batch = batch.persist()  # the parser fills the corrupt column only where all columns are asked for
    bad = batch.where(F.col(_CORRUPT).isNotNull() | F.col("_source").isNull()).select("path", F.col(_CORRUPT).alias("record"))
    packets = flatten(batch.where(F.col(_CORRUPT).isNull() & F.col("_source").isNotNull()).select("_source"))
    (hashed(packets) if raw_payloads else packets).write.mode("overwrite").parquet(f"{path}/packets/version={version}")
    bad.write.mode("overwrite").parquet(f"{path}/quarantine/version={version}")
    batch.unpersist()


def ingest(spark: SparkSession, source: str, path: str, files_each: int = 1000, raw_payloads: bool = True) -> StreamingQuery:
    """Reads the JSON captures below ``source`` that haven't been read into ``path`` yet, and ends.

    Which files have been read is in ``path/checkpoint``.  A file that isn't JSON goes to the quarantine whole; others lose nothing by it.
    """
    schema = T.StructType([*JSON_SCHEMA.fields, T.StructField(_CORRUPT, T.StringType())])
    files = spark.readStream.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").option("maxFilesPerTrigger", files_each).json(source)
    rows = files.select("*", F.col("_metadata.file_path").alias("path"))
    writer = rows.writeStream.foreachBatch(lambda batch, version: store(batch, version, path, raw_payloads))
    return writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def packets(spark: SparkSession, path: str) -> DataFrame:
    """All packets that have been read."""
    return spark.read.parquet(f"{path}/packets").drop("version")


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    """``(path, record)`` of what couldn't be read."""
    return spark.read.parquet(f"{path}/quarantine").drop("version")
