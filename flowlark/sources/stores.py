"""Stored sessions and listings of capture files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlark.functions.net import cidr_range


def write_sessions(sessions: DataFrame, path: str, by: tuple[str, ...] = ("isp", "date")) -> None:
    """Parquet files partitioned by the given columns; large partitions become several files, small ones one."""
    sessions.hint("rebalance", *by).write.partitionBy(*by).parquet(path)


def read_sessions(spark: SparkSession, path: str, by: tuple[str, ...] = ("isp", "date"), **allowed: list[str]) -> DataFrame:
    """Stored sessions whose partition columns are among the allowed values; files of other partitions aren't read.

    Partition columns are text as written ("0106" isn't 106).  Files of several versions are
    read together: columns that a file lacks are null.
    """
    known = spark.read.option("mergeSchema", True).parquet(path).schema
    found = spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) if f.name in by else f for f in known])).parquet(path)
    for column, values in allowed.items():
        found = found.where(F.col(column).isin(values))
    return found


def write_results(tables: dict[str, DataFrame], path: str, by: tuple[str, ...] = ("proto",)) -> None:
    """The results of an analysis side by side: one Parquet table for each name, partitioned by the columns of ``by`` that it has."""
    for name, table in tables.items():
        table.write.partitionBy(*(c for c in by if c in table.columns)).parquet(f"{path}/{name}")


def read_results(spark: SparkSession, path: str, name: str, **allowed: list[str]) -> DataFrame:
    """One of these tables, with the partitions whose values are allowed."""
    found = spark.read.parquet(f"{path}/{name}")
    for column, values in allowed.items():
        found = found.where(F.col(column).isin(values))
    return found


def write_packets_json(packets: DataFrame, path: str) -> None:
    """One JSON object per packet and line; null fields are left out."""
    packets.write.json(path)


def read_networks(spark: SparkSession, path: str) -> DataFrame:
    """``(cidr, lo, hi)`` of the networks listed in a settings file, one ``- a.b.c.d/n`` a line (quoted or not); other lines are left out."""
    cidr = F.regexp_extract("value", r"^\s*-\s*[\"']?(\d{1,3}(?:\.\d{1,3}){3}/\d{1,2})\b", 1)
    found = spark.read.text(path).select(cidr.alias("cidr")).where("cidr <> ''").distinct()
    lo, hi = cidr_range(F.col("cidr"))
    return found.select("cidr", lo.alias("lo"), hi.alias("hi"))


def capture_listing(spark: SparkSession, path: str, prefix: str = "snort.log.") -> DataFrame:
    """``(path, bytes, start)`` of capture files below ``path``, whose names are the prefix and ten figures of epoch seconds.

    Only names and sizes are read, no contents.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", prefix + "*").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"))
    name = F.element_at(F.split("path", "/"), -1)
    start = F.when(F.startswith(name, F.lit(prefix)), F.regexp_extract(F.substr(name, F.lit(len(prefix) + 1)), r"^(\d{10})$", 1))
    return files.withColumn("start", start.try_cast("double")).where("start is not null")
