"""Group reports as XML text, one per group, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHAPE = "group_id string, number_of_clusters long, number_of_protocols long, srcIP struct<src_ip: array<string>>, country struct<group_country: array<string>>, cluster struct<cluster_id: array<string>, cluster_key_payload: array<string>>"


def group_rows(rows: DataFrame) -> DataFrame:
    """One row per group of ``(group_id, ip, country, cluster, protocol)``: distinct values in order, nulls left out.

    With a column ``key_payload``, each cluster's (of several the first in order; a dash for none) stands at its cluster's place.
    """
    lists = [F.struct(F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(inner)).alias(outer) for c, outer, inner in (("ip", "srcIP", "src_ip"), ("country", "country", "group_country"))]
    counts = [F.countDistinct("cluster").alias("number_of_clusters"), F.countDistinct("protocol").alias("number_of_protocols")]
    if "key_payload" not in rows.columns:
        return rows.groupBy("group_id").agg(*counts, *lists, F.struct(F.array_sort(F.collect_set(F.col("cluster").cast("string"))).alias("cluster_id")).alias("cluster"))
    keyed = rows.where("cluster is not null").groupBy("group_id", F.col("cluster").cast("string").alias("c")).agg(F.coalesce(F.min("key_payload"), F.lit("-")).alias("p"))
    keyed = keyed.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("c", "p"))).alias("x"))
    keyed = keyed.select("group_id", F.struct(F.col("x.c").alias("cluster_id"), F.col("x.p").alias("cluster_key_payload")).alias("cluster"))
    return rows.groupBy("group_id").agg(*counts, *lists).join(keyed, "group_id", "left")


def group_xml(rows: DataFrame) -> DataFrame:
    """``(group_id, xml)`` of ``group_rows``."""
    return group_rows(rows).select("group_id", F.to_xml(F.struct("*"), {"rowTag": "group"}).alias("xml"))


def write_group_xml(rows: DataFrame, path: str) -> None:
    """XML files of ``group`` elements below ``top``, one file per partition."""
    group_rows(rows).write.format("xml").option("rootTag", "top").option("rowTag", "group").save(path)


def from_group_xml(texts: DataFrame) -> DataFrame:
    """The lists and figures of ``group_xml`` texts; reports without key payloads have null for them."""
    parsed = texts.select(F.from_xml("xml", SHAPE, {"rowTag": "group"}).alias("g"))
    return parsed.select("g.group_id", "g.number_of_clusters", "g.number_of_protocols", "g.srcIP.src_ip", "g.country.group_country", "g.cluster.cluster_id", "g.cluster.cluster_key_payload")


def read_group_xml(spark, path: str) -> DataFrame:
    """Reports of XML files with ``group`` elements, in the shape of ``from_group_xml``."""
    found = spark.read.format("xml").option("rowTag", "group").schema(SHAPE).load(path)
    return found.select("group_id", "number_of_clusters", "number_of_protocols", "srcIP.src_ip", "country.group_country", "cluster.cluster_id", "cluster.cluster_key_payload")


def first_values(rows: DataFrame, keys: list[str], column: str, most: int) -> DataFrame:
    """``(*keys, column)``: a text of the first ``most`` distinct values in order, with an ellipsis where more follow.

    Equal values are one before they are put in order, and only one value more than are shown goes on to that.  Nulls are left out.
    """
    once = rows.where(F.col(column).isNotNull()).select(*keys, column).distinct()
    ranked = once.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(column)))
    shown = ranked.where(F.col("_n") <= most + 1)

    def text(n: Column, value: Column) -> Column:
        return F.when(n > most, F.lit("...")).otherwise(value.cast("string"))

    listed = F.transform(F.array_sort(F.collect_list(F.struct("_n", column))), lambda x: text(x["_n"], x[column]))
    return shown.groupBy(*keys).agg(F.array_join(listed, ", ").alias(column))


def report_rows(rows: DataFrame, keys: list[str], caps: dict[str, int]) -> DataFrame:
    """``first_values`` of several columns beside each other; a group without any value of one has null there."""
    out = rows.select(*keys).distinct()
    for column, most in caps.items():
        out = out.join(first_values(rows, keys, column, most), keys, "left")
    return out
