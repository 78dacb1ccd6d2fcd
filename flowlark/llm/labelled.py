"""Labelled rows for the classifiers: a bounded sample, apart from held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(of)).cast("int")


def sample(labels: DataFrame, label: str, usable: Column, rows: int) -> DataFrame:
    """``doc_id, label`` of at most ``rows`` labelled documents, chosen by a hash of the id.

    Rows without an id or a label are left out; of several labels of a document, the largest counts.
    """
    good = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable)
    good = good.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def training_texts(docs: DataFrame, chosen: DataFrame, longest: int | None = None) -> DataFrame:
    """``doc_id, label, text`` of the chosen documents, one row for each doc_id: of its texts the last in order.

    With ``longest``, only texts of at most so many characters are learnt from, which bounds the sample's bytes too.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    if longest is not None:
        found = found.where(F.coalesce(F.length("text") <= longest, F.lit(True)))
    return found.groupBy("doc_id").agg(F.max("label").alias("label"), F.max("text").alias("text"))
