"""From raw documents to packed sequences, in stages that each call one operator.

All stages take nulls in any column, empty and very long texts, repeated rows, empty tables and further columns of any
name; all but the last return the columns of their documents, with what they don't change as it was.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlark.llm import ngram_join, packing, pii, quality, substring_dedup
from flowlark.llm.queries import EXAMPLE_KEY
from flowlark.llm.scratch import dropped, saved


def _carried(docs: DataFrame) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """(documents whose other columns have names that no operator uses, these names and the text's, the way back)."""
    names = {c: c if c in ("doc_id", "text") else f"_c{i}" for i, c in enumerate(docs.columns)}
    moved = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    return moved, [n for n in names.values() if n != "doc_id"], lambda df: df.select(*(F.col(n).alias(c) for c, n in names.items()))


def _counted(docs: DataFrame, back: DataFrame, changed: Column) -> DataFrame:
    """``back`` with the characters of changed texts counted again, where documents have that column."""
    if "n_chars" not in docs.columns:
        return back
    name = f"_c{docs.columns.index('n_chars')}"
    return back.withColumn(name, F.when(changed, F.length("text").cast("long")).otherwise(F.col(name)))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts are scored like others, repeated rows alike; rows without a doc_id are scored too and serve no training.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    moved, columns, back = _carried(docs)
    return back(quality.score(moved, labels, "quality", 4, 2, 0.7, columns=columns).where("predicted = 1"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by the similarity of their shingles, that with the smallest doc_id; of rows with one doc_id that with the longest text.

    Rows without a doc_id can't be linked and stay; so do null and empty texts, which are like nothing.
    """
    known = docs.where("doc_id is not null")
    repeated = saved(known.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.length("text").desc_nulls_last(), "text"))
        longest = known.join(repeated, "doc_id", "left_semi").withColumn("_place", place).where("_place = 1").select(*docs.columns)
        known = saved(known.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(longest), "once")
    groups = ngram_join.ngram_components(known.select("doc_id", "text"), 80, 5)
    kept = known.join(groups.where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words and more stay where they come first; documents of which nothing is left go.

    Rows without a doc_id have no place in the order and stay whole; null, empty and short texts lose nothing; rows of one doc_id
    share their places, so that a repeated row takes nothing from the other.
    """
    moved, columns, back = _carried(docs)
    cut = substring_dedup.remove_duplicate_spans(moved, 20, ["doc_id", *columns]).where("n_removed = 0 or n_removed < n_words")
    changed = F.col("n_removed") > 0
    kept = cut.withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text")))
    return back(_counted(docs, kept, changed)).unionByName(docs.where("doc_id is null"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms; every row stays, null and empty texts as they are."""
    moved, columns, back = _carried(docs)
    safe = pii.protect(moved, EXAMPLE_KEY, ["doc_id", *columns])
    return back(_counted(docs, safe, F.col("n_found") > 0))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left in sequences of 2048 tokens; each row is a document, with a null or empty text its end alone."""
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each_group),
    ("repeats", cut_repeats),
    ("personal_data", pseudonymise),
    ("packing", pack),
]

#: The classifier and the packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, each written and read again, on the documents of ``sf_dir``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
        dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
