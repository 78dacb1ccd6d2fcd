"""One query for each operator, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, embedding_dedup, main_text, neighbours, ngram_join, oracles, packing, pii, quality, substring_dedup, toxicity, warc, whitening

#: Key of the pseudonyms in these queries; whoever uses the operator brings a secret one.
EXAMPLE_KEY = b"key for examples only"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by the Jaccard similarity of their 5-word shingles."""
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"), 80, 5)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked by a cosine of 0.95 or more."""
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), 0.95)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without windows of 20 words that start earlier elsewhere."""
    kept = substring_dedup.remove_duplicate_spans(_table(spark, sf_dir, "documents"), 20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the texts back from them."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packing.packed_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 2048)


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth."""
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text."""
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "toxic", 5, 0, 0.5)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text."""
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "quality", 4, 2, 0.7)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with pseudonyms for personal data, and how many of each kind."""
    found = pii.protect(_table(spark, sf_dir, "documents"), EXAMPLE_KEY)
    return found.select("doc_id", "text", "n_found", *(F.coalesce(F.col("found")[kind], F.lit(0)).cast("long").alias(f"n_{kind}") for kind, _, _ in pii.KINDS))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the words of each source diverge from those of the others and of its language."""
    return divergence.audit(_table(spark, sf_dir, "documents"), 30, 50)


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text.main_text(_table(spark, sf_dir, "pages"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector along the eight components of the largest deviation, each scaled to one."""
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"), 8)
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))  # null where it doesn't fit


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_ngram_join, op2_embedding_dedup, op3_substring_dedup, op4_bpe, op5_packing, op6_neighbours, op7_toxicity, op8_quality, op9_warc, op10_pii, op11_divergence, op12_main_text, op13_whitening)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": oracles.NGRAM_JOIN, "op2_embedding_dedup": oracles.EMBEDDING_DEDUP, "op3_substring_dedup": oracles.SUBSTRING_DEDUP, "op9_warc": oracles.WARC, "op11_divergence": oracles.DIVERGENCE}
