"""Intermediate tables of loops, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Whether what a query has shuffled goes with its end; else it stays until the driver collects its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where unset, a temporary folder in local runs and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def new_folder(spark: SparkSession) -> str:
    """A path of its own below the shared folder; what is written there goes when Python ends."""
    path = f"{_folder(spark)}/rows-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


@contextlib.contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries that begin here leave no shuffled files behind; the session's own setting comes back."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet and read again: cuts the lineage of a loop, survives lost executors.

    The files go when Python ends, or earlier by ``forget``; what was shuffled on the way goes as soon as they are written.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    with _cleaned(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def kept_together(tables: list[DataFrame]) -> DataFrame:
    """All rows of ``kept`` tables of one schema, as one scan."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*(df._kept_at for df in tables))


def forget(*tables: DataFrame) -> None:
    """Removes the files of ``kept`` tables that nothing reads any more."""
    for df in tables:
        if hasattr(df, "_kept_at"):
            _remove(df.sparkSession, df._kept_at)
