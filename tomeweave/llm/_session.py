"""Files below the shared folder; tables there are the library's ``materialize``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave.plans.storage import file_system, materialize, work_dir

__all__ = ["bound_batches", "file_system", "materialize", "texts", "unused", "work_dir"]

#: Bytes of an Arrow batch between Spark and its Python workers. Rows are whole texts; Spark's own bound is 64 MB.
BATCH_BYTES = 4 << 20
_BOUND, _SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", (str(64 << 20), f"{64 << 20}b", "64m")


def bound_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_BYTES, unless it has a bound of its own."""
    if spark.conf.get(_BOUND, None) in _SPARKS_OWN:
        spark.conf.set(_BOUND, str(BATCH_BYTES))


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as no column of ``docs`` has."""
    taken, mark = {c.lower() for c in docs.columns}, "_"
    while any((mark + n).lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs``, in batches of bounded size."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
