"""Adding columns computed from the text to rows whose other columns pass through."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tomeweave.llm._session import bound_batches
from tomeweave.llm._text import col, sliced


def with_columns(docs: DataFrame, added: StructType, make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], max_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` with the columns ``added``, which replace ones of equal name.

    ``make`` is called once a task and returns a function from a batch (with column text) to the new columns. Names are
    set aside meanwhile, as Arrow functions don't take names with dots.
    """
    keep = [f for f in docs.schema if f.name not in added.fieldNames()]
    plain = ["text" if f.name == "text" else f"c{i}" for i, f in enumerate(keep)]
    inner = StructType([StructField(n, f.dataType, True) for n, f in zip(plain, keep, strict=True)] + [StructField(f"new{i}", f.dataType, True) for i, f in enumerate(added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in sliced(batches, "text", max_bytes):
            yield pa.RecordBatch.from_arrays([*(col(batch, n) for n in plain), *work(batch)], inner.fieldNames())

    bound_batches(docs.sparkSession)
    rows = docs.select(*(F.col(f"`{f.name}`").alias(n) for n, f in zip(plain, keep, strict=True)))
    return rows.mapInArrow(run, inner).toDF(*(f.name for f in keep), *added.fieldNames())
