"""Bounded, repeatable samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the doc_id as text leaves 2 when divided by 4; a null doc_id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def stratified(rows: DataFrame, label: str, per_label: int, key: str = "doc_id", salt: str = "fit") -> DataFrame:
    """About ``per_label`` rows of each label value: those whose hash of ``salt`` and ``key`` is below the label's share."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # one row a label value
    shares = [F.lit(x) for k, n in counts.items() if k is not None for x in (k, min(1.0, per_label / n))]
    if not shares:
        return rows.limit(0)
    draw = F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(draw < F.create_map(*shares)[F.col(label)])
