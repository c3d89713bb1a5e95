"""Per-item metrics from sampled pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_positions(n: Column, k: int) -> Column:
    """0-based places of a systematic sample of at most k of n, both ends included; k = 1 takes the first."""
    if k == 1:
        return F.when(n > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (n - 1) / F.lit(k - 1)).cast("int"))
    all_ = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= k, all_).otherwise(F.array_distinct(spread))


def sampled(pages: DataFrame, k: int, order: list[str]) -> DataFrame:
    """The sampled pages of each item, by place in ``order``."""
    w = Window.partitionBy("item_id")
    placed = pages.withColumn("at", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n", F.count("*").over(w).cast("int"))
    return placed.where(F.array_contains(sample_positions(F.col("n"), k), F.col("at"))).drop("n")


def item_metrics(pages: DataFrame) -> DataFrame:
    """item_id, page_count, total_bytes, median_pixels and median_bpp (0 where no page has a size)."""
    pixels = F.col("width").cast("bigint") * F.col("height")
    bpp = F.when(pixels > 0, F.col("size_bytes") / pixels).otherwise(0.0)
    return pages.groupBy("item_id").agg(
        F.count("*").cast("int").alias("page_count"),
        F.sum("size_bytes").alias("total_bytes"),
        F.coalesce(F.median(pixels), F.lit(0.0)).alias("median_pixels"),
        F.coalesce(F.median(bpp), F.lit(0.0)).alias("median_bpp"),
    )


def content_match(left: Column, right: Column, distance: int = 6) -> Column:
    """Share of the left hashes with a right hash within ``distance``; null if either side has none."""
    near = F.filter(left, lambda a: F.exists(right, lambda b: F.bit_count(a.bitwiseXOR(b)) <= distance))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), F.size(near) / F.size(left))
