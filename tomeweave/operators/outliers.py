"""Items whose size is far from that of their neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomeweave.functions import columns as C

LOW, HIGH, LEAST_MEMBERS = 0.25, 4.0, 4
LEAST_PAGES, LEAST_BYTES = 0.3, 0.25


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, n and mid, the exact median of a positive ``value``.

    No key's values meet in one task: counts by narrow classes of size tell in which classes the middle ranks lie, and only values of
    those are counted one by one.
    """
    size = F.floor(F.log2(F.col(value)) * F.lit(256)).cast("int")
    classed = rows.select(key, F.col(value).alias("v"), size.alias("class"))
    counts = classed.groupBy(key, "class").agg(F.count("*").alias("c"))
    w = Window.partitionBy(key).orderBy("class")  # some thousands of classes a key at most
    placed = counts.withColumn("n", F.sum("c").over(Window.partitionBy(key))).withColumn("start", F.sum("c").over(w) - F.col("c"))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    middle = placed.where((F.col("start") <= high) & (F.col("start") + F.col("c") > low)).select(key, "class", "n", "start")
    each = classed.join(middle, [key, "class"]).groupBy(key, "class", "n", "start", "v").agg(F.count("*").alias("c"))
    run = Window.partitionBy(key, "class").orderBy("v")
    each = each.withColumn("end", F.col("start") + F.sum("c").over(run)).withColumn("begin", F.col("end") - F.col("c"))
    held = lambda rank: F.max(F.when((F.col("begin") <= rank) & (F.col("end") > rank), F.col("v").cast("double")))
    return each.groupBy(key, "n").agg(((held(low) + held(high)) / 2).alias("mid"))


def judged(items: DataFrame) -> DataFrame:
    """Single volumes with measured pages and a size."""
    return items.where("measured and total_bytes > 0 and volume_kind = 'number' and volume is not null")


def scope_outliers(items: DataFrame) -> DataFrame:
    """item_id, rule, ratio for items far off the median of the nearest folder with LEAST_MEMBERS judged items.

    Every item counts in each of its ancestors.
    """
    rows = judged(items).select("item_id", "total_bytes", F.explode(C.ancestors(F.col("scope"))).alias("ancestor"))
    stats = medians(rows, "ancestor", "total_bytes").where(F.col("n") >= LEAST_MEMBERS)
    nearest = rows.join(stats, "ancestor").groupBy("item_id", "total_bytes").agg(F.max_by("mid", F.length("ancestor")).alias("mid"))
    ratio = F.col("total_bytes") / F.col("mid")
    rule = F.when(ratio < LOW, "small").when(ratio > HIGH, "large")
    return nearest.select("item_id", rule.alias("rule"), ratio.alias("ratio")).where("rule is not null")


def job_outliers(items: DataFrame) -> DataFrame:
    """item_id, rule, ratio for items far below the job's median; ranges count as so many volumes."""
    rows = items.where("measured and total_bytes > 0 and volume is not null and volume_kind in ('number', 'range')")
    overall = medians(judged(items).select(F.lit(0).alias("all"), "total_bytes"), "all", "total_bytes").where(F.col("n") >= LEAST_MEMBERS).select("mid")
    ends = F.split("volume", "-")
    span = F.when(F.col("volume_kind") == "range", ends[1].cast("int") - ends[0].cast("int") + 1).otherwise(1)
    ratio = F.col("total_bytes") / (F.col("mid") * span)
    rows = rows.join(F.broadcast(overall))  # one row
    return rows.select("item_id", F.when(F.col("volume_kind") == "range", "small_range").otherwise("small_overall").alias("rule"), ratio.alias("ratio")).where(F.col("ratio") < LOW)


def size_outliers(items: DataFrame) -> DataFrame:
    """Both rules, the folder's first."""
    first = scope_outliers(items)
    return first.unionByName(job_outliers(items).join(first.select("item_id"), "item_id", "left_anti"))


def thin_members(members: DataFrame) -> DataFrame:
    """item_id, rule, ratio for measured members of a group with far fewer pages or bytes than its largest."""
    rows = members.where("measured").select("group_key", "item_id", "page_count", "total_bytes")
    most = rows.groupBy("group_key").agg(F.count("*").alias("n"), F.max("page_count").alias("p"), F.max("total_bytes").alias("b")).where("n > 1")
    pages, size = F.col("page_count") / F.col("p"), F.col("total_bytes") / F.col("b")
    few = (F.col("p") > 0) & (F.col("page_count") < F.col("p") * LEAST_PAGES)
    small = (F.col("b") > 0) & (F.col("total_bytes") < F.col("b") * LEAST_BYTES)
    return (
        rows.join(most, "group_key")
        .select("item_id", F.when(few, "few_pages").when(small, "small_in_group").alias("rule"), F.when(few, pages).when(small, size).alias("ratio"))
        .where("rule is not null")
    )
