"""Unified names by majority vote within a series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomeweave.functions import columns as C
from tomeweave.operators.cluster import connected_components
from tomeweave.operators.matching import scorer, with_canonical
from tomeweave.plans.options import CHAPTER, CHAPTER_ONLY, Options
from tomeweave.plans.storage import materialize

LEAST_DIGITS, LEAST_CHAPTER_DIGITS = 2, 3


def series_clusters(items: DataFrame, groups: DataFrame, options: Options) -> DataFrame:
    """(item_id, cluster) of items with a series: alike series, and members of one duplicate group.

    Only distinct (series, editions) are compared, smaller first item_id on the left.
    """
    rows = with_canonical(items, options.aliases).withColumn("ed", F.array_join("editions", ","))
    nodes = rows.where("series <> ''").groupBy("canon", "ed").agg(F.min("item_id").alias("rep"))
    left, right = (nodes.select(F.col("ed"), F.col("canon").alias(f"canon_{s}"), F.col("rep").alias(f"rep_{s}")) for s in "lr")
    alike = scorer(options)(left.join(right, "ed").where("rep_l < rep_r"), options.auto).where(F.col("score") >= options.auto)
    own = rows.where("series <> ''").join(nodes, ["canon", "ed"]).select("item_id", "rep")
    linked = groups.select("item_id", "group_id").where("item_id <> group_id").select(F.col("item_id").alias("src"), F.col("group_id").alias("dst"))
    edges = alike.select(F.col("rep_l").alias("src"), F.col("rep_r").alias("dst")).unionByName(own.select(F.col("item_id").alias("src"), F.col("rep").alias("dst"))).unionByName(linked)
    placed = connected_components(edges)
    return own.select("item_id").join(placed, F.col("item_id") == F.col("node")).select("item_id", F.col("component").alias("cluster"))


def best_names(clustered: DataFrame, name: str = "display") -> DataFrame:
    """(cluster, label): Japanese first, then the most frequent, the longest, the first in order."""
    counts = clustered.where(F.col(name) != "").groupBy("cluster", F.col(name).alias("label")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("cluster").orderBy(C.has_japanese(F.col("label")).desc(), F.desc("n"), F.length("label").desc(), "label")
    return counts.withColumn("at", F.row_number().over(order)).where("at = 1").select("cluster", "label")


def plan_names(items: DataFrame, groups: DataFrame, survivors: DataFrame, options: Options | None = None) -> DataFrame:
    """(item_id, unified_name) of survivors with a volume; all members of duplicate groups vote.

    Items need series, display, editions, volume, volume_kind; survivors item_id.
    """
    o = (options or Options()).checked()
    many = groups.join(groups.groupBy("group_key").count().where("count > 1").select("group_key"), "group_key", "left_semi")
    universe = items.join(survivors.select("item_id").unionByName(many.select("item_id")).distinct(), "item_id", "left_semi")
    clusters = materialize(series_clusters(universe, many, o))
    labels = best_names(clusters.join(universe.select("item_id", "display"), "item_id"))
    biggest = clusters.groupBy("cluster").agg(F.count("*").alias("n"), F.min("item_id").alias("first")).agg(F.max_by("cluster", F.struct(F.col("n"), -F.col("first"))).alias("cluster"))
    default = biggest.join(labels, "cluster", "left").select(F.coalesce("label", F.lit(o.fallback_series)).alias("default"))
    rows = items.where("volume is not null").join(survivors.select("item_id"), "item_id", "left_semi").select("item_id", "volume", "volume_kind")
    widest = F.aggregate(F.split("volume", "-"), F.lit(0), lambda a, p: F.greatest(a, F.greatest(F.length(F.regexp_replace(p, "^0+", "")), F.lit(1))))
    chapter = F.col("volume_kind") == "chapter"
    digits = rows.agg(
        F.greatest(F.max(F.when(~chapter, widest)), F.lit(LEAST_DIGITS)).alias("d"), F.greatest(F.max(F.when(chapter, widest)), F.lit(LEAST_CHAPTER_DIGITS)).alias("dc")
    )
    named = rows.join(clusters, "item_id", "left").join(labels, "cluster", "left").join(F.broadcast(default)).join(F.broadcast(digits))  # one row each
    series = C.file_safe(F.substring(C.file_safe(F.coalesce("label", "default")), 1, C.LONGEST_SERIES))
    named = named.withColumn("s", series).withColumn("v", C.padded(F.col("volume"), F.when(chapter, F.col("dc")).otherwise(F.col("d"))))
    folders = o.folders
    with_series = F.when(chapter, F.format_string(CHAPTER, "s", "v")).otherwise(F.format_string(folders["volume"], "s", "v"))
    alone = F.when(chapter, F.format_string(CHAPTER_ONLY, "v")).otherwise(F.format_string(folders["volume_only"], "v"))
    return named.select("item_id", F.when(F.col("s") != "", with_series).otherwise(alone).alias("unified_name"))
