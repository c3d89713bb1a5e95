"""Second grouping of folders that hold more volumes than their numbers allow.

If a folder's subtree has more groups of single volumes than its highest volume number, the same
volume stands in several groups. Then groups with equal block are merged whatever their series.
Folders of one depth don't overlap, so each depth is one aggregation; depths run from the deepest up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomeweave.functions import columns as C
from tomeweave.operators.matching import MOST_PLAUSIBLE, scorer, with_canonical
from tomeweave.plans.options import Options
from tomeweave.plans.storage import materialize


def single_groups(groups: DataFrame, items: DataFrame) -> DataFrame:
    """Groups whose first item is a single plausible volume: group_key, block, number, first, canon, home, deep.

    home is the deepest folder that holds all items, deep its depth.
    """
    rows = groups.join(items.select("item_id", "scope", "volume", "volume_kind", "canon"), "item_id")
    parts = F.split("scope", "/")
    made = rows.groupBy("group_key", "block").agg(
        F.min_by(F.struct("item_id", "volume", "volume_kind", "canon"), "pos").alias("f"), F.min("scope").alias("lo"), F.max("scope").alias("hi")
    )
    # the least and the greatest scope in part order share what all share
    made = made.join(rows.groupBy("group_key").agg(F.min(parts).alias("a"), F.max(parts).alias("b")), "group_key")
    same = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size("a"), F.size("b"))), lambda i: F.slice("a", F.lit(1), i) == F.slice("b", F.lit(1), i)))
    deep = F.when((F.col("lo") == "") | (F.col("hi") == ""), 0).otherwise(same)
    made = made.withColumn("deep", deep).withColumn("home", F.when(F.col("deep") == 0, "").otherwise(C.prefix(F.col("lo"), F.col("deep"))))
    number = F.col("f.volume").cast("int")
    return made.where((F.col("f.volume_kind") == "number") & (number <= MOST_PLAUSIBLE)).select(
        "group_key", "block", number.alias("number"), F.col("f.item_id").alias("first"), F.col("f.canon").alias("canon"), "home", "deep"
    )


def overflowing(singles: DataFrame, depth: int) -> DataFrame:
    """Folders of one depth with more groups than their highest number: scope, n_groups, max_volume."""
    under = singles.where(F.col("deep") >= depth).withColumn("scope", C.prefix(F.col("home"), F.lit(depth)) if depth else F.lit(""))
    return under.groupBy("scope").agg(F.count("*").alias("n_groups"), F.max("number").alias("max_volume")).where("n_groups > max_volume")


def retry_overflow(groups: DataFrame, reviews: DataFrame, items: DataFrame, options: Options | None = None) -> tuple[DataFrame, DataFrame]:
    """(groups, reviews) with the merges done and the reviews inside merged folders dropped."""
    o = options or Options()
    items = with_canonical(items, o.aliases)
    singles = materialize(single_groups(groups, items))
    deepest = singles.agg(F.max("deep")).first()[0]
    merges = None  # group_key -> new_key, order
    for depth in range(deepest or 0, -1, -1) if deepest is not None else ():
        scope = C.prefix(F.col("home"), F.lit(depth)) if depth else F.lit("")
        under = singles.where(F.col("deep") >= depth).withColumn("scope", scope).join(overflowing(singles, depth).select("scope"), "scope", "left_semi")
        many = under.groupBy("scope", "block").count().where("count > 1").select("scope", "block")
        now = under.join(many, ["scope", "block"]).withColumn("new_key", F.concat("block", F.lit("#relaxed:"), F.when(F.col("scope") == "", ".").otherwise(F.col("scope"))))
        now = materialize(now.select("group_key", "new_key", "scope", "first", "canon"))
        if now.limit(1).count():
            merges = now if merges is None else merges.unionByName(now)
            singles = materialize(singles.join(now, "group_key", "left_anti"))
    if merges is None:
        return groups, reviews
    left, right = (merges.select("new_key", F.col("first").alias(f"first_{s}"), F.col("canon").alias(f"canon_{s}")) for s in "lr")
    pairs = scorer(o)(left.join(right, "new_key").where("first_l < first_r")).groupBy("new_key").agg(F.min("score").alias("similarity"))
    moved = groups.join(merges.select("group_key", "new_key", "first"), "group_key")
    order = Window.partitionBy("new_key").orderBy("first", "pos")
    fresh = moved.withColumn("pos", F.row_number().over(order).cast("bigint")).withColumn("group_id", F.min("group_id").over(Window.partitionBy("new_key")))
    fresh = fresh.drop("group_key", "similarity").join(pairs, "new_key").withColumnRenamed("new_key", "group_key")
    kept = groups.join(merges.select("group_key"), "group_key", "left_anti")
    again = merges.select("scope").distinct()
    homes = items.select("item_id", F.explode(C.ancestors(F.col("scope"))).alias("scope")).join(again, "scope")
    both = (
        reviews.join(homes.select(F.col("item_id").alias("left_id"), F.col("scope").alias("s")), "left_id")
        .join(homes.select(F.col("item_id").alias("right_id"), F.col("scope").alias("s")), ["right_id", "s"])
        .select("left_id", "right_id").distinct()
    )
    return kept.unionByName(fresh.select(*kept.columns)), reviews.join(both, ["left_id", "right_id"], "left_anti")
