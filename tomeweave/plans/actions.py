"""What would be done with each item, as data, and the evidence for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeweave.functions import columns as C
from tomeweave.plans.options import Options


def numbered(name: Column, nth: Column) -> Column:
    """'name.ext' for the first, 'name (2).ext' and so on for the others."""
    ext = F.regexp_extract(name, r"[^/](\.[^./]+)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    return F.when(nth == 1, name).otherwise(F.concat(stem, F.format_string(" (%d)", nth), ext))


def collision_free(rows: DataFrame, folder: str, name: str, order: str, out: str = "destination") -> DataFrame:
    """Adds ``out``: folder/name, equal ones numbered by ``order``. Names differ from all numbered ones by construction only
    within one original name, as with files placed one after the other."""
    nth = F.row_number().over(Window.partitionBy(folder, name).orderBy(order))
    return rows.withColumn(out, F.concat_ws("/", F.when(F.col(folder) != "", F.col(folder)), numbered(F.col(name), nth)))


def loser_actions(decisions: DataFrame, items: DataFrame, options: Options | None = None) -> DataFrame:
    """item_id, action, source, destination, result of every loser: moved below the duplicates folder, or deleted."""
    o = options or Options()
    rows = decisions.where("role = 'loser'").join(items.select("item_id", "rel_path", "kind", "volume"), "item_id")
    path = C.place_of(F.col("rel_path"), F.col("kind"))
    if o.delete_losers:
        return rows.select("item_id", F.lit("delete").alias("action"), F.col("rel_path").alias("source"), F.lit(None).cast("string").alias("destination"), F.lit("planned").alias("result"))
    parent = F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")
    name = F.when(F.col("kind") == "imageset", F.concat(C.base_name(path), F.format_string(" 第%s巻", "volume"))).otherwise(C.base_name(path))
    rows = rows.withColumn("folder", F.concat_ws("/", F.lit(o.folders["duplicates"]), F.when(parent != "", parent))).withColumn("name", name)
    rows = collision_free(rows, "folder", "name", "item_id")
    return rows.select("item_id", F.lit("move").alias("action"), F.col("rel_path").alias("source"), "destination", F.lit("planned").alias("result"))


def survivors(items: DataFrame, decisions: DataFrame, options: Options | None = None) -> DataFrame:
    """Items that are no losers, not in the duplicates folder, the first for each place."""
    folder = (options or Options()).folders["duplicates"]
    inside = F.array_contains(F.split("rel_path", "/"), folder)
    alive = items.where(~inside).join(decisions.where("role = 'loser'").select("item_id"), "item_id", "left_anti")
    return alive.join(alive.groupBy("rel_path").agg(F.min("item_id").alias("item_id")).select("item_id"), "item_id", "left_semi")


def flatten_plan(items: DataFrame, alive: DataFrame, names: DataFrame, decisions: DataFrame, outliers: DataFrame, options: Options | None = None) -> DataFrame:
    """item_id, route (excluded, held_undecided, held_collision, placed), destination of each survivor.

    Outliers go to the excluded folder and undecided ones to the held folder under their own name. Of equal unified names,
    ignoring case, the first in item order is placed, the others are held.
    """
    o = options or Options()
    marks = outliers.select("item_id", F.lit(True).alias("odd")).distinct()
    open_ = decisions.where("role = 'undecided'").select("item_id", F.lit(True).alias("open")).distinct()
    rows = alive.select("item_id", "rel_path").join(names, "item_id", "left").join(marks, "item_id", "left").join(open_, "item_id", "left")
    rows = rows.withColumn("first_route", F.when(F.col("odd"), "excluded").when(F.col("open"), "held_undecided").otherwise("placed"))
    nth = F.row_number().over(Window.partitionBy("first_route", F.coalesce(F.lower("unified_name"), F.concat(F.lit("\x00"), "item_id"))).orderBy("item_id"))
    rows = rows.withColumn("route", F.when((F.col("first_route") == "placed") & F.col("unified_name").isNotNull() & (nth > 1), "held_collision").otherwise(F.col("first_route")))
    own = C.base_name(F.col("rel_path"))
    plain = F.coalesce(F.nullif(C.file_safe(C.without_suffix(own)), F.lit("")), own)
    folder = F.when(F.col("route") == "excluded", o.folders["excluded"]).when(F.col("route") == "placed", "").otherwise(o.folders["held"])
    rows = rows.withColumn("folder", folder).withColumn("name", F.when(F.col("route") == "placed", F.coalesce("unified_name", plain)).otherwise(own))
    return collision_free(rows, "folder", "name", "item_id").select("item_id", "route", "destination")


def shown(items: DataFrame) -> DataFrame:
    """item_id and what the evidence table shows of an item."""
    return items.select(
        "item_id", F.col("rel_path").alias("path"), "kind", F.col("page_count").alias("pages"), F.rint(F.coalesce("median_pixels", F.lit(0.0))).cast("bigint").cast("string").alias("median_pixels"),
        C.fixed(F.coalesce("median_bpp", F.lit(0.0)), 4).alias("bytes_per_pixel"), "total_bytes",
    )


def ends_of(reviews: DataFrame, shown: DataFrame) -> DataFrame:
    """Both ends of each review: the columns of ``shown``, similarity as written, method, other."""
    ends = reviews.select(F.explode(F.array(*(F.struct(F.col(a).alias("item_id"), F.col(b).alias("other")) for a, b in (("left_id", "right_id"), ("right_id", "left_id"))))).alias("e"), "similarity", "method")
    return ends.select("e.*", C.fixed(F.col("similarity"), 2).alias("similarity"), "method").join(shown, "item_id")


def evidence(groups: DataFrame, decisions: DataFrame, ends: DataFrame, shown: DataFrame, actions: DataFrame) -> DataFrame:
    """Rows of the evidence table: members of duplicate groups, and both ends of each pair to review."""
    own = [c for c in shown.columns if c != "item_id"]
    base = decisions.join(groups.select("item_id", "similarity"), "item_id").join(shown, "item_id").join(actions.select("item_id", "result"), "item_id", "left")
    role = F.when(F.col("role") == "undecided", "pending").otherwise(F.col("role"))
    members = base.select(
        F.col("group_key").alias("group"), role.alias("role"), *own, C.fixed(F.col("similarity"), 2).alias("similarity"), F.col("reason_code").alias("reason"), F.coalesce("result", F.lit("keep")).alias("result")
    )
    gray = ends.select(
        F.lit("review").alias("group"), F.lit("pending").alias("role"), *own, "similarity", F.concat("method", F.lit(":"), "other").alias("reason"), F.lit("skipped").alias("result")
    )
    return members.unionByName(gray)


def summary(items: DataFrame, groups: DataFrame, decisions: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row of counters."""
    n = lambda df, where="true": df.where(where).agg(F.count("*").alias("n"))
    parts = {
        "n_items": n(items),
        "n_no_volume": n(items, "volume is null"),
        "n_unmeasured": n(items, "not measured"),
        "n_duplicate_groups": n(groups.groupBy("group_key").count().where("count > 1")),
        "n_losers": n(decisions, "role = 'loser'"),
        "n_undecided": n(decisions, "role = 'undecided'"),
        "n_reviews": n(reviews),
    }
    out = None
    for name, df in parts.items():
        row = df.select(F.col("n").alias(name))
        out = row if out is None else out.crossJoin(row)  # one row each
    return out.withColumn("n_pending", F.col("n_no_volume") + F.col("n_undecided") + F.col("n_reviews"))


def zip_mismatches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """name, problem of expected entries that are missing or of other size or method in the written archive."""
    a = actual.select("name", F.col("size").alias("got_size"), F.col("method").alias("got_method"), F.lit(True).alias("there"))
    rows = expected.join(a, "name", "left")
    problem = F.when(F.col("there").isNull(), "missing").when(F.col("got_method") != F.col("method"), "method").when(F.col("got_size") != F.col("size"), "size")
    return rows.select("name", problem.alias("problem")).where("problem is not null")
