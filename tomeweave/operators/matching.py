"""Blocking, fuzzy scoring and grouping of items.

Items have: item_id, rel_path, scope, series, volume, volume_kind, editions. item_id orders them.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tomeweave.functions import columns as C
from tomeweave.operators.cluster import connected_components
from tomeweave.plans.options import Options
from tomeweave.plans.storage import materialize

SUBSTRING, LEAST_SUBSTRING, ONE_SIDED = 0.9, 4, 0.7
MOST_PLAUSIBLE = 999


def with_canonical(items: DataFrame, aliases: dict, column: str = "canon") -> DataFrame:
    """Adds the canonical series: an alias's target, else the series. The table is a user's file and comes as a literal map."""
    if not aliases:
        return items.withColumn(column, F.col("series"))
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return items.withColumn(column, F.coalesce(table[F.col("series")], F.col("series")))


def adopt_scope_series(items: DataFrame, aliases: dict | None = None) -> DataFrame:
    """Gives items without series the one of their folder, if its named items with a volume have just one."""
    known = with_canonical(items, aliases or {}).where("volume is not null and series <> ''")
    donors = (
        known.groupBy("scope")
        .agg(F.min("canon").alias("lo"), F.max("canon").alias("hi"), F.min_by("series", "item_id").alias("donor"))
        .where("lo = hi")
        .select("scope", "donor")
    )
    nameless = F.col("volume").isNotNull() & (F.col("series") == "") & F.col("donor").isNotNull()
    return items.join(donors, "scope", "left").withColumn("series", F.when(nameless, F.col("donor")).otherwise(F.col("series"))).drop("donor").select(*items.columns)


def sequence_ratio(left: Column, right: Column, least: float = 0.0) -> Column:
    """Ratcliff-Obershelp ratio, which depends on the order of its arguments; 0 where the characters shared, as bags, don't reach ``least``."""

    def one(a: str, b: str) -> float:
        matcher = SequenceMatcher(None, a, b)
        return matcher.ratio() if matcher.quick_ratio() >= least else 0.0

    @F.pandas_udf(DoubleType())
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)], dtype=float)

    return run(left, right)


def substring_score(left: Column, right: Column) -> Column:
    """SUBSTRING if the shorter, of LEAST_SUBSTRING characters or more, is in the longer; else null."""
    n = F.least(F.length(left), F.length(right))
    return F.when((n >= LEAST_SUBSTRING) & (F.contains(left, right) | F.contains(right, left)), SUBSTRING)


def cheap_scored(pairs: DataFrame, least: float = 0.0) -> DataFrame:
    """score and method without the sequence ratio, so built-in expressions only; substring wins ties."""
    l, r = F.col("canon_l"), F.col("canon_r")
    part, grams = F.coalesce(substring_score(l, r), F.lit(0.0)), C.dice(l, r)
    one_sided = (l == "") | (r == "")
    score = F.when(one_sided, ONE_SIDED).otherwise(F.greatest(part, grams))
    return pairs.withColumn("score", score).withColumn("method", F.when(one_sided, "one_sided").when(part >= grams, "substring").otherwise("bigram"))


def scored(pairs: DataFrame, least: float = 0.0) -> DataFrame:
    """score and method of pairs (canon_l, canon_r), in the order of the pair.

    Equal 1, both empty 1, one empty ONE_SIDED, else the best of substring, sequence and bigrams, ties in that
    order. Where no bound on the sequence ratio reaches ``least``, it isn't computed.
    """
    l, r = F.col("canon_l"), F.col("canon_r")
    total = F.length(l) + F.length(r)
    shorter = 2.0 * F.least(F.length(l), F.length(r)) / F.greatest(total, F.lit(1))
    fuzzy = (l != "") & (r != "") & (l != r) & (shorter >= least)
    out = pairs.withColumn("part", F.coalesce(substring_score(l, r), F.lit(-1.0))).withColumn("grams", C.dice(l, r))
    out = out.withColumn("seq", sequence_ratio(F.when(fuzzy, l).otherwise(""), F.when(fuzzy, r).otherwise("x"), least))
    best = F.greatest("part", "seq", "grams")
    score = F.when((l == "") & (r == ""), 1.0).when((l == "") | (r == ""), ONE_SIDED).when(l == r, 1.0).otherwise(best)
    method = (
        F.when((l == "") & (r == ""), "volume_only").when((l == "") | (r == ""), "one_sided").when(l == r, "equal")
        .when(F.col("part") == best, "substring").when(F.col("seq") == best, "sequence").otherwise("bigram")
    )
    return out.withColumn("score", score).withColumn("method", method).drop("part", "grams", "seq")


def blocked(items: DataFrame) -> DataFrame:
    """Items with a volume and their block."""
    return items.where("volume is not null").withColumn("block", C.block_key(F.col("volume_kind"), F.col("volume"), F.col("editions")))


def classes(items: DataFrame, aliases: dict | None = None) -> DataFrame:
    """Items with block, canon and rep: the smallest item_id of the block with that canonical series.

    Items of a class have similarity 1, so only classes are compared. first and last are its extreme item_ids.
    """
    rows = with_canonical(blocked(items), aliases or {})
    ends = rows.groupBy("block", "canon").agg(F.min("item_id").alias("rep"), F.max("item_id").alias("last"), F.count("*").alias("n"))
    return rows.join(ends, ["block", "canon"])


def class_pairs(classed: DataFrame, least: float, score: Callable[[DataFrame, float], DataFrame] = scored) -> DataFrame:
    """Scored ordered pairs of a block's classes, as they occur: some item of the left precedes one of the right."""
    reps = classed.where("item_id = rep").select("block", "canon", "rep", "last")
    left = reps.select("block", *(F.col(c).alias(f"{c}_l") for c in ("canon", "rep", "last")))
    right = reps.select("block", *(F.col(c).alias(f"{c}_r") for c in ("canon", "rep", "last")))
    pairs = left.join(right, "block").where("rep_l <> rep_r and rep_l < last_r")
    return score(pairs, least).where(F.col("score") >= least)


def scorer(options: Options) -> Callable[[DataFrame, float], DataFrame]:
    return scored if options.sequence else cheap_scored


def accepted_links(items: DataFrame, options: Options | None = None) -> DataFrame:
    """What a group rests on: block, left_id, right_id, similarity, method of each accepted pair of classes, by their first items."""
    o = options or Options()
    pairs = class_pairs(classes(items, o.aliases).select("item_id", "block", "canon", "rep", "last"), o.review if o.accept_review else o.auto, scorer(o))
    return pairs.select("block", F.col("rep_l").alias("left_id"), F.col("rep_r").alias("right_id"), F.col("score").alias("similarity"), "method")


def group_items(items: DataFrame, options: Options | None = None) -> tuple[DataFrame, DataFrame]:
    """(groups, reviews) of items whose series have been adopted.

    groups: item_id, block, group_id (smallest item_id), group_key, similarity (least accepted score, 1 if none),
    pos. reviews: left_id, right_id, similarity, method for every pair of items in the gray zone that is not
    approved. Items without volume are in neither.
    """
    groups, reviews, _ = grouped_with_gray(items, options)
    return groups, reviews


def grouped_with_gray(items: DataFrame, options: Options | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """group_items, and the pairs of classes in the gray zone that reviews are made from: rep_l, rep_r, score, method."""
    o = options or Options()
    classed = classes(items, o.aliases).select("item_id", "rel_path", "block", "canon", "rep", "last", "n")
    pairs = materialize(class_pairs(classed, o.review, scorer(o)))  # read several times below; scoring is the costly part
    sure = F.lit(True) if o.accept_review else F.col("score") >= o.auto
    accepted = pairs.where(sure).select(F.col("rep_l").alias("src"), F.col("rep_r").alias("dst"), "score")
    gray = pairs.where(~sure)
    members = classed.select("item_id", "rep", "rel_path")
    expanded = (
        gray.join(members.select(F.col("item_id").alias("left_id"), F.col("rep").alias("rep_l"), F.col("rel_path").alias("path_l")), "rep_l")
        .join(members.select(F.col("item_id").alias("right_id"), F.col("rep").alias("rep_r"), F.col("rel_path").alias("path_r")), "rep_r")
        .where("left_id < right_id")
    )
    if o.approved:
        keys = F.array(*(F.lit("\x00".join(sorted(p))) for p in o.approved))
        ok = F.array_contains(keys, F.array_join(F.array_sort(F.array("path_l", "path_r")), "\x00"))
        approved = expanded.where(ok)
        accepted = accepted.unionByName(approved.select(F.col("rep_l").alias("src"), F.col("rep_r").alias("dst"), "score"))
        expanded = expanded.where(~ok)
    reviews = expanded.select("left_id", "right_id", F.col("score").alias("similarity"), "method")

    loops = classed.where("item_id = rep").select(F.col("rep").alias("src"), F.col("rep").alias("dst"))
    placed = connected_components(accepted.select("src", "dst").unionByName(loops))
    least = accepted.join(placed, accepted["src"] == placed["node"]).groupBy("component").agg(F.min("score").alias("least"))
    groups = (
        classed.join(placed, classed["rep"] == placed["node"])
        .join(least, "component", "left")
        .select("item_id", "block", F.col("component").alias("group_id"), F.concat("block", F.lit("#"), "component").alias("group_key"), F.coalesce("least", F.lit(1.0)).alias("similarity"), F.col("item_id").alias("pos"))
    )
    return groups, reviews, gray.select("rep_l", "rep_r", "score", "method")


def review_ends(gray: DataFrame, items: DataFrame, shown: DataFrame, options: Options | None = None) -> DataFrame:
    """Both ends of every review: the columns of ``shown`` (of an item_id), similarity as written, method, other.

    The rows that reviews would give, but each item meets the classes it is alike to before their members, so
    nothing is shuffled that grows with the pairs of items.
    """
    o = options or Options()
    members = classes(items, o.aliases).select("item_id", "rep", *["rel_path"] * bool(o.approved))
    gray = gray.withColumn("similarity", C.fixed(F.col("score"), 2)).drop("score")
    ways = gray.select(F.col("rep_l").alias("rep"), F.col("rep_r").alias("rep_o"), "similarity", "method", F.lit(True).alias("ahead")).unionByName(
        gray.select(F.col("rep_r").alias("rep"), F.col("rep_l").alias("rep_o"), "similarity", "method", F.lit(False).alias("ahead"))
    )
    others = members.select(F.col("rep").alias("rep_o"), F.col("item_id").alias("other"), *(F.col(c).alias("path_o") for c in members.columns[2:]))
    ends = members.join(shown, "item_id").join(ways, "rep").join(others, "rep_o").where(F.col("ahead") == (F.col("item_id") < F.col("other")))
    if o.approved:
        keys = F.array(*(F.lit("\x00".join(sorted(p))) for p in o.approved))
        ends = ends.where(~F.array_contains(keys, F.array_join(F.array_sort(F.array("rel_path", "path_o")), "\x00")))
    return ends.select(*shown.columns, "similarity", "method", "other")
