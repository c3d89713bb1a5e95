"""The analysis from items to evidence; a pure query."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeweave.functions import columns as C
from tomeweave.functions.title import parsed
from tomeweave.operators import matching, names, outliers, overflow, winners
from tomeweave.plans import actions
from tomeweave.plans.options import Options
from tomeweave.plans.storage import materialize


class Result:
    """The analysis's tables, each made when it is first asked for.

    items, groups, reviews, outliers, decisions, actions, survivors, names, flat, evidence, summary. What several tables
    are made from is written to the shared folder once.
    """

    def __init__(self, items: DataFrame, options: Options):
        self.options = options.checked()
        self._items = items

    @cached_property
    def items(self) -> DataFrame:
        return materialize(matching.adopt_scope_series(self._items, self.options.aliases))

    @cached_property
    def _grouped(self) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        groups, reviews, gray = matching.grouped_with_gray(self.items, self.options)
        if self.options.retry_overflow:  # that drops single reviews, so the pairs of classes don't tell them any more
            groups, reviews = overflow.retry_overflow(materialize(groups), reviews, self.items, self.options)
            gray = None
        return materialize(groups), reviews, gray

    @property
    def groups(self) -> DataFrame:
        return self._grouped[0]

    @property
    def reviews(self) -> DataFrame:
        return self._grouped[1]

    @cached_property
    def outliers(self) -> DataFrame:
        return outliers.size_outliers(self.items.join(self.groups.select("item_id"), "item_id", "left_semi"))

    @cached_property
    def decisions(self) -> DataFrame:
        o, many = self.options, self.groups.groupBy("group_key").count().where("count > 1").select("group_key")
        many = self.groups.join(many, "group_key", "left_semi")
        thin = outliers.thin_members(many.join(self.items, "item_id"))
        flagged = thin.unionByName(self.outliers.join(thin.select("item_id"), "item_id", "left_anti"))
        return materialize(winners.select_winners(many, self.items, flagged, o.margin, o.verify_content, o.hash_distance))

    @cached_property
    def actions(self) -> DataFrame:
        return actions.loser_actions(self.decisions, self.items, self.options)

    @cached_property
    def survivors(self) -> DataFrame:
        return actions.survivors(self.items, self.decisions, self.options)

    @cached_property
    def names(self) -> DataFrame:
        return names.plan_names(self.items, self.groups, self.survivors, self.options)

    @cached_property
    def flat(self) -> DataFrame:
        return actions.flatten_plan(self.items, self.survivors, self.names, self.decisions, self.outliers, self.options)

    @cached_property
    def evidence(self) -> DataFrame:
        gray, shown = self._grouped[2], actions.shown(self.items)
        ends = actions.ends_of(self.reviews, shown) if gray is None else matching.review_ends(gray, self.items, shown, self.options)
        return actions.evidence(self.groups, self.decisions, ends, shown, self.actions)

    @cached_property
    def summary(self) -> DataFrame:
        return actions.summary(self.items, self.groups, self.decisions, self.reviews)


def titled(items: DataFrame) -> DataFrame:
    """Adds series, volume, volume_kind, editions, display, scope and label from rel_path, name and kind."""
    t = items.withColumn("t", parsed(F.col("name")))
    t = t.select(*items.columns, *(F.col(f"t.{c}").alias(c) for c in ("series", "volume", "volume_kind", "editions", "display")))
    return t.withColumn("scope", C.scope_of(F.col("rel_path"), F.col("kind"))).withColumn("label", F.col("name"))


def analyze(items: DataFrame, options: Options | None = None) -> Result:
    """Analyse titled items with metrics (page_count, total_bytes, median_pixels, median_bpp, measured)."""
    return Result(items, options or Options())
