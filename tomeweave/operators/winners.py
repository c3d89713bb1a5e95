"""Which copy of a group stays.

Copies are compared metric by metric; a relative difference within the margin counts as equal. That
order is not transitive, so the result for three and more depends on the order of input and on a stable
sort: it runs in one Arrow UDF over a group's members in the order of ``pos``.
"""

from __future__ import annotations

from functools import cmp_to_key

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeweave.functions import columns as C

METRICS = ("median_pixels", "median_bpp", "total_bytes")
LEAST_MATCH = 0.6
_MEMBER = ("item_id", "pos", "measured", "median_pixels", "median_bpp", "total_bytes", "rank", "label", "outlier", "hashes")


def compare(left: dict, right: dict, margin: float) -> tuple[int, str]:
    """(1 if left is better, -1 if right is, 0) and the reason's code."""
    for metric in METRICS:
        a, b = left[metric] or 0, right[metric] or 0
        top = max(abs(a), abs(b))
        if top and abs(a - b) / top > margin:
            return (1 if a > b else -1), metric
    for code, a, b in (("source_kind", left["rank"], right["rank"]), ("longer_name", len(left["label"]), len(right["label"])), ("name_order", right["label"], left["label"])):
        if a != b:
            return (1 if a > b else -1), code
    return 0, "equal"


def pairwise(left: dict[str, Column], right: dict[str, Column], margin: float) -> tuple[Column, Column]:
    """compare() as columns: (sign, reason). Keys: METRICS, rank, label."""
    sign = lambda a, b: F.when(a > b, 1).otherwise(-1)
    out, why = None, None
    for metric in METRICS:
        a, b = (F.coalesce(x[metric].cast("double"), F.lit(0.0)) for x in (left, right))
        top = F.greatest(F.abs(a), F.abs(b))
        differs = (top > 0) & (F.abs(a - b) / F.when(top > 0, top) > margin)
        out = F.when(differs, sign(a, b)) if out is None else out.when(differs, sign(a, b))
        why = F.when(differs, metric) if why is None else why.when(differs, metric)
    for code, a, b in (("source_kind", left["rank"], right["rank"]), ("longer_name", F.length(left["label"]), F.length(right["label"])), ("name_order", right["label"], left["label"])):
        out, why = out.when(a != b, sign(a, b)), why.when(a != b, code)
    return out.otherwise(0), why.otherwise("equal")


def _matches(left: list | None, right: list | None, distance: int) -> float | None:
    if not left or not right:
        return None
    full = (1 << 64) - 1
    return sum(any(((a ^ b) & full).bit_count() <= distance for b in right) for a in left) / len(left)


def decide(members: list[dict], margin: float, verify: bool, distance: int) -> list[tuple]:
    """(item_id, role, reason_code, reason_item) of every member, members in order of input."""
    able = [m for m in members if m["measured"]]
    out = [m for m in able if m["outlier"]]
    if len(out) == len(able):
        out = []
    left = [m for m in able if m not in out]
    rows = [(m["item_id"], "undecided", "unmeasured", None) for m in members if not m["measured"]]
    rows += [(m["item_id"], "loser", f"outlier:{m['outlier']}", None) for m in out]
    if len(left) < 2:
        return rows + [(m["item_id"], "winner", "nothing_to_compare", None) for m in left]
    ordered = sorted(left, key=cmp_to_key(lambda a, b: -compare(a, b, margin)[0]))
    winner, rest = ordered[0], ordered[1:]
    if verify:
        odd = [m for m in rest if (r := _matches(winner["hashes"], m["hashes"], distance)) is not None and r < LEAST_MATCH]
        rows += [(m["item_id"], "undecided", "content_differs", winner["item_id"]) for m in odd]
        rest = [m for m in rest if m not in odd]
        if not rest:
            return [*rows, (winner["item_id"], "winner", "content_separated", None)]
    reasons = sorted({compare(winner, m, margin)[1] for m in rest})
    rows.append((winner["item_id"], "winner", "/".join(reasons), None))
    return rows + [(m["item_id"], "loser", compare(winner, m, margin)[1], winner["item_id"]) for m in rest]


def select_winners(groups: DataFrame, items: DataFrame, outliers: DataFrame, margin: float = 0.05, verify: bool = False, distance: int = 6) -> DataFrame:
    """group_key, item_id, role, reason_code, reason_item for the members of groups of two or more.

    items needs kind, label, measured and METRICS (hashes if ``verify``); outliers: item_id, rule. Outliers lose
    unless all measured members are outliers; unmeasured members stay undecided.
    """
    rows = groups.select("group_key", "item_id", "pos").join(items, "item_id").join(outliers.groupBy("item_id").agg(F.min("rule").alias("outlier")), "item_id", "left")
    rows = rows.withColumn("rank", C.source_rank(F.col("kind")))
    if "hashes" not in rows.columns:
        rows = rows.withColumn("hashes", F.lit(None).cast("array<bigint>"))
    gathered = rows.groupBy("group_key").agg(F.array_sort(F.collect_list(F.struct("pos", *(c for c in _MEMBER if c != "pos")))).alias("members")).where(F.size("members") > 1)

    @F.udf("array<struct<item_id: bigint, role: string, reason_code: string, reason_item: bigint>>", useArrow=True)
    def run(members):
        return decide([m if isinstance(m, dict) else m.asDict() for m in members], margin, verify, distance)

    return gathered.select("group_key", F.explode(run("members")).alias("d")).select("group_key", "d.*")
