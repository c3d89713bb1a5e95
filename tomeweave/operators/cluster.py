"""Connected components over an edge table.

Alternating large-star and small-star steps: every round replaces edges by edges to the smallest
known neighbour, so a component becomes a star around its smallest node in about log(n) rounds.
Node minima are aggregated before any shuffle and met again by an equi-join, which adaptive execution
can split, so a node with very many edges is no bottleneck. Each round is written out, which cuts the
lineage. A graph of no more than ONE_TASK edges is settled in one task instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeweave.plans.storage import materialize

MOST_ROUNDS = 60
#: Edges of a graph that one task settles: at most some tens of MB there.
ONE_TASK = 1 << 18


def smallest_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` positions the smallest that the links (a, b) reach."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        was = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, was[a], low)
        np.minimum.at(label, was[b], low)
        label = label[label]
        if (label == was).all():
            break
    return label


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, component) of a small graph (u, v)."""
    kind = edges.schema["u"].dataType.simpleString()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            ends = pa.concat_arrays([table.column(c).combine_chunks() for c in "uv"])
            names, code = np.unique(ends.to_numpy(zero_copy_only=False), return_inverse=True)
            label = smallest_reached(len(names), code[: table.num_rows], code[table.num_rows :])
            yield pa.RecordBatch.from_arrays([pa.array(names, ends.type), pa.array(names[label], ends.type)], ["node", "component"])

    return edges.coalesce(1).mapInArrow(settle, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, materialize: Callable[[DataFrame], DataFrame] = materialize, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge table; component is the smallest node reachable.

    Loops, repeated and reversed edges are allowed, edges with a null end are ignored. A node that has
    only a loop is its own component. An empty table gives no rows. Raises if MOST_ROUNDS don't suffice.
    """
    known = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null").distinct()
    known = materialize(known)
    if known.limit(ONE_TASK + 1).count() <= ONE_TASK:
        return _in_one_task(known)
    loops = known.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = materialize(known.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        oriented = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = oriented.groupBy("u").agg(F.min("v").alias("m"))
        small = oriented.join(least, "u").select(F.col("v").alias("u"), "m").where("u <> m").select("u", F.col("m").alias("v"))
        now = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return loops.join(now, loops["node"] == now["u"], "left").select("node", F.coalesce("v", "node").alias("component"))
        before = mark
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
