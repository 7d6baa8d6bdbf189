"""Connected components of an edge list: contraction within tasks, then large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexispark.functions.lineage import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction step: connect neighbours to the smallest node next to their hub."""
    if large:  # neighbours of either side; the larger ones move to the hub's minimum
        around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:  # edges already point from the larger node a to the smaller b
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = around.join(least, "a")
    if large:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


#: Edges that a task contracts together.
TOGETHER = 1 << 20


def smallest_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node that each is connected with) by the edges (a, b), of any type that sorts."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, low = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        before = low.copy()
        least = np.minimum(low[u], low[v])
        np.minimum.at(low, low[u], least)  # roots hang on to smaller roots
        np.minimum.at(low, low[v], least)
        while (jumped := low[low] != low).any():
            low[jumped] = low[low[jumped]]
        if (low == before).all():
            return nodes, nodes[low]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a larger, b smaller) that connect the same nodes, of each task a star for each of its own components.

    A task needs no shuffle for it, and what is left has fewer edges than nodes of the task.
    """
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def stars() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            sides = [table[c].to_numpy(zero_copy_only=False) for c in ("a", "b")]
            node, low = smallest_reached(*sides)
            moved = np.flatnonzero(node != low)
            return pa.RecordBatch.from_arrays([pa.array(x[moved], type=table.schema.field("a").type) for x in (node, low)], names=["a", "b"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= TOGETHER:
                yield stars()
        if held:
            yield stars()

    return edges.select("a", F.col("b").cast(kind).alias("b")).mapInArrow(run, f"a {kind}, b {kind}")


def reached_together(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the few ``edges`` (a, b), by one task."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            sides = [np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x, type=held[0].schema.field("a").type) for x in smallest_reached(*sides)], names=["node", "component"])

    return edges.select("a", F.col("b").cast(kind).alias("b")).coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, max_rounds: int = 60, alone: int = 0) -> DataFrame:
    """``node, component`` for every node of ``edges`` (a, b): the smallest node it is connected with.

    Self edges make their node a component of its own; edges with a null end are dropped. Tasks
    contract what they hold before each shuffle, so only what spans tasks is shuffled. Each round is written out; rounds
    grow with the logarithm of the number of nodes. Up to ``alone`` edges, at most ``TOGETHER``, are one task's.
    """
    clean = materialize(edges.select("a", "b").filter("a is not null and b is not null"), "edges")
    if alone and clean.count() <= min(alone, TOGETHER):
        return materialize(reached_together(clean), "reached")
    nodes = clean.select(F.col("a").alias("node")).union(clean.select(F.col("b").alias("node"))).distinct()
    now = contracted(clean.filter("a <> b")).distinct()
    seen = None
    for _ in range(max_rounds):
        now = materialize(contracted(_star(_star(now, large=True), large=False)), "stars")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("_to")), "node", "left").select("node", F.coalesce("_to", "node").alias("component"))
