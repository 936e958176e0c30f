"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node reachable from each of n nodes over links a-b."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low = np.minimum(la, lb)
        np.minimum.at(label, np.maximum(la, lb), low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


#: Links that one task contracts.
PART = 200_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition, about PART of them, become stars with the same components."""
    held = [[batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v")] for batch in batches]
    if held:
        u, v = (np.concatenate(side) for side in zip(*held))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = roots(len(nodes), at[: len(u)], at[len(u) :])
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved], pa.int64()), pa.array(nodes[label[moved]], pa.int64())], names=["u", "v"])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): for each node of a link its least reachable node.

    edges: long columns u, v. Each round is joins and minima only, whatever the
    degree of a node; rounds grow with the logarithm of a component's size. edges
    are counted first, so they should be a written table.
    """
    pair = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    parts = -(-pair.count() // PART)
    now = scratch.save(pair.coalesce(max(1, parts)).mapInArrow(_contract, "u long, v long"), "links")
    before = None
    while parts > 1:  # the stars of one partition are the components
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.save(large.coalesce(parts), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        done = scratch.save(small.coalesce(parts), "small")
        state = done.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now, large)
        now = done
        if state == before:
            break
        before = state
    stars = now.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("node"), "component").unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
