"""Distributed connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch

#: Edges (16 bytes each) that one task settles by itself; a larger set is first shortened in rounds.
FEW = 1 << 20


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (hi, lo) -> (node, component)."""
    told = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    edges = np.concatenate([np.empty((2, 0), np.int64), *told], axis=1)
    nodes, at = np.unique(edges, return_inverse=True)
    a, b = at.reshape(2, -1)
    labels = np.arange(len(nodes))
    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            break
        np.minimum.at(labels, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while not np.array_equal(labels, up := labels[labels]):
            labels = up
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[labels])], ["node", "component"])


def components(edges: DataFrame, scratch: Scratch, few: int = FEW) -> DataFrame:
    """``edges`` (src, dst) -> one row (node, component) per node that has an edge; component is the
    smallest node reachable. Alternating large-star and small-star rounds: every round replaces the edge
    set by one that keeps connectivity and shortens paths, until all edges point at the smallest node.
    Rounds grow with the logarithm of the longest path. Minima are aggregated map-side, joins back to a
    hub are left to adaptive skew splitting, and nothing reaches the driver but two numbers a round. Once ``few``
    edges or fewer are left, one task settles them."""
    pairs = edges.select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo"))
    now = scratch.save(pairs.where("hi <> lo").distinct())
    mark = _digest(now)
    while mark[0]:
        if mark[0] <= few and now.schema["hi"].dataType.typeName() == "long":
            return now.select("hi", "lo").coalesce(1).mapInArrow(_settle, "node long, component long")
        sym = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = scratch.save(small.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct())
        scratch.drop(now)
        now, before, mark = after, mark, _digest(after)
        if mark == before:
            break
    own = now.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(own)


def _digest(df: DataFrame) -> tuple:
    row = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
    return row.n, row.x
