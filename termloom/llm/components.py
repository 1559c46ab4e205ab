"""Connected components by local forests and alternating large-star and small-star steps.

A round has two parts. Tasks of ``FOREST_NODES`` edges each turn theirs into a forest of stars
with a disjoint-set structure of bounded size, which shortens chains and leaves fewer edges.
Where the stars of all tasks together are not stars yet, a large-star and a small-star step,
each one aggregation and one join, relink across tasks. What a round leaves is written to the
shared folder, so the lineage stays short and a lost executor costs only its tasks. The number
of rounds grows with the logarithm of the tasks that a chain runs through. Nothing but totals
reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import materialize

#: Nodes that a task's forest holds at once: some 100 MB of Python objects.
FOREST_NODES = 500_000


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Relink each node's neighbours (larger ones, or smaller ones and itself) to its smallest."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = both.join(low, "u")
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = low.select("u", F.col("m").alias("v"))
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
    return out.where(F.col("u") != F.col("v")).distinct()


def _forests(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Stars (u, v), v the smallest of its tree, of edges (u, v); a forest of ``most`` nodes is
    given out and begun anew."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def stars() -> pa.RecordBatch:
        rooted = [(x, root(x)) for x in parent]
        pairs = [(x, r) for x, r in rooted if x != r]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
        if len(parent) >= most:
            yield stars()
            parent.clear()
    yield stars()


def _settled(edges: DataFrame) -> bool:
    """Whether all edges point from a node of its own to a node that points nowhere."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    per = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return per.where((F.col("out") > 1) | (F.col("out") > 0) & (F.col("in") > 0)).isEmpty()


def components(edges: DataFrame, label: str = "components", most: int = FOREST_NODES) -> DataFrame:
    """(node, component) for every node of an edge table (u, v) of longs: the smallest node reachable.

    A node whose only edge is to itself is left out."""
    now = materialize(edges.select("u", "v").where("u <> v"), label)
    while True:
        tasks = -(-now.count() // most)
        forests = now.coalesce(max(1, tasks)).mapInArrow(partial(_forests, most=most), "u long, v long")
        now = materialize(forests, label)
        if _settled(now):
            break
        now = materialize(_stars(_stars(now, True), False), label)
    named = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return named.unionByName(roots)
