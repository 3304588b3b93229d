"""Connected components of an edge table by alternating large-star and small-star steps, in Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """edges (u, v): every neighbour larger than u is tied to the least of u and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges (u > v): u and its smaller neighbours are tied to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


#: Edges whose spanning forest a task works out at a time.
EDGES_AT_ONCE = 500_000


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node with the least of its component, for edges that fit in memory."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = after[after[after]]
        if (after == root).all():
            break
        root = after
    other = np.flatnonzero(root != np.arange(len(names)))
    return names[other], names[root[other]]


def spanning(edges: DataFrame) -> DataFrame:
    """Fewer edges (u, v) of the same components: each task replaces its own by stars."""

    def run(batches):
        held, size = [], 0

        def stars():
            u, v = _forest(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
            size += batch.num_rows
            if size >= EDGES_AT_ONCE:
                yield stars()
                held, size = [], 0
        if held:
            yield stars()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, label: str) -> DataFrame:
    """node and root (the least node of its component), for nodes with an edge. edges: u, v (long)."""
    mark = lambda t: tuple(t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = written(spanning(edges.filter("u <> v")).distinct(), label)
    before = mark(now)
    while before[0]:
        now = written(_small_star(_large_star(now)), label)
        after = mark(now)
        if after == before:
            break
        before = after
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
