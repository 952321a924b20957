"""Connected components by contraction, for edges that stay distributed.

Each round sends every node to the smallest of itself and its neighbours and replaces the edges' ends by that; the
number of nodes that still have edges at least halves. The smallest node of a component always stays, so it names the
component. A node with very many edges is met by aggregation before the shuffle and by joins of two written tables,
which Spark splits by size; no task gathers a node's edges or a component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each distinct node and the smallest node that it reaches by these edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def forest(edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Edges a, b with the same components: within each task, up to `most` edges at once become stars."""

    def run(batches):
        held, n = [], 0

        def stars():
            a, b = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            nodes, roots = _roots(a, b)
            keep = nodes != roots
            return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], ["a", "b"])

        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            n += batch.num_rows
            if n >= most:
                yield stars()
                held, n = [], 0
        if n:
            yield stars()

    return edges.select("a", "b").filter("a <> b").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every node that has an edge; edges: columns a and b, long, not null."""
    edges = cut(forest(edges).distinct())
    labels, held = None, None  # held: the written table that labels reads
    while True:
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("other")))
        low = cut(both.groupBy("id").agg(F.min("other").alias("least")).select("id", F.least("id", "least").alias("to")))
        to = edges.join(low.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(low.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        left = cut(to.select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a <> b").distinct())
        drop(edges)
        edges = left
        if held is None:
            labels, held = low.withColumnRenamed("to", "component"), low
        else:
            new = cut(labels.join(low.withColumnRenamed("id", "component"), "component", "left").select(labels["id"], F.coalesce("to", "component").alias("component")))
            drop(held, low)
            labels = held = new
        if edges.isEmpty():
            return labels
