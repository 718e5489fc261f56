"""Connected components of links between numbered nodes."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import joined, stored


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component; nodes are 0 to n - 1, all in memory."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def components(links: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for each node in links (a, b).

    In each round every node points to the least of itself and its
    neighbours, and the links are drawn anew between what their ends point to;
    of the nodes that still have links, half at least go.  Hubs are split in
    the joins, and minima are taken before rows are moved.
    """
    edges = stored(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a != b").distinct())
    steps: list[DataFrame] = []
    while edges.limit(1).count():
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        step = stored(ends.groupBy("node").agg(F.min(F.least("node", "other")).alias("to")))
        steps.append(step)
        for end in ("a", "b"):
            edges = joined(edges, step.select(F.col("node").alias(end), F.col("to").alias("_to")), [end], "inner", F.struct("a", "b"))
            edges = edges.drop(end).withColumnRenamed("_to", end)
        edges = stored(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[0].withColumnRenamed("to", "root")
    for step in steps[1:]:
        out = joined(out, step.withColumnRenamed("node", "root"), ["root"], "left", F.col("node"))
        out = out.select("node", F.coalesce("to", "root").alias("root"))
    return stored(out)
