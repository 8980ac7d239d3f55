"""Connected components: in numpy within a task, as DataFrames over all tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.session import checkpointed


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a-b, the least node that each is connected to."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further
    return root


def components(edges: DataFrame) -> DataFrame:
    """(a, b) as links between long ids to (id, component): the least id that each is connected to.

    Nodes without a link are not returned; nulls and links to itself are ignored. Each round makes
    every node point to the least neighbour it knows (Kiveris et al., 2014: large star, then small
    star) and writes the links that are left, at most one for a node and round in the end.
    """
    edges = checkpointed(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a is not null and b is not null and a <> b")
        .distinct()
    )
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = checkpointed(large.where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        new = checkpointed(
            small.where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        if stars(new):
            return new.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
                new.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            )
        edges = new


def stars(edges: DataFrame) -> bool:
    """Whether every node points to one other, which points nowhere."""
    seen = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return not seen and not edges.select("a").join(edges.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count()

