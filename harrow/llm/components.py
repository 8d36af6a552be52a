"""Connected components: alternating large and small stars over an edge table, after each task has reduced its own edges to a forest.

Every round is a few shuffles of the edges by a vertex, with the minima aggregated before the shuffle and written before the
join, so that Spark can split the partition of a vertex with very many edges. The number of rounds grows with the logarithm
of the largest component; no vertex's neighbours are gathered anywhere and nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.shared import tidy, written

EDGE = "a long, b long"


def labels(n: int, a: np.ndarray, b: np.ndarray, lab: np.ndarray | None = None) -> np.ndarray:
    """The smallest vertex that each of n vertices reaches over the edges; lab: labels to go on from."""
    lab = np.arange(n) if lab is None else lab
    while True:
        x, y = lab[a], lab[b]
        apart = x != y
        if not apart.any():
            return lab
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(lab, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab = up


def forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components as far as each partition shows: every vertex to the smallest it reaches there."""

    def reduce(batches):
        kept = np.zeros((0, 2), np.int64)
        for batch in batches:
            kept = _stars(np.concatenate([kept, batch[["a", "b"]].to_numpy(np.int64)]))
        yield pd.DataFrame({"a": kept[:, 0], "b": kept[:, 1]})

    return edges.mapInPandas(tidy(reduce), EDGE)


def _stars(edges: np.ndarray) -> np.ndarray:
    names, at = np.unique(edges, return_inverse=True)
    at = at.reshape(-1, 2)
    lab = labels(len(names), at[:, 0], at[:, 1])
    own = lab != np.arange(len(names))
    return np.stack([names[own], names[lab[own]]], axis=1)


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "stars")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = written(down.groupBy("u").agg(F.min("v").alias("m")), "stars")
    out = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.union(least).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) for every vertex of edges (a, b); component_id is the smallest vertex reachable."""
    now = written(forest(edges.where("a <> b")), "edges")
    before = _state(now)
    while before[0]:
        now = written(_small(written(_large(now), "edges")), "edges")
        after = _state(now)
        if after == before:
            break
        before = after
    pairs = now.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return pairs.union(now.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())
