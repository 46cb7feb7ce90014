"""Connected components of an edge table, by least neighbours, pointer jumping and contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every end of ``edges`` (a long, b long): one node of its component, the same for all of it.

    Each round, every node takes its least neighbour for parent (pre-aggregated), and parents' parents follow by a jump; then
    edges are contracted to their ends' parents, and loops and repeats go, so the edge table shrinks with every round.
    Rounds are written to the shared folder; one emptiness test each reaches the driver. A hub is a hot key of plain
    equi-joins on written tables, which adaptive execution splits.
    """
    left = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    at = None
    for _ in range(most_rounds):
        if not left.limit(1).count():
            return edges.sparkSession.createDataFrame([], "node long, label long") if at is None else at
        near = left.union(left.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        parent = materialise(near.select("node", F.least("node", "m").alias("up")), "parents")
        up = materialise(parent.join(parent.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("up")), "parents")
        head, tail = (up.select(F.col("node").alias(c), F.col("up").alias(f"{c}2")) for c in ("a", "b"))
        left = materialise(
            left.join(head, "a").join(tail, "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges"
        )
        if at is None:
            at = up.select("node", F.col("up").alias("label"))
        else:
            moved = at.join(up.select(F.col("node").alias("label"), "up"), "label", "left")
            at = materialise(moved.select("node", F.coalesce("up", "label").alias("label")), "labels")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each of ``n`` nodes' components, for edges within one task."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label
