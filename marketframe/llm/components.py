"""Connected components over links that stay distributed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import is_empty, written


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable node of every node of ``links`` (a, b): rows (node, component).

    Each round takes the smallest label among neighbours, then the label of that label, so paths halve; a hub costs one aggregated
    row, never a gathered list.  Each round's labels are written to the shared folder, so lineage stays short and a lost executor
    costs one round.  Nulls and self-links are ignored; no links give no rows; repeated links change nothing.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    both = written(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), "labels")
    while True:
        seen = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(seen, labels.node == seen.a, "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        following = written(lower.join(up, "component", "left").select("node", "was", F.least("component", F.coalesce("above", "component")).alias("component")), "labels")
        labels = following.select("node", "component")
        if is_empty(following.where("was <> component")):
            return labels


def forest(hit: np.ndarray, ai: np.ndarray, si: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what ``hit`` joins, at most one for each row and column."""
    edges, free = [], hit.any(1)
    while free.any():
        rows = np.zeros(len(ai), bool)
        rows[free.argmax()] = True
        root, cols = int(ai[free.argmax()]), np.zeros(len(si), bool)
        while True:
            new_cols = hit[rows].any(0) & ~cols
            cols |= new_cols
            new_rows = hit[:, cols].any(1) & ~rows
            rows |= new_rows
            edges += [(root, int(i)) for i in np.concatenate([si[new_cols], ai[new_rows]])]
            if not new_rows.any():
                break
        free &= ~rows
    return edges
