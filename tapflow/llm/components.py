"""Connected components: of small groups in a task, and of links on the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapflow.operators.common import cut_lineage


def group_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``labels`` (each the smallest known member of a row's group) after
    joining the groups of rows ``i`` and ``j``."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        labels = labels.copy()
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:  # follow labels to their roots
            nxt = labels[labels]
            if (nxt == labels).all():
                break
            labels = nxt


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b) except roots; the root
    is the smallest node of the component.

    Star contraction: every node links its larger neighbours to its smallest
    neighbour, then every node links its smaller neighbours and itself to the
    smallest. The rounds end when nothing changes (about the logarithm of the
    longest path). Smallest neighbours come from aggregates that combine
    before the shuffle; the joins that hand them out have the links on one
    side and one row for each node on the other, so a node with many links is
    split by the skew join. Each round is written to the shared folder."""
    edges = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .distinct())
    state = _state(edges)
    while state[0]:
        # Larger neighbours: (b, a) seen from b; the smallest neighbour of b
        # may be on either side of its links.
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        least = ends.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("m", "node").alias("m"))
        large = (edges.join(least, edges["b"] == least["node"])
                 .select(F.col("a"), F.col("m").alias("b")).distinct())
        large = cut_lineage(large)
        smaller = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "node")
        pairs = large.join(smaller, large["a"] == smaller["node"]).select("a", "b", "m")
        edges = cut_lineage(pairs.select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").filter("a <> b").distinct())
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
