"""Distributed connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import materialize, release


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``n`` nodes by the links ``a[i]``-``b[i]``."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def connected_components(links: DataFrame) -> DataFrame:
    """``(id, component_id)`` of every node of ``links`` (src, dst): the smallest id that links reach.

    Alternates large-star and small-star rounds until each node hangs on its
    root. A round keeps at most one row a link, so it never multiplies rows;
    the driver sees only whether rows are left. Nulls and self-links are ignored;
    no links give no rows.

    A link is kept as ``(u, v)``, u > v. Large-star hangs u on the least
    neighbour of v, small-star u and its v on the least v. Both join the links
    with a written table that has one row a node, so Spark can broadcast it,
    or split the rows of a hub (the root of a large component) between tasks.
    """
    edges = links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    edges = materialize(edges.distinct())
    while not _stars(edges):
        low = materialize(edges.groupBy("u").agg(F.min("v").alias("m")))
        above = low.select(F.col("u").alias("w"), "m")
        large = materialize(edges.join(above, F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct())
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = materialize(moved.unionByName(least.withColumnRenamed("m", "v")).distinct())
        for done in (edges, low, large, least):
            release(done)
        edges = small
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one root and no root hangs on another."""
    if not edges.groupBy("u").count().where("count > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()
