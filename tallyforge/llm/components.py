"""Connected components of a graph of row ids by alternating large-star and small-star rounds.

Every round groups with a map-side minimum and joins it back. The joined side has one row for each node, so a hub's links are read as a stream, and adaptive
execution splits them over several tasks. A round ends in a checkpoint in the shared folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import checkpointed


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: u, v, u > v, distinct. Large: links each node's larger neighbours with its least one; small: the node and its smaller ones."""
    around = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = around.join(least, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return out.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: a, b. Returns node, component: the smallest node that each linked node reaches; nodes without a link are left out."""
    now = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = None
    while (after := state(now)) != before:
        before = after
        if not after[0]:
            break
        now = checkpointed(_star(_star(now, True), False))
    # at rest every node links to its component's least node only
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def forest(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links i-j over positions of ids as links of each id with its local component's least id."""
    label = ids.copy()
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        if (label == before).all():
            moved = label != ids
            return ids[moved], label[moved]
