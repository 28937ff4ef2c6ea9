"""Connected components of a link table, wholly in DataFrames.

Labels spread along links and jump over each other, and every round is written
to the shared folder. Both sides of each join are plain reads, so that skewed
nodes, such as the hub of a star, are split by adaptive execution."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """node, component (least node reachable) of all nodes in links (a, b).
    Nulls and self-links are ignored; repeats do no harm."""
    links = links.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    both = stored(links.union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = stored(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old")), "spread")
        top = spread.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = stored(spread.join(top, "label").select("node", F.col("top").alias("label"), "old"), "labels")
        if jumped.where("label <> old").isEmpty():
            return jumped.select("node", F.col("label").alias("component"))
        labels = jumped.select("node", "label")


class Forest:
    """Least-label components of links within a task's group."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        lab = self.label
        while len(a):
            ra, rb = lab[a], lab[b]
            if (ra == rb).all():
                return
            low = np.minimum(ra, rb)
            np.minimum.at(lab, ra, low)
            np.minimum.at(lab, rb, low)
            while True:
                up = lab[lab]
                if (up == lab).all():
                    break
                lab[:] = up
