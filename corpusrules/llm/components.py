"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Workspace


def components(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """``v, label`` for each end of ``links (a, b)``: the smallest number that it reaches.

    Rounds of two steps: every node takes the least label around it (pre-aggregated, so a
    node with very many links is no hot group), then the label of its label. Each round
    is a written table. The number of rounds grows with the logarithm of the longest path.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    both = work.keep(both, f"{name}-links")
    labels = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("label"))
    labels = work.keep(labels.select("v", F.least("v", "label").alias("label")), f"{name}-0")
    number = 0
    while True:
        around = (
            both.join(labels, both["a"] == labels["v"])
            .groupBy(F.col("b").alias("v"))
            .agg(F.min("label").alias("near"))
        )
        stepped = labels.join(around, "v", "left").select(
            "v", F.least("label", "near").alias("label"), F.col("label").alias("before")
        )
        stepped = work.keep(stepped, f"{name}-{number + 1}-half")
        roots = stepped.select(F.col("v").alias("label"), F.col("label").alias("root"))
        jumped = stepped.join(roots, "label", "left").select(
            "v", F.least("label", "root").alias("label"), "before"
        )
        jumped = work.keep(jumped, f"{name}-{number + 1}")
        changed = jumped.where("label <> before").limit(1).count()
        work.drop(f"{name}-{number}")
        work.drop(f"{name}-{number + 1}-half")
        number += 1
        labels = jumped.select("v", "label")
        if not changed:
            return labels
