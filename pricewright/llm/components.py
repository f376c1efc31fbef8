"""Connected components of a link table, as rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, spread_join


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, root) with the least node of each component as root.

    Each round takes the least label among neighbours, then the label's own label,
    so long chains shorten by half or more a round. Rounds are written to the shared
    folder; the driver sees only whether a label changed. A node with very many
    links, and a label that very many nodes have, are spread over several parts, and
    minima are taken before the shuffle. Null ends and links of a node with itself
    give no row; repeated links count once.
    """
    links = links.filter("a <> b")
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "cc-links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")), "cc-labels")
    while True:
        near = (
            spread_join(both, labels.select(F.col("node").alias("b"), "root"), ["b"])
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        lower = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        lower = materialize(lower, "cc-lower")
        jump = lower.select("low").distinct().join(labels.select(F.col("node").alias("low"), F.col("root").alias("lowest")), "low")
        step = materialize(
            spread_join(lower, jump, ["low"]).select(
                "node", F.least("low", "lowest").alias("root"), F.col("root").alias("was")
            ),
            "cc-step",
        )
        changed = not step.filter("root <> was").isEmpty()
        discard(labels)
        discard(lower)
        labels = step.select("node", "root")
        if not changed:
            discard(both)
            return labels
