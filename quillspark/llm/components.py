"""Connected components of a graph given as edges, as a bounded loop of joins and minimums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges (a, b)``, long; the root is the component's least node.

    Each round lowers the label of a node, and of its present root, to the least label next to it,
    then follows the labels one step further, so rounds grow with the logarithm of a component's
    size. Hubs are no trouble: minimums are taken partly before the shuffle, and both sides of each
    join are read from stored tables, so that their hot partitions can be split.
    """
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        of = lambda side, root: labels.select(F.col("node").alias(side), F.col("root").alias(root))  # noqa: E731, B023
        seen = both.join(of("b", "root_b"), "b").join(of("a", "root_a"), "a").where("root_b < root_a")
        lower = seen.select(F.inline(F.array(*[F.struct(F.col(c).alias("node"), F.col("root_b").alias("low")) for c in ("a", "root_a")])))
        lower = lower.groupBy("node").agg(F.min("low").alias("low"))
        lowered = stored(
            labels.join(lower, "node", "left").select("node", F.least("root", "low").alias("root"), F.col("low").isNotNull().alias("changed")),
            "labels",
        )
        if lowered.where("changed").isEmpty():
            return labels
        up = lowered.select(F.col("node").alias("root"), F.col("root").alias("next"))
        labels = stored(lowered.join(up, "root").select("node", F.col("next").alias("root")), "labels")
