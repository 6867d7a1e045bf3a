"""Connected components of a link table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rankfold.llm.common import materialize, told


def connected_components(links: DataFrame) -> DataFrame:
    """`(node, component)` of all nodes in `links(a, b)`; the component is its smallest node.

    A round gives every node the smallest label around it and then its label's label, so long chains shorten fast. Each
    round is stored, which cuts the lineage; it ends when no label changes. Links to null or to oneself say nothing. Few
    labels are told to all tasks, so that a round deals out rows once and not four times.
    """
    ways = links.filter("a is not null and b is not null and a <> b").select("a", "b")
    ways = materialize(ways.unionByName(ways.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(ways.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    tell = told(labels)
    while True:
        around = ways.join(tell(labels), F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("seen"))
        lower = around.join(tell(labels), F.col("node") == F.col("a")).select(
            "node", F.col("component").alias("old"), F.least("component", "seen").alias("next"))
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("further"))
        moved = materialize(lower.join(tell(jump), F.col("next") == F.col("at"), "left").select(
            "node", "old", F.least("next", F.coalesce("further", "next")).alias("component")))
        labels = moved.select("node", "component")
        if not moved.filter("old <> component").limit(1).count():
            return labels
