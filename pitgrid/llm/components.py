"""Connected components of a table of links, by smallest label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgrid.llm.staging import drop, stage


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``label``, the smallest id that links reach, for every id in ``links``.

    ``links`` has long columns ``a`` and ``b``; order, loops and repeats don't matter.  Each
    round hooks labels onto the smallest label among linked ids and then follows each label
    to its own label, so the rounds grow with the logarithm of the longest path.  The links
    shrink to those between different labels, and every round is written to shared storage.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = stage(edges, "links")
    labels = stage(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("label", F.col("id")), "labels")
    while True:
        # the links between the trees of this round: a -> b with a < b
        roots = edges.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("to"))
        moved = (
            labels.join(roots, labels["label"] == roots["root"], "left").select("id", F.coalesce("to", "label").alias("label"))
        )
        old, labels = labels, stage(moved, "labels")
        drop(old)
        # follow roots that moved themselves until none does
        while True:
            next_ = labels.select(F.col("id").alias("root"), F.col("label").alias("to")).where("root != to")
            jumped = labels.join(next_, labels["label"] == next_["root"], "left").select(
                "id", F.coalesce("to", "label").alias("label"), F.col("to").isNotNull().alias("moved")
            )
            old, labels = labels, stage(jumped, "labels")
            drop(old)
            if not labels.where("moved").limit(1).count():
                break
        at = lambda side, labels=labels: labels.select(F.col("id").alias(side), F.col("label").alias(f"l{side}"))
        between = edges.join(at("a"), "a").join(at("b"), "b").where("la != lb")
        old, edges = edges, stage(between.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "links")
        drop(old)
        if edges.limit(1).count() == 0:
            drop(edges)
            return labels.select("id", "label")
