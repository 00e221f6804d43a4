"""Connected components as repeated joins; links never meet in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cellzonal.llm.text import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, comp) of all nodes in links (a, b); comp is the component's smallest node.

    Each round takes the smallest label among neighbours, then the label's own
    label, so that chains shorten by half. Labels are written every round.
    """
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    both = scratch.keep(both, f"{name}-both")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    labels = labels.select("node", F.least("node", "m").alias("comp"))
    labels = scratch.keep(labels, f"{name}-0")
    done, turn = False, 0
    while not done:
        turn += 1
        near = both.join(labels.withColumnRenamed("node", "b"), "b")
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        step = labels.join(near, "node").select(
            "node", F.col("comp").alias("was"), F.least("comp", "m").alias("to")
        )
        own = labels.select(F.col("node").alias("to"), F.col("comp").alias("up"))
        step = step.join(own, "to").select(
            "node", "was", F.least("to", "up").alias("comp")
        )
        step = scratch.keep(step, f"{name}-{turn}")
        done = not step.where("was <> comp").take(1)
        labels = step.select("node", "comp")
        scratch.drop(f"{name}-{turn - 1}")
    scratch.drop(f"{name}-both")
    return labels
