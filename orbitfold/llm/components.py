"""Connected components as joins: least labels with pointer jumping, a written table after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): of each node of ``edges`` (a, b) the least node of its component.

    Labels only fall, and each round also looks up the label of the label, so chains halve. Nothing is collected but
    whether a label has changed. Raises if that still happens after ``most_rounds``.
    """
    both = materialize(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().toDF("a", "b"), "cc-edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "cc-labels")
    written = labels
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        low = labels.join(near, labels.node == near.a, "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("m", "root")).alias("mid"))
        top = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        fresh = materialize(low.join(top, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("root")), "cc-labels")
        done, before, labels = fresh.where("root <> old").isEmpty(), written, fresh.select("node", "root")
        written = fresh
        discard(before)
        if done:
            discard(both)
            return labels
    raise RuntimeError("components did not settle")
