"""Connected components of a graph of links, in joins and aggregates; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): component is the smallest id that links (columns a, b) reach; ids without a link have no row.

    Each round gives every id the smallest label among its neighbours' and then
    the label of its label, so paths shorten by half; rounds are checkpointed.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "id"))
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, labels["id"] == near["a"]).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        new = cut(new.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        moved = new.filter("old <> label").limit(1).count()
        labels = new.select("id", "label")
        if not moved:
            break
    else:
        raise RuntimeError("links don't settle")
    return labels.select("id", F.col("label").alias("component"))
