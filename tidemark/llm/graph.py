"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialise


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """(a, b) -> (node, label): the smallest node that is reachable, for every node of an edge.

    Labels start as the smallest neighbour; each round takes the smallest label around and follows labels of labels, until
    nothing changes. The minima are aggregated before the shuffle, so a hub with many neighbours is one row for each task.
    Each round is written to the shared folder; nothing is collected.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), f"{what}-edges")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), what)
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), on="b").groupBy("a").agg(F.min("label").alias("m"))
        near = labels.join(around.withColumnRenamed("a", "node"), on="node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = near.join(up, on="label", how="left").select("node", F.least("label", F.coalesce("up", "label")).alias("label"), (F.least("label", F.coalesce("up", "label")) != F.col("was")).alias("moved"))
        new = materialise(new, what)
        discard(labels)
        labels = new
        if not labels.filter("moved").limit(1).count():
            discard(both)
            out = labels.select("node", "label")
            out._tidemark_path = labels._tidemark_path
            return out
