"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modalflow.llm.common import Scratch

#: Tasks that share the partners of one node.
SALTS = 8


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, comp (smallest node of its component) for every node of edges(a, b).

    Each round takes the smallest label among a node and its neighbours, then the label
    of its label (pointer jumping), so the number of rounds grows with the logarithm of
    a component's diameter. Minima are combined before the shuffle. A node of very many
    neighbours, or the label of very many nodes, is dealt over SALTS tasks by its
    partners; its own label goes to each of them. Only the number of changed labels
    reaches the driver.
    """
    pairs = edges.select("a", "b").where("a <> b")
    both = scratch.save(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.save(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).select(F.col("a").alias("node"), "comp"), "labels")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    while True:
        sent = labels.select(F.col("node").alias("b"), "comp", salts)
        heard = both.select("a", "b", _salt("a")).join(sent, ["b", "salt"]).select(F.col("a").alias("node"), "comp", F.lit(None).cast("long").alias("old"))
        # A node hears its own label too, as the old one.
        lower = heard.unionByName(labels.select("node", "comp", F.col("comp").alias("old"))).groupBy("node").agg(F.min("comp").alias("comp"), F.max("old").alias("old"))
        jump = lower.select(F.col("node").alias("comp"), F.col("comp").alias("next"), salts)
        new = scratch.save(
            lower.select("node", "old", "comp", _salt("node")).join(jump, ["comp", "salt"]).select("node", "old", F.least("comp", "next").alias("comp")), "labels"
        )
        scratch.free(labels)
        labels = new
        if not new.where("old <> comp").limit(1).count():
            scratch.free(both)
            return labels.select("node", "comp")


def _salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int").alias("salt")
