"""Connected components of a link table, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import stored


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(id, component): the least id that each linked id can reach; ids without links are not listed.

    `links` has columns a and b. A round rewrites every edge to the labels of its ends, hooks
    each label to the least label beside it (an aggregate with partial minima, so a node of
    any degree is safe), and shortens all chains by two jumps. The edges left, between
    different labels, shrink by at least half each round. Every round is written to the
    shared folder; nothing but a row count reaches the driver.
    """
    edges = stored(links.where("a <> b").select("a", "b").distinct(), "links")
    nodes = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    labels = stored(nodes.select("id", F.col("id").alias("component")), "labels")
    for _ in range(most_rounds):
        if edges.isEmpty():
            return labels
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).where("b < a")
        hook = stored(hook.select(F.col("a").alias("id"), F.col("b").alias("to")), "hooks")
        for _ in range(2):
            over = hook.select(F.col("id").alias("to"), F.col("to").alias("next"))
            hook = hook.join(over, "to", "left").select("id", F.coalesce("next", "to").alias("to"))
        hook = stored(hook, "hooks")
        moved = lambda df, c: df.join(hook.select(F.col("id").alias(c), "to"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        labels = stored(moved(labels, "component").select("id", "component"), "labels")
        edges = stored(moved(moved(edges, "a"), "b").where("a <> b").select("a", "b").distinct(), "links")
    raise RuntimeError("components did not settle")
