"""Link graphs: edges, degrees, PageRank and components as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.sources import shared


def checkpointed(df: DataFrame) -> DataFrame:
    """Behind a reliable checkpoint in the shared folder."""
    shared.ensure_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def edges(lines: DataFrame) -> DataFrame:
    """Distinct links from parts (src) to suppliers (dst), as one id space: suppliers are negative."""
    return lines.select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst")).distinct()


def degrees(links: DataFrame) -> DataFrame:
    """Inbound and outbound links of each node."""
    ins = links.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("inbound"))
    outs = links.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("outbound"))
    return ins.join(outs, "node", "full_outer").select("node", F.coalesce("inbound", F.lit(0)).alias("inbound"), F.coalesce("outbound", F.lit(0)).alias("outbound"))


def page_rank(links: DataFrame, damping: float = 0.85, rounds: int = 60, enough: float = 1e-10) -> DataFrame:
    """node, rank. Nodes without outbound links share their rank among all; rounds end when ranks move
    by less than `enough` in sum."""
    links = checkpointed(links)
    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    outs = links.groupBy("src").agg(F.count("*").alias("out"))
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    weighted = checkpointed(links.join(outs, "src"))
    ranks = checkpointed(nodes.join(outs, nodes["node"] == outs["src"], "left").select("node", F.lit(1.0 / n).alias("rank"), F.col("out").isNull().alias("dangling")))
    for _ in range(rounds):
        given = weighted.join(ranks, weighted["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        lost = ranks.where("dangling").agg(F.sum("rank")).first()[0] or 0.0
        after = checkpointed(ranks.join(given, ranks["node"] == given["dst"], "left").select("node", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + lost / n)).alias("rank"), "dangling", F.col("rank").alias("was")))
        moved = after.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0]
        ranks = after.drop("was")
        if moved < enough:
            break
    return ranks.select("node", "rank")


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that links reach, by neighbours' minima and jumps."""
    both = checkpointed(links.select("src", "dst").union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = checkpointed(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low")).select("node", F.least("node", "low").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        stepped = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        after = checkpointed(stepped.join(up, "component", "left").select("node", F.least("component", F.coalesce("up", "component")).alias("component"), "was"))
        changed = after.where("component <> was").limit(1).count()
        labels = after.select("node", "component")
        if not changed:
            return labels
