"""Connected components of an edge table by hooking, pointer jumping and contraction, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keep_table


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b): comp is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, if that is smaller,
    jumps over the chains this makes, and contracts the edges to what still
    joins different trees; a component at least halves, so rounds are few.
    Edges and labels go through the shared folder; only a row count comes to
    the driver. A hot node only meets partial minima. Tables read back carry
    no constraints of earlier rounds, which would grow with every round.
    """
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    edges = keep_table(links.where("a != b").select(*ordered).distinct())
    labels = None
    while labels is None or edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        hooked = keep_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up")))
        over = hooked.select(F.col("node").alias("up"), F.col("up").alias("next"))
        jumped = hooked.join(over, "up").select("node", F.col("next").alias("up")).join(over, "up").select("node", F.col("next").alias("up"))
        parent = keep_table(jumped)
        named = parent.select(F.col("node").alias("comp"), "up")
        labels = parent.select("node", F.col("up").alias("comp")) if labels is None else keep_table(labels.join(named, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")))
        ends = [parent.select(F.col("node").alias(c), F.col("up").alias(f"u{c}")) for c in ("a", "b")]
        edges = keep_table(edges.join(ends[0], "a").join(ends[1], "b").where("ua != ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
    return labels
