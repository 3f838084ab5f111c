"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of edges (a, b): every node takes the smallest label around it and its label's label, until none moves.

    Each round is a table in the shared folder; the driver sees a flag for each.
    """
    e = edges.where("a <> b").select("a", "b")
    e = written(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = written(e.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("c")), "labels")
    old = label
    for _ in range(rounds):
        seen = e.join(label.toDF("b", "c"), "b").groupBy("a").agg(F.min("c").alias("low"))
        step = label.join(seen, "a").select("a", "c", F.least("c", "low").alias("low"))
        hop = written(step.join(label.toDF("low", "further"), "low", "left").select("a", "c", F.least("low", F.coalesce("further", "low")).alias("next")), "labels")
        moved = not hop.where("next <> c").isEmpty()
        dropped(old)
        label, old = hop.select("a", F.col("next").alias("c")), hop
        if not moved:
            dropped(e)
            return label.toDF("id", "component")
    raise RuntimeError("components did not settle")
