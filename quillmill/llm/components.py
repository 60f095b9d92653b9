"""Connected components of a table of links, by alternating star contraction.

Every round points each node's larger neighbours at the smallest node next to it, then does the
same among the smaller ones. A node with very many links is aggregated before it is shuffled
and joined by a join that adaptive execution can split. Each round is written to the shared
folder, so lineage stays short and a lost executor costs only its own tasks; the table of the round
before is deleted then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize_at, scratch_path


def _starred(edges: DataFrame, upward: bool) -> DataFrame:
    """Edges (u, v). ``upward``: for every u its larger neighbours go to the least of u and all
    its neighbours; otherwise its smaller ones and itself go to the least of them."""
    if upward:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.where("u <> v")
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link; ``component`` is its smallest node.
    ``links`` has two columns of long ids; order, repeats and self-links do not matter."""
    a, b = links.columns[:2]
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    spark, path = links.sparkSession, scratch_path(links.sparkSession, "links")
    edges, seen = materialize_at(edges, path), None
    for _ in range(most_rounds):
        before, path = path, scratch_path(spark, "stars")
        edges = materialize_at(_starred(_starred(edges, True).distinct(), False).distinct(), path)
        discard(spark, before)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state
    raise RuntimeError(f"links did not contract in {most_rounds} rounds")
