"""Connected components by alternating large-star and small-star rounds.

Each round is a handful of aggregations and joins on node keys and ends in a reliable
checkpoint. The least neighbours of all nodes combine map-side; those of the large star,
where a hub has all of its edges, are written before they are joined, so that both sides of
the join are plain exchanges, which adaptive execution splits at such a hub. Edges are kept
in as many partitions as PART_EDGES asks for, so few edges make few shuffle files.
Self-loops and repeated edges are allowed; edges with a null end are no edges. Nodes
without edges do not occur in the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import cut

PART_EDGES = 100_000


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(parts))
    joined = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.coalesce(parts).distinct().coalesce(parts)


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    down = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    least = down.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)
    others = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.coalesce(parts).unionAll(least.select("u", F.col("m").alias("v"))).distinct().coalesce(parts)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Of ``edges(u, v)``: every node that has an edge to another one, with the least node
    of its component, as ``(node, component)``."""
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    parts = 1 + mark[0] // PART_EDGES
    now = now.coalesce(parts)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        now = cut(_small_star(_large_star(now, parts), parts))
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
