"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.session import materialize


#: Edges that one task works through (16 bytes each); a graph of no more takes its steps there, without an exchange.
TASK_EDGES = 1 << 19


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step over edges (u, v) with u > v.

    large: each neighbour above u moves to the least of u's neighbourhood.
    small: each neighbour below u, and u itself, moves to the least of them.
    """
    both = lambda x, y: F.inline(F.array(x, y))
    around = edges if small else edges.select(both(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    least = around.groupBy("u").agg(F.min("v").alias("m"))
    if small:
        out = around.join(least, "u").select(both(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
    else:
        least = least.select("u", F.least("u", "m").alias("m"))
        out = around.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u != v").distinct()


def _sign(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.lit(0))).first()
    return int(row[0]), int(row[1])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (id, component): every id on some edge and the smallest id it can reach.

    Edges are undirected; nulls, loops and repeats are allowed and ignored. Nothing is
    collected: each step is one aggregation and one join, written to the shared folder,
    and the number of steps grows with the logarithm of the longest path. A graph of more
    than TASK_EDGES edges is shuffled in the session's number of partitions; for a smaller
    one these would cost more than the work in them.
    """
    kept = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = materialize(kept.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc")
    sign = _sign(now)
    while sign[0]:
        if sign[0] <= TASK_EDGES:
            now = now.coalesce(1)
        now = materialize(_star(_star(now, small=False), small=True), "cc")
        before, sign = sign, _sign(now)
        if before == sign:
            break
    nodes = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
