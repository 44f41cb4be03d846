"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowcascade.session import restage, stage


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of the edges ``a``, ``b`` (long), root the smallest.

    Alternates large-star and small-star steps until the edges are stars.  A step joins
    every edge with the least neighbour of its end, a partial aggregate, so a node with
    very many edges is never gathered in one task.  Each step is written to the shared
    folder, so the plan stays short.  Null ends and loops are left out.
    """
    a, b = F.col("a"), F.col("b")
    now = stage(edges.filter(a != b).select(F.greatest(a, b).alias("a"),
                                            F.least(a, b).alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.union(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(a, F.min("b")).alias("m"))
        large = (both.join(least, "a").filter(b > a)
                 .select(b.alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").filter(b != F.col("m"))
                 .select(b.alias("a"), F.col("m").alias("b"))
                 .union(least.select("a", F.col("m").alias("b"))).distinct())
        now = restage(small, "edges")
        before, state = state, _state(now)
        if state == before:
            break
    stars = now.select(a.alias("node"), b.alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())

