"""Connected components by rounds of hooking and pointer jumping.

A round deals the edges out twice: by their upper node, which keeps its smallest neighbour and hands it the others,
and by the neighbours, which pass their own smallest neighbour on.  Repeated edges meet in the second deal and are
merged there.  Rounds are written to the shared folder, so a lost executor repeats at most one round.  Nothing but
one flag per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from mercato.llm.common import discard, written


def _round(edges: DataFrame) -> DataFrame:
    """Edges (u > v) -> as many at most, with the same components; ``changed`` where an edge is not one of the input."""
    sorted_by_u = Window.partitionBy("u").orderBy("v")
    seen = edges.select("u", "v", F.first("v").over(sorted_by_u).alias("m"), F.lag("v").over(sorted_by_u).alias("before"))
    parents = seen.where("before is null").select(F.col("u").alias("p"), F.col("m").alias("up"))
    hooked = seen.where("before is null or before <> v").select(
        F.when(F.col("before").isNull(), F.col("u")).otherwise(F.col("v")).alias("x"), "m", F.col("before").isNotNull().alias("moved"))
    return (hooked.join(parents, F.col("m") == F.col("p"), "left").groupBy("x", "m").agg(F.max("up").alias("up"), F.max("moved").alias("moved"))
            .select(F.col("x").alias("u"), F.coalesce("up", "m").alias("v"), (F.col("moved") | F.col("up").isNotNull()).alias("changed")))


def stars(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(u, v): each node of ``edges`` that is not the smallest of its component with the smallest, as a written table.

    Loops, repeated edges and nulls are ignored; nodes without an edge are absent.
    """
    now = written(_round(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                         .where(f"{a} <> {b} and {a} is not null and {b} is not null")), "edges")
    while now.agg(F.max("changed")).first()[0]:
        now, before = written(_round(now), "edges"), now
        discard(before)
    return now


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node of ``edges`` with the smallest node it reaches.

    Loops, repeated edges and nulls are ignored; nodes without an edge are absent.
    """
    now = stars(edges, a, b)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
