"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def _star(edges: DataFrame, wide: bool) -> DataFrame:
    """One contraction.  ``edges`` has u > v; each neighbourhood is re-hung on its smallest member.

    ``wide`` hangs larger neighbours, otherwise smaller ones.  The smallest
    member comes from a combined aggregate and returns by a join, so a hub's
    neighbours are never gathered.
    """
    both = edges if not wide else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    hung = both.join(least, "u")
    if wide:
        out = hung.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(u, v)`` links to ``(u, root)`` for all nodes but the roots; the root is the smallest node.

    Every round is written to the shared folder.  Rounds grow with the
    logarithm of the largest diameter; running out of them raises.
    """
    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    seen = e.agg(mark.alias("m")).first()["m"]
    if not seen[0]:
        return e.withColumnRenamed("v", "root")
    for _ in range(rounds):
        e = stored(_star(_star(e, True), False))
        now = e.agg(mark.alias("m")).first()["m"]
        if now == seen:
            return e.withColumnRenamed("v", "root")
        seen = now
    raise RuntimeError(f"no fixed point after {rounds} rounds")
