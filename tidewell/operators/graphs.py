"""Links and components without collecting either.

Connected components by alternating large-star and small-star steps on the edge list: the number of
rounds is logarithmic in practice, every round is a few group-bys, and each round's edges are written
to the shared folder so that the lineage stays short.  A vertex with very many links is never
gathered into one task: the steps use minima (pre-aggregated) and joins only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, a: str, b: str, keep: Callable[[DataFrame], DataFrame], most_rounds: int = 60) -> DataFrame:
    """vertex, component (the smallest vertex of it) of every vertex with an edge."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    e = keep(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most_rounds):
        # large star: every larger neighbour points to the least neighbour
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = sym.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: the smaller neighbours point to the least
        mins = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(mins, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(mins.withColumnRenamed("m", "v"))
        new = keep(small.filter("u <> v").distinct())
        changed = new.join(e, ["u", "v"], "left_anti").limit(1).count() + e.join(new, ["u", "v"], "left_anti").limit(1).count()
        e = new
        if not changed:
            break
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds: raise most_rounds")
    roots = e.select(F.col("v").alias("vertex")).distinct().join(e.select(F.col("u").alias("vertex")), "vertex", "left_anti")
    return e.groupBy(F.col("u").alias("vertex")).agg(F.min("v").alias("component")).unionByName(roots.withColumn("component", F.col("vertex")))
