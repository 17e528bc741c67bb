"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionloom.session import staged


def _least(edges: DataFrame) -> DataFrame:
    """(u, v, m): every edge with the least of u and u's neighbours. A hub's edges meet one row, so a skewed join may be split."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that links reach, for all nodes of ``edges`` (u, v).

    Rounds of the two star steps (each a grouped minimum and a join) shrink every component to a star around
    its least node; each round is written to the shared folder. Self links and repeated links do no harm; an
    empty table gives an empty result.
    """
    e = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _least(large)
        small = small.select("v", "m").union(small.select(F.col("u"), F.col("m"))).where("v <> m").toDF("u", "v").distinct()
        new = staged(small, "links")
        changed = new.join(e, ["u", "v"], "left_anti").limit(1).count() or e.join(new, ["u", "v"], "left_anti").limit(1).count()
        e = new
        if not changed:
            break
    return e.toDF("node", "component").union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
