"""Connected components of a graph held as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.llm.scratch import Scratch


def _both(edges: DataFrame) -> DataFrame:
    ends = F.array(F.struct("lo", "hi"), F.struct(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
    return edges.select(F.explode(ends).alias("e")).select("e.lo", "e.hi")


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one lesser neighbour at most, and one with a lesser neighbour has no greater one."""
    less = F.when(F.col("hi") < F.col("lo"), F.col("hi"))
    ends = _both(edges).groupBy("lo").agg(F.min(less).alias("least"), F.max(less).alias("most"), F.max("hi").alias("last"))
    return ends.agg(F.count_if((F.col("least") != F.col("most")) | (F.col("least").isNotNull() & (F.col("last") > F.col("lo"))))).first()[0] == 0


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root: each node of ``edges`` (a, b) with the smallest node that it reaches.

    Alternates large-star and small-star steps, each a window over the node, until all are stars; the edges of every round are written,
    and none are collected. Equal edges that a round makes become one where the next deals them by node, so a round moves them twice.
    """
    now = scratch.save(edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")), "edges")
    first = now
    while not _stars(now):
        # large-star: greater neighbours move to the least of a node's neighbours and itself
        least = F.least("lo", F.min("hi").over(Window.partitionBy("lo")))
        large = _both(now).repartition("lo").distinct().select("lo", "hi", least.alias("m")).where("hi > lo").select(F.col("m").alias("lo"), "hi")
        # small-star: lesser neighbours and the node itself move to the least of them
        m = F.min("lo").over(Window.partitionBy("hi"))
        small = large.select(m.alias("m"), "lo", "hi").select(F.col("m").alias("lo"), F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"))
        new = scratch.save(small, "edges")
        if now is not first:
            scratch.drop(now)
        now = new
    return scratch.save(now.select(F.explode(F.array("lo", "hi")).alias("node"), F.col("lo").alias("root")).distinct(), "components")
