"""Connected components of an edge table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import written


SALTS = 16  # parts into which the edges of a node are dealt for a join


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` with the column m of ``least`` (a, m) by ``a``.

    Edges are dealt by node and by a hash of their other end, and each node's row is sent
    to all SALTS parts, so the edges of a hub come to SALTS tasks.
    """
    everywhere = least.select("a", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(everywhere, ["a", "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a long, b long); component is its smallest node.

    Alternates the large-star and small-star steps (Kiveris et al., 2014): every step is
    a grouped minimum, which is summed up before it is shuffled, and a salted join back, so
    no node of many edges comes to one task. Stops when a step changes nothing. Self
    loops, repeated edges and nulls are dropped; an empty table gives an empty one.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _with_least(both, least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _with_least(large, low).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    labelled = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labelled.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
