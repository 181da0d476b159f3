"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import written


def components(links: DataFrame) -> DataFrame:
    """links: u, v, numbers. A row for each number in them: node, component (the least it reaches).

    Each round groups by node with partial aggregation and writes the links it leaves to the shared
    folder; only a count and a checksum go to the driver. The number of rounds grows with the logarithm
    of the longest path.

    A null in a link is an error of the caller's; links that repeat count once; no links give no rows.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    edges, seen = written(edges, spark), None
    while True:
        n, total = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if (n, total) == seen or not n:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select("v", "v").distinct()
            )
        seen = n, total
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        edges = written(small.union(least).distinct(), spark)
