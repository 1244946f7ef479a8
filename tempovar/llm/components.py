"""Connected components of links between ids, by alternating stars.

Each round points every id at the least id it sees (large star: from higher neighbours,
small star: from itself and lower ones). Neighbours are never gathered: a round takes a
minimum per id (pre-aggregated) and joins it back, so a hub is split like any skewed join.
Each round is written to the shared folder; stars alone end the rounds, no round confirms them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, name: str) -> DataFrame:
    """(``node``, ``root``) for every linked id but the roots; ``links`` has long ``a`` and ``b``, ``root`` is the least id."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-links")

    def open_(e: DataFrame) -> bool:
        """Whether an id has two links downwards, or is below one id and above another: else every link leads to a root."""
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(e.select("v", F.lit(0), F.lit(1)))
        return bool(ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down > 0 and up > 0)").limit(1).count())

    while open_(edges):
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(edges.select("v", "u"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("m", "x").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}-stars")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
