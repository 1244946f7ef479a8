"""Exact quantiles by distributed rank selection.

A quantile is the value at sorted position ``round((n - 1) * q)`` of the non-NULL values (nearest
rank, halves away from zero). Values are counted first, so ties are one row. The range between the
least and the greatest is cut into ``BINS`` bins; the cumulated bin counts (at most ``BINS`` rows a
column) say in which bin each rank lies, and only the values of those bins are put in order. No
column is ever gathered in one array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 1024


def nearest_ranks(df: DataFrame, columns: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """One row per column that has a value: ``name`` and ``values``, its quantiles in the order given."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns]))
    counted = df.select(cells.alias("x")).select("x.name", "x.v").where("v is not null").groupBy("name", "v").agg(F.count("*").alias("n"))
    span = counted.groupBy("name").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("total"))
    share = F.when(F.col("high") > F.col("low"), (F.col("v") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(0.0))
    binned = counted.join(F.broadcast(span), "name").withColumn("bin", F.least(F.floor(share * BINS), F.lit(BINS - 1)))  # span: a row a column

    # which bin holds which rank: a running sum over the bins of a column
    upto = Window.partitionBy("name").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (binned.groupBy("name", "bin").agg(F.sum("n").alias("n"), F.max("total").alias("total"))
            .withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))))
    rank = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.round((F.col("total") - 1) * F.lit(q)).cast("long").alias("rank")) for i, q in enumerate(quantiles)]))
    wanted = (bins.select("name", "bin", "before", "n", rank.alias("r")).where((F.col("r.rank") >= F.col("before")) & (F.col("r.rank") < F.col("before") + F.col("n")))
              .groupBy("name", "bin").agg(F.max("before").alias("before"), F.collect_list("r").alias("ranks")))

    # order only what lies in those bins
    within = Window.partitionBy("name", "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    found = (binned.select("name", "bin", "v", "n").join(F.broadcast(wanted), ["name", "bin"])  # wanted: a row a quantile at most
             .withColumn("first", F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0)))
             .withColumn("r", F.explode("ranks"))
             .where((F.col("r.rank") >= F.col("first")) & (F.col("r.rank") < F.col("first") + F.col("n"))))
    return found.groupBy("name").agg(F.array_sort(F.collect_list(F.struct(F.col("r.i").alias("i"), "v"))).alias("x")).select("name", F.col("x.v").alias("values"))
