"""Exact distinct counts of whole-number ids by mergeable bitmaps.

An id is a bit of the bitmap of its bucket (32,768 ids each). Tasks build the bitmaps of the rows they
have, the bitmaps of a bucket are united after the shuffle, and their set bits are added up: any number of
counts over one table is one pass, with no copy of the rows per count in the aggregate (no ``Expand``)
and no set of ids anywhere. Made for ids that are dense, as surrogate keys are: a bucket costs 4 KB
however few of its ids occur.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_rows(df: DataFrame, ids: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """``keys, name, id``: the non-NULL ids to count, each under its name."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("long").alias("id")) for n, c in ids.items()]))
    return df.select(*keys, cells.alias("x")).select(*keys, "x.name", "x.id").where("id is not null")


def distinct_ids(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, name, n_distinct`` of the rows of ``id_rows`` (a name without an id has no row)."""
    bits = (rows.select(*keys, "name", F.bitmap_bucket_number("id").alias("bucket"), F.bitmap_bit_position("id").alias("bit"))
            .groupBy(*keys, "name", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits")))
    return bits.groupBy(*keys, "name").agg(F.sum(F.bitmap_count("bits")).alias("n_distinct"))
