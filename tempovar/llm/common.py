"""Helpers shared by the operators: reading a table, storing a stage, ranks without a hot group."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the Python workers, once per application (as ``--py-files`` would)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="tempovar-"), "tempovar.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a stage to the shared folder and read it back: the cut in the lineage.

    The files outlive executors, so a lost one costs only the tasks it was running. They
    stay until the folder is emptied, as any checkpoint does.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of a bitmap that ``sifted`` broadcasts, at most: 16 MB.
SIFT_BITS = 1 << 27


def sifted(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose long ``column`` may be among those of ``wanted`` (one long column ``k``).

    A bitmap of hashed keys, built by Spark and broadcast (at most 16 MB), drops most other rows in
    the scan, before a join shuffles them. It passes some that are not wanted, never drops one that is.
    """
    size = wanted.count()
    bits = min(SIFT_BITS, 1 << max(15, (8 * size).bit_length()))

    def place(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(bits))

    held = (wanted.select(place("k").alias("p")).select(F.bitmap_bucket_number("p").alias("_bucket"), F.bitmap_bit_position("p").alias("b"))
            .groupBy("_bucket").agg(F.bitmap_construct_agg("b").alias("_bitmap")))
    marked = df.withColumn("_place", place(column)).withColumn("_bucket", F.bitmap_bucket_number("_place"))
    byte = F.conv(F.hex(F.substring("_bitmap", (F.bitmap_bit_position("_place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.expr("shiftright(_byte, cast(bitmap_bit_position(_place) % 8 as int)) & 1 = 1")
    return marked.join(F.broadcast(held), "_bucket").withColumn("_byte", byte).where(hit).select(*[F.col(c) for c in df.columns])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gapless_rank(df: DataFrame, group: str, order: list[str], name: str, cells: int | None = None) -> DataFrame:
    """Add the 0-based gapless rank of each row within ``group`` as ``name``.

    A group may hold any share of all rows, so it is dealt into ``cells`` cells by a hash of
    ``order``; rows are numbered within a cell and shifted by the sizes of the cells before.
    Only sizes (at most groups x cells rows) meet per group. ``df`` is read twice: pass a
    stored or cheap frame. Rows equal in ``order`` get distinct ranks in any order.
    """
    cells = cells or shuffle_partitions(df.sparkSession)
    dealt = df.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    before = (dealt.groupBy(group, "_cell").count()
              .withColumn("_before", F.sum("count").over(
                  Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)))
              .select(F.col(group).alias("_g"), F.col("_cell").alias("_c"), F.coalesce("_before", F.lit(0)).alias("_before")))
    within = F.row_number().over(Window.partitionBy(group, "_cell").orderBy(*order)) - 1
    return (dealt.withColumn("_within", within)
            .join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_cell") == F.col("_c")))
            .withColumn(name, (F.col("_before") + F.col("_within")).cast("long"))
            .drop("_cell", "_g", "_c", "_before", "_within"))
