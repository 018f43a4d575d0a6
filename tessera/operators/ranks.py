"""Positions over a whole table, without a task that sees all of it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of monotonically_increasing_id below the partition's number; fixed by Spark.
PIECE_BITS = 33


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see: in spark.checkpoint.dir, else in the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def number_rows(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """df with the 1-based position of each row in the order of the keys.

    One sort by range partitions, written as a table; its pieces' sizes, one number per
    piece, are all that meets. Ties are placed once and keep their places.
    """
    place = "__place"
    path = scratch_folder(df.sparkSession)
    df.orderBy(*keys).withColumn(place, F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    piece, inside = F.shiftright(place, PIECE_BITS), F.col(place).bitwiseAND((1 << PIECE_BITS) - 1)
    sizes = dict(rows.groupBy(piece.alias("piece")).agg(F.max(inside) + 1).collect())
    before, offsets = 0, []
    for i in range(max(sizes, default=-1) + 1):
        offsets.append(before)
        before += sizes.get(i, 0)
    offset = F.get(F.array(*[F.lit(o).cast("long") for o in offsets]), piece.cast("int")) if offsets else F.lit(0)
    return rows.withColumn(name, (offset + inside + 1).cast("int")).drop(place)
