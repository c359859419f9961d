"""Every subject against every other one, as an equi-join over a grid of cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def grid_side(spark: SparkSession) -> int:
    """Cells per side, so that there is about one cell per shuffle partition."""
    return max(1, math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))))


def grid_pairs(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, keep: Column
) -> DataFrame:
    """Rows of ``left`` and ``right`` for which ``keep`` holds.

    The left rows are hashed to grid rows and copied to every grid column, the
    right rows the other way round, so each pair meets in exactly one cell.
    Copies grow with the square root of the cell count, and neither side has
    to fit into a broadcast.
    """
    side = grid_side(left.sparkSession)
    every = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    rows = left.withColumn("_gr", F.pmod(F.xxhash64(left_key), F.lit(side)).cast("int"))
    cols = right.withColumn("_gc", F.pmod(F.xxhash64(right_key), F.lit(side)).cast("int"))
    return (
        rows.withColumn("_gc", every)
        .join(cols.withColumn("_gr", every), ["_gr", "_gc"])
        .where(keep)
        .drop("_gr", "_gc")
    )
