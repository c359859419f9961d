"""Isotonic regression by pooling neighbouring scores, in ranges that are put together level by level.

Pooling is associative: the blocks of two neighbouring ranges, pooled once more, are the blocks of both. So
every range of scores is pooled in its own task, then sixteen ranges at a time are. A task streams its points and
holds blocks only. With labels 0 and 1 there are at most about n**(2/3) blocks of different means, so the last task
holds a vanishing share of the rows. The fit is exact; scores are never rounded or binned.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadentia.functions.scalars import magnitude_slot, q
from cadentia.plans.ordered import running
from cadentia.session import materialise

FAN = 16
BLOCK = "lo double, hi double, total double, weight double"


def pooled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merge neighbours, in ascending order of score, until the means rise strictly."""
    stack: list[tuple[float, float, float, float]] = []
    for part in parts:
        for lo, hi, total, weight in part.itertuples(index=False, name=None):
            while stack and stack[-1][2] * weight >= total * stack[-1][3]:
                before = stack.pop()
                lo, total, weight = before[0], total + before[2], weight + before[3]
            stack.append((lo, hi, total, weight))
    yield pd.DataFrame(stack, columns=["lo", "hi", "total", "weight"])


def isotonic_blocks(df: DataFrame, score: str, label: str) -> DataFrame:
    """``lo, hi, value, weight``: blocks of scores and the mean label of each, rising with the score.

    Rows whose score is null or NaN, or whose label is null, do not count. Equal scores share a block.
    """
    known = df.select(q(score).cast("double").alias("x"), q(label).cast("double").alias("y")).where(
        F.col("x").isNotNull() & ~F.isnan("x") & F.col("y").isNotNull()
    )
    points = known.groupBy("x").agg(F.sum("y").alias("total"), F.count("*").cast("double").alias("weight"))
    blocks = points.select(F.col("x").alias("lo"), F.col("x").alias("hi"), "total", "weight")
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        dealt = blocks.repartitionByRange(ranges, "lo") if ranges > 1 else blocks.repartition(1)
        blocks = materialise(dealt.sortWithinPartitions("lo").mapInPandas(pooled, BLOCK), "blocks")
        if ranges == 1:
            return blocks.select("lo", "hi", (F.col("total") / F.col("weight")).alias("value"), "weight")
        ranges = -(-ranges // FAN)


def isotonic_values(scored: DataFrame, blocks: DataFrame, score: str, name: str) -> DataFrame:
    """Add the value of each score: that of its block, between two blocks the straight line, outside the nearest.

    A null or NaN score, and any score if there is no block, has no value. Blocks learn their successor first, so
    scores meet both neighbours by carrying one block along slots of the score, and neither side is broadcast.
    """
    columns = [q(c) for c in scored.columns]
    x = q(score).cast("double")
    # Downwards over the blocks alone, each one's predecessor is the block above it.
    turned = blocks.select("lo", "hi", "value", F.struct("lo", "value").alias("_own"), (-F.col("lo")).alias("_down"), F.lit(0).alias("_all"))
    known = running(turned, ["_all"], ["_down"], magnitude_slot(F.col("_down")), previous={"_next": "_own"})
    marks = known.select(F.col("lo").alias("_x"), F.lit(0).alias("_kind"), F.struct("hi", "value", "_next").alias("_mark"), F.lit(0).alias("_all"))
    rows = scored.select(
        F.when(~F.isnan(x), x).alias("_x"), F.lit(1).alias("_kind"), F.struct(*columns).alias("_row"), F.lit(0).alias("_all")
    )
    line = rows.unionByName(marks, allowMissingColumns=True)
    below = running(line, ["_all"], ["_x", "_kind"], magnitude_slot(F.col("_x")), previous={"_below": "_mark"})
    least = blocks.agg(F.min_by("value", "lo").alias("_least"))  # one row
    lower = F.col("_below")
    upper = lower["_next"]
    share = (F.col("_x") - lower["hi"]) / (upper["lo"] - lower["hi"])
    value = (
        F.when(F.col("_x").isNull(), F.lit(None).cast("double"))
        .when(lower.isNull(), F.col("_least"))
        .when(upper.isNull() | (F.col("_x") <= lower["hi"]), lower["value"])
        .otherwise(lower["value"] + share * (upper["value"] - lower["value"]))
    )
    met = below.where(F.col("_kind") == 1).join(F.broadcast(least))
    return met.select(*[F.col("_row")[c].alias(c) for c in scored.columns], value.alias(name))
