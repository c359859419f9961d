"""Exact quantiles per key without holding a key's values in one buffer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadentia.functions.scalars import magnitude_slot
from cadentia.plans.joins import null_safe_join


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float], count: str | None = None
) -> DataFrame:
    """Interpolated quantiles, one column per entry of ``probabilities``.

    First a histogram over value slots finds the slots that hold the wanted
    ranks; only rows of those slots are then counted by value. Both steps
    combine on the map side, so a hot key costs no more than a cold one. Null
    values do not count, a key with nothing else has null quantiles, NaN is larger
    than every number, and null is a key. ``count`` may name a column that says how often a row's value occurs.
    """
    for p in probabilities.values():
        if not 0.0 <= p <= 1.0:
            raise ValueError(f"probability {p} is outside [0, 1]")
    keys = list(keys)
    times = F.lit(1) if count is None else F.col(count)
    rows = df.select(*keys, F.col(value).cast("double").alias("_x"), times.cast("long").alias("_times"))
    rows = rows.withColumn("_slot", magnitude_slot(F.col("_x")))
    # Null values share a slot of their own that counts none.
    counts_of = F.sum(F.when(F.col("_x").isNull(), 0).otherwise(F.col("_times")))
    histogram = rows.groupBy(*keys, "_slot").agg(counts_of.alias("_n"))
    by_slot = Window.partitionBy(*keys).orderBy("_slot")
    everything = Window.partitionBy(*keys)
    counted = histogram.withColumn(
        "_end", F.sum("_n").over(by_slot.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_total", F.sum("_n").over(everything))
    start = F.col("_end") - F.col("_n")

    def place(p: float):
        return F.lit(p) * (F.col("_total") - 1)

    def holds(rank, begin, end):
        return (rank >= begin) & (rank < end)

    wanted = F.lit(False)
    for p in probabilities.values():
        for rank in (F.floor(place(p)), F.ceil(place(p))):
            wanted = wanted | holds(rank, start, F.col("_end"))
    targets = counted.where(wanted).select(*keys, "_slot", start.alias("_start"), "_total")
    counts = (
        null_safe_join(rows, targets, [*keys, "_slot"])
        .groupBy(*keys, "_slot", "_x", "_start", "_total")
        .agg(F.sum("_times").alias("_n"))
    )
    inside = Window.partitionBy(*keys, "_slot").orderBy("_x")
    ranked = counts.withColumn(
        "_end",
        F.col("_start") + F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
    )
    first = F.col("_end") - F.col("_n")
    picks = []
    for name, p in probabilities.items():
        for side, rank in (("lo", F.floor(place(p))), ("hi", F.ceil(place(p)))):
            hit = F.when(holds(rank, first, F.col("_end")), F.col("_x"))
            picks.append(F.max(hit).alias(f"_{side}_{name}"))
    found = ranked.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks)
    empty = counted.where(F.col("_total") == 0).select(*keys, *[F.lit(None).cast("double").alias(n) for n in probabilities])
    return found.select(
        *keys,
        *[
            (
                F.col(f"_lo_{name}")
                + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (place(p) - F.floor(place(p)))
            ).alias(name)
            for name, p in probabilities.items()
        ],
    ).unionByName(empty)
