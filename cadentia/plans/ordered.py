"""Ordered computations that never put one whole key into one task.

A window over ``partitionBy(key)`` sorts all rows of the key in a single task.
Here each key is cut into slots along its order. Windows run inside
``(key, slot)``, and what crosses a slot border is carried by a small table
with one row per slot.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadentia.plans.joins import null_safe_join
from cadentia.session import materialise

SLOT = "_slot"


def _sum_of(a: str, b: str) -> Column:
    """Sum of two partial sums; null only where both are, as in one sum over all rows."""
    total = F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0))
    return F.when(F.col(a).isNotNull() | F.col(b).isNotNull(), total)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slot: Column,
    totals: Mapping[str, Column | str] | None = None,
    previous: Mapping[str, str] | None = None,
    whole: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add running totals and previous values per key.

    ``totals`` maps a new column to what is summed from the key's first row up
    to and including the row. ``previous`` maps a new column to a column whose
    last non-null value strictly before the row is wanted. ``whole`` maps a new
    column to a name in ``totals`` whose sum over the entire key is wanted.
    ``order`` must be a total order inside a key and ``slot`` must never fall
    along it. Rows with a null key, order or slot are kept; nulls come first.
    """
    totals, previous, whole = dict(totals or {}), dict(previous or {}), dict(whole or {})
    part = [*keys, SLOT]
    based = df.withColumn(SLOT, slot)
    for name, what in totals.items():
        based = based.withColumn(f"_own_{name}", what if isinstance(what, Column) else F.col(what))

    def newest(column: str) -> Column:
        if column == order[0]:
            return F.max(column)
        return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.struct(*order)))

    slots = based.groupBy(*part).agg(
        *[F.sum(f"_own_{name}").alias(f"_in_{name}") for name in totals],
        *[newest(column).alias(f"_in_{name}") for name, column in previous.items()],
    )
    earlier = Window.partitionBy(*keys).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select(
        *part,
        *[F.sum(f"_in_{name}").over(earlier).alias(f"_carry_{name}") for name in totals],
        *[F.last(f"_in_{name}", True).over(earlier).alias(f"_carry_{name}") for name in previous],
        *[F.sum(f"_in_{of}").over(Window.partitionBy(*keys)).alias(n) for n, of in whole.items()],
    )
    inside = Window.partitionBy(*part).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = based.select(
        "*",
        *[F.sum(f"_own_{name}").over(upto).alias(f"_local_{name}") for name in totals],
        *[F.last(c, True).over(before).alias(f"_local_{name}") for name, c in previous.items()],
    )
    joined = null_safe_join(local, carried, part)
    kept = [F.col(f"`{c}`") for c in df.columns]
    return joined.select(
        *kept,
        *[
            _sum_of(f"_local_{n}", f"_carry_{n}").alias(n)
            for n in totals
        ],
        *[F.coalesce(f"_local_{n}", f"_carry_{n}").alias(n) for n in previous],
        *whole,
    )


def running_gaps(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slot: Column, opens: Callable[[Column, Column], Column],
    previous: str, total: str,
) -> DataFrame:
    """Add the value of ``order[0]`` before each row, and a running count of rows that open something.

    ``opens(value, before)`` says whether a row opens, given the value before it (null for the first); it is 0 or 1 and
    must be 1 where either is null. Both steps share one carry table with a row per slot: only the first row of a slot looks
    back across the border, so a slot is known by its first and last value and by what opens inside. ``order`` must be a total
    order inside a key and ``slot`` must never fall along it. Rows with a null value open and are no row's predecessor.
    """
    at, part = f"`{order[0]}`", [*keys, SLOT]
    inside = Window.partitionBy(*part).orderBy(*[F.col(f"`{c}`") for c in order])
    local = df.withColumn(SLOT, slot).withColumn(
        "_before", F.last(at, True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    )
    looks_back = F.col(at).isNotNull() & F.col("_before").isNull()
    opened = F.when(looks_back, 0).otherwise(opens(F.col(at), F.col("_before"))).cast("long")
    local = local.withColumn("_opened", opened).withColumn(
        "_run", F.sum("_opened").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    slots = local.groupBy(*part).agg(F.min(at).alias("_head"), F.max(at).alias("_tail"), F.sum("_opened").alias("_inner"))
    earlier = Window.partitionBy(*keys).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    known = slots.withColumn("_last", F.last("_tail", True).over(earlier)).withColumn(
        "_first", F.when(F.col("_head").isNotNull(), opens(F.col("_head"), F.col("_last"))).otherwise(0).cast("long")
    )
    carried = known.select(
        *part, "_last", "_first", F.coalesce(F.sum(F.col("_inner") + F.col("_first")).over(earlier), F.lit(0)).alias("_base")
    )
    before = F.when(F.col(at).isNotNull(), F.coalesce("_before", "_last")).otherwise(F.col("_before"))
    return null_safe_join(local, carried, part).select(
        *[F.col(f"`{c}`") for c in df.columns],
        before.alias(previous),
        (F.col("_base") + F.col("_first") + F.col("_run")).alias(total),
    )


def range_slots(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "range_slot") -> DataFrame:
    """The rows stored in ranges of (keys, order), with the number of the range: a slot for any total order.

    Spark samples the bounds over the whole composite order, so a key whose first order columns hardly differ is
    split as well as any other. Stored, because a range's number must not change when a task is run again.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(ranges, *[F.col(f"`{c}`") for c in (*keys, *order)])
    return materialise(placed.withColumn(name, F.spark_partition_id()), "ranges")


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    seconds: str,
    values: Mapping[str, Column | str],
    lengths: Mapping[str, int],
    step: int,
) -> DataFrame:
    """Add ``<value>_<length name>``: sums over trailing windows ending at each row.

    A key is cut into slices of ``step`` seconds, and every length must be a
    multiple of it. A row's window is its own slice so far, the whole slices in
    the middle, and the tail of the slice one length back. The middle comes from
    per-slice totals; each row is copied once per length into the slice where it
    forms the tail. So the copies do not grow with the length, and no task holds
    a key. Rows with a null time are each other's window.
    """
    for name, length in lengths.items():
        if length % step:
            raise ValueError(f"window {name} is not a multiple of the slice width")
    part = [*keys, SLOT]
    own = df.withColumn(SLOT, F.floor(F.col(seconds) / F.lit(step))).withColumn("_of", F.lit(0))
    for name, what in values.items():
        own = own.withColumn(f"_v_{name}", what if isinstance(what, Column) else F.col(what))
    made = [f"_v_{name}" for name in values]
    slots = own.groupBy(*part).agg(*[F.sum(v).alias(v) for v in made])
    along = Window.partitionBy(*keys).orderBy(SLOT)
    carried = slots.select(
        *part,
        *[
            # Null slots are peers in a range, so one would count itself as its past.
            F.when(
                F.col(SLOT).isNotNull(), F.sum(f"_v_{name}").over(along.rangeBetween(1 - length // step, -1))
            ).alias(f"_mid_{name}_{of}")
            for of, length in lengths.items()
            for name in values
        ],
    )
    # One pass forms a row and its copies, so that what lies upstream is held once.
    copies = [F.struct(F.lit(0).alias("_of"), F.col(SLOT).alias("_at"))]
    tails = [F.struct(F.lit(length).alias("_of"), (F.col(SLOT) + length // step).alias("_at")) for length in lengths.values()]
    placed = F.when(F.col(seconds).isNotNull(), F.array(*copies, *tails)).otherwise(F.array(*copies))
    rest = [c for c in df.columns if c not in (*keys, seconds)]
    both = own.drop("_of").withColumn("_copy", F.explode(placed)).select(
        *[F.col(f"`{c}`") for c in (*keys, seconds)], *made,
        F.col("_copy._at").alias(SLOT), F.col("_copy._of").alias("_of"),
        *[F.when(F.col("_copy._of") == 0, F.col(f"`{c}`")).alias(c) for c in rest],
    )
    inside = Window.partitionBy(*part).orderBy(seconds)
    sums = [
        F.sum(F.when(F.col("_of").isin(0, length), F.col(f"_v_{name}")))
        .over(inside.rangeBetween(-length, 0))
        .alias(f"_local_{name}_{of}")
        for of, length in lengths.items()
        for name in values
    ]
    own_rows = both.select("*", *sums).where(F.col("_of") == 0)
    return null_safe_join(own_rows, carried, part).select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[
            _sum_of(f"_local_{n}", f"_mid_{n}").alias(n)
            for n in (f"{name}_{of}" for of in lengths for name in values)
        ],
    )


def head_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], count: int, slot: Column
) -> DataFrame:
    """First ``count`` rows per key with their rank in ``head_rank``.

    Limited per (key, slot) first, so the second window sees at most ``count``
    rows of each slot; Spark also limits both windows before their exchange.
    """
    if count < 0:
        raise ValueError("count must not be negative")
    inner = Window.partitionBy(*keys, SLOT).orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn(SLOT, slot)
        .withColumn("_in_slot", F.row_number().over(inner))
        .where(F.col("_in_slot") <= count)
        .withColumn("head_rank", F.row_number().over(outer))
        .where(F.col("head_rank") <= count)
        .drop(SLOT, "_in_slot")
    )
