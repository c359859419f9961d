"""Recursions ``state <- keep * state + gain`` along each key, composed instead of walked.

A row is the pair (keep, gain). Two pairs in a row are again a pair, so the rows of a key are put
together in blocks, the blocks in blocks of blocks, and so on; then every block hands the pair in front of it
down to its members. Any step sees at most ``fan`` members of one key, however long the key is, and
everything stays in column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadentia.functions.scalars import q
from cadentia.plans.joins import null_safe_join
from cadentia.session import materialise

PAIR = "struct<keep:double,gain:array<double>>"


def _pair(keep: Column, gain: Column) -> Column:
    return F.struct(keep.cast("double").alias("keep"), gain.cast("array<double>").alias("gain")).cast(PAIR)


def nothing() -> Column:
    """The pair that changes no state; a null gain stands for zeros."""
    return _pair(F.lit(1.0), F.lit(None))


def then(first: Column, second: Column) -> Column:
    """The pair of two steps, one after the other."""
    shrunk = F.transform(first["gain"], lambda g: second["keep"] * g)
    both = F.coalesce(F.zip_with(shrunk, second["gain"], lambda a, b: a + b), shrunk, second["gain"])
    return _pair(first["keep"] * second["keep"], both)


def applied(pair: Column, state: Column) -> Column:
    """The state after the steps of a pair."""
    shrunk = F.transform(state, lambda s: pair["keep"] * s)
    return F.coalesce(F.zip_with(shrunk, pair["gain"], lambda a, b: a + b), shrunk)


def affine_scan(
    df: DataFrame, keys: Sequence[str], number: str, keep: Column, gain: Column, fan: int = 16
) -> DataFrame:
    """Add ``before``: the pair of all steps of the key that come before the row.

    ``number`` counts a key's rows 1, 2, ... without gaps. ``gain`` may be null where a
    row adds nothing.
    """
    if fan < 2:
        raise ValueError("fan must be at least 2")
    columns = [q(c) for c in df.columns]
    rows = df.select(
        *[q(k) for k in keys], (q(number) - 1).alias("_n"), _pair(keep, gain).alias("_pair"), F.struct(*columns).alias("_row")
    )
    rows = materialise(rows, "steps")
    longest = rows.agg(F.max("_n")).first()[0] or 0
    levels = [_blocks(rows, keys, fan, "_row")]
    while longest >= fan:
        longest //= fan
        whole = F.aggregate("_items", nothing(), lambda s, x: then(s, x["_pair"]))
        above = levels[-1].select(*[q(k) for k in keys], q("_block").alias("_n"), whole.alias("_pair"))
        levels.append(_blocks(materialise(above, "blocks"), keys, fan))
    before = None
    for level in reversed(levels):
        begun = level.withColumn("_from", nothing())
        if before is not None:
            begun = null_safe_join(level, before.withColumnRenamed("_n", "_block"), [*keys, "_block"])
        fronts = F.aggregate(
            F.slice("_items", F.lit(1), F.size("_items") - 1),
            F.array("_from"),
            lambda out, x: F.concat(out, F.array(then(F.element_at(out, -1), x["_pair"]))),
        )
        placed = begun.select(*[q(k) for k in keys], F.explode(F.arrays_zip("_items", fronts.alias("_front"))).alias("_z"))
        if level is not levels[0]:
            before = placed.select(*[q(k) for k in keys], F.col("_z._items._n").alias("_n"), F.col("_z._front").alias("_from"))
    return placed.select(
        *[F.col("_z._items._row")[c].alias(c) for c in df.columns], F.col("_z._front").alias("before")
    )


def _blocks(rows: DataFrame, keys: Sequence[str], fan: int, *kept: str) -> DataFrame:
    """Up to ``fan`` consecutive rows of a key in one array, in order."""
    item = F.struct("_n", "_pair", *kept)
    # The number is unique in its block, so that it alone decides the order.
    sort = lambda a, b: F.when(a["_n"] < b["_n"], -1).otherwise(1)
    return rows.groupBy(*[q(k) for k in keys], F.floor(F.col("_n") / fan).alias("_block")).agg(
        F.array_sort(F.collect_list(item), sort).alias("_items")
    )
