"""Joins that keep rows whose key is null."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null equals null; the key columns come from ``left``."""
    others = [F.col(f"`{c}`") for c in right.columns if c not in columns]
    renamed = right.select(*[F.col(f"`{c}`").alias(f"_right_{c}") for c in columns], *others)
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"`_right_{c}`")) for c in columns]
    joined = left.join(renamed, reduce(lambda a, b: a & b, same), how)
    return joined.drop(*[f"_right_{c}" for c in columns])
