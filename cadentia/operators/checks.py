"""Data checks that report rows instead of stopping at the first fault."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadentia.functions.scalars import is_finite, q


@dataclass(frozen=True)
class Expectations:
    """What a complete data set looks like. Defaults are the published corpus."""

    subjects: int = 51
    rows: int = 20_400
    features: int = 31
    rows_per_subject: int = 400


def null_audit(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column with its number of nulls, from a single pass."""
    names = list(columns or df.columns)
    counted = df.agg(*[F.count_if(q(c).isNull()).alias(c) for c in names])
    return counted.unpivot([], [q(c) for c in names], "column_name", "nulls")


def group_sizes(df: DataFrame, subject: str) -> DataFrame:
    """Smallest and largest number of rows per subject."""
    sizes = df.groupBy(q(subject)).agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("subjects"), F.min("n").alias("smallest"), F.max("n").alias("largest")
    )


def uneven_subjects(df: DataFrame, subject: str, rows_per_subject: int) -> DataFrame:
    sizes = df.groupBy(q(subject)).agg(F.count("*").alias("n"))
    return sizes.where(F.col("n") != rows_per_subject)


def verify_dataset(
    df: DataFrame, subject: str, features: Sequence[str], expected: Expectations
) -> DataFrame:
    """Rows ``check_name, expected, actual, ok``. One pass: counts per subject, then over them.

    ``features`` are the feature columns of a wide table.
    """
    nulls = reduce(lambda a, b: a + b, [q(c).isNull().cast("long") for c in df.columns])
    per_subject = df.groupBy(q(subject)).agg(
        F.count("*").alias("n"), F.sum(nulls).alias("nulls")
    )
    seen = per_subject.agg(
        F.count(q(subject)).alias("subjects"),
        F.sum("n").alias("rows"),
        F.sum("nulls").alias("nulls"),
        F.count_if(F.col("n") != expected.rows_per_subject).alias("uneven"),
    )
    checks = [
        ("subjects", F.lit(expected.subjects), F.col("subjects")),
        ("rows", F.lit(expected.rows), F.col("rows")),
        ("features", F.lit(expected.features), F.lit(len(features))),
        ("nulls", F.lit(0), F.col("nulls")),
        ("subjects with another row count", F.lit(0), F.col("uneven")),
    ]
    cells = [
        F.struct(
            F.lit(name).alias("check_name"),
            want.cast("long").alias("expected"),
            got.cast("long").alias("actual"),
            (want == got).alias("ok"),
        )
        for name, want, got in checks
    ]
    return seen.select(F.inline(F.array(*cells)))


def require_dataset(
    df: DataFrame, subject: str, features: Sequence[str], expected: Expectations
) -> DataFrame:
    """Raise on the first failed check, else return ``df``. Five rows reach the driver."""
    for row in verify_dataset(df, subject, features, expected).where(~F.col("ok")).collect():
        raise ValueError(f"expected {row.expected} {row.check_name}, found {row.actual}")
    return df


def rejected_rows(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Rows with a null, NaN or infinite feature; ``reason`` names the first."""
    reason = F.coalesce(
        *[
            F.when(q(f).isNull(), F.lit(f"{f} is null")).when(
                ~is_finite(q(f)), F.lit(f"{f} is not finite")
            )
            for f in features
        ]
    )
    return df.select(*[q(k) for k in keys], reason.alias("reason")).where(
        F.col("reason").isNotNull()
    )


def finite_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Rows that may be fitted; Spark's averages would silently skip nulls otherwise."""
    return df.where(q(vector).isNotNull() & F.forall(q(vector), is_finite))
