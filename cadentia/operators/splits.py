"""Which repetitions enrol, which are genuine tests, which act as impostors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadentia.functions.scalars import q
from cadentia.plans.ordered import head_per_key, range_slots, running

# Fixed values of the published protocol.
ENROLMENT_REPETITIONS = 200
IMPOSTOR_REPETITIONS = 5


def first_order_slot(order: Sequence[str]) -> Column:
    """Default slot: stretches of 4096 along a numeric first order column."""
    return F.floor(q(order[0]) / F.lit(4096))


def subjects(df: DataFrame, subject: str = "subject") -> DataFrame:
    """Distinct subjects, sorted for output."""
    return df.select(q(subject)).distinct().orderBy(q(subject))


def rep_rank(
    df: DataFrame, subject: str, order: Sequence[str], slot: Column | None = None
) -> DataFrame:
    """Number each subject's repetitions from 1 in canonical order.

    Without a slot the rows are dealt into ranges of (subject, order), so that no task ranks a whole subject, whatever
    the order consists of.
    """
    if slot is not None:
        return running(df, [subject], order, slot, totals={"rep_rank": F.lit(1).cast("long")})
    ranged = range_slots(df, [subject], order, "_range")
    return running(ranged, [subject], order, F.col("_range"), totals={"rep_rank": F.lit(1).cast("long")}).drop("_range")


def canonical_sort(df: DataFrame, subject: str, order: Sequence[str]) -> DataFrame:
    """Global output order; Spark range-partitions it, so no task holds everything."""
    return df.orderBy(q(subject), *[q(c) for c in order])


def enrolment_split(
    df: DataFrame,
    subject: str,
    order: Sequence[str],
    n_enrol: int = ENROLMENT_REPETITIONS,
    slot: Column | None = None,
) -> DataFrame:
    """Add ``role``: enrolment for the first ``n_enrol`` repetitions, else genuine.

    Only the place of the last enrolment row is worked out per subject, from
    the few rows that can be it (every task passes on ``n_enrol`` rows of a subject at
    most); the rest of the data is compared, not ranked.
    """
    slot = first_order_slot(order) if slot is None else slot
    place = F.struct(*[q(c).alias(f"k{i}") for i, c in enumerate(order)])
    keyed = df.select(q(subject), *[q(c) for c in order])
    cuts = (
        head_per_key(keyed, [subject], [q(c) for c in order], n_enrol, slot)
        .groupBy(q(subject))
        .agg(F.max(place).alias("_cut"))
    )
    role = F.when(place <= F.col("_cut"), "enrolment").otherwise("genuine")
    return df.join(cuts, subject).withColumn("role", role).drop("_cut")


def insufficient_subjects(df: DataFrame, subject: str, n_enrol: int) -> DataFrame:
    """Subjects without a repetition left over after enrolment."""
    return df.groupBy(q(subject)).agg(F.count("*").alias("n")).where(F.col("n") <= n_enrol)


def require_repetitions(df: DataFrame, subject: str, n_enrol: int) -> DataFrame:
    """Strict form of :func:`insufficient_subjects`: raise, or return ``df``."""
    short = insufficient_subjects(df, subject, n_enrol).first()
    if short is not None:
        raise ValueError(
            f"subject {short[0]} has {short[1]} repetitions, more than {n_enrol} are needed"
        )
    return df


def head_per_subject(
    df: DataFrame,
    subject: str,
    order: Sequence[str],
    k: int = IMPOSTOR_REPETITIONS,
    slot: Column | None = None,
) -> DataFrame:
    """First ``k`` repetitions of every subject: the impostor vectors for all others."""
    slot = first_order_slot(order) if slot is None else slot
    return head_per_key(df, [subject], [q(c) for c in order], k, slot)


def split_overlap(split: DataFrame, vector: str, subject: str = "subject") -> DataFrame:
    """Vectors that occur in both enrolment and genuine test of one subject; should be empty."""
    cells = [q(subject), q(vector)]
    enrolled = split.where(F.col("role") == "enrolment").select(*cells)
    return enrolled.intersect(split.where(F.col("role") == "genuine").select(*cells))
