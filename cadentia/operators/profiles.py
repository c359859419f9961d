"""Reference profiles, anomaly scores and their explanation.

Measurements travel as one ``array<double>`` column in fixed feature order.
Fitting explodes the array to (key, position) rows, which are averaged on the
map side and never shuffled one by one; scoring works inside the row. A wide
layout with one column per feature was measured three to five times slower at
64 features, because generated code grows with the square of the width.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadentia.functions.scalars import DISPERSION_FLOOR, q, signed_deviation

# The two dispersion measures.
SCALINGS = ("mad", "std")
VECTOR = "features"


def as_keys(subject: str | Sequence[str]) -> list[str]:
    return [subject] if isinstance(subject, str) else list(subject)


def fit_centres(
    df: DataFrame, subject: str | Sequence[str], vector: str = VECTOR, spread: bool = False
) -> DataFrame:
    """Mean per feature as array ``centre`` with the row count ``n``.

    With ``spread`` also the sample standard deviations, from the same pass. A vector that
    is null or holds null or NaN, and keys whose vectors differ in length, fail the job
    with the key in the message.
    """
    keys = as_keys(subject)
    cells = df.select(*[q(k) for k in keys], F.posexplode(_filled(vector, keys)).alias("_pos", "_x"))
    stats = [F.count("*").alias("n"), F.avg("_x").alias("centre")]
    if spread:
        stats.append(F.stddev_samp("_x").alias("std"))
    per_cell = cells.groupBy(*keys, "_pos").agg(*stats)
    return _gather(per_cell, keys, ["centre", "std"] if spread else ["centre"])


def _named(keys: Sequence[str], what: str) -> Column:
    """Fails the job where it is evaluated; says which key it was."""
    shown = F.concat_ws(", ", *[F.coalesce(q(k).cast("string"), F.lit("null")) for k in keys])
    return F.raise_error(F.concat(F.lit(f"{what}, key ({', '.join(keys)}) = "), shown))


def _filled(vector: str, keys: Sequence[str]) -> Column:
    gap = q(vector).isNull() | F.exists(q(vector), lambda x: x.isNull() | F.isnan(x.cast("double")))
    return F.when(gap, _named(keys, f"{vector} with a missing feature")).otherwise(q(vector))


def _gather(per_cell: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Rows (keys, _pos, n, values) to arrays in position order, one row per key.

    The arrays are as long as the feature list, whatever the number of rows.
    """
    packed = F.array_sort(F.collect_list(F.struct("_pos", *names)))
    least, most = F.min("n"), F.max("n")
    even = F.when(least == most, most).otherwise(_named(keys, "vectors of different lengths"))
    grouped = per_cell.groupBy(*keys).agg(even.alias("n"), packed.alias("_cells"))
    return grouped.select(*keys, "n", *[F.col(f"_cells.{name}").alias(name) for name in names])


def fit_spreads(
    df: DataFrame,
    subject: str | Sequence[str],
    vector: str = VECTOR,
    scalings: Sequence[str] = ("mad",),
) -> DataFrame:
    """Centres plus unfloored arrays ``mad`` and/or ``std``.

    The mean absolute deviation needs the centre first, so rows are read twice.
    """
    unknown = [s for s in scalings if s not in SCALINGS]
    if unknown:
        raise ValueError(f"scaling {unknown[0]!r} is none of {', '.join(SCALINGS)}")
    keys = as_keys(subject)
    fitted = fit_centres(df, keys, vector, spread="std" in scalings)
    if "mad" not in scalings:
        return fitted
    distances = F.zip_with(q(vector), F.col("centre"), lambda x, c: F.abs(x - c))
    cells = (
        df.select(*[q(c) for c in (*keys, vector)])
        .join(fitted.select(*keys, "centre"), keys)
        .select(*keys, F.posexplode(distances).alias("_pos", "_x"))
        .groupBy(*keys, "_pos")
        .agg(F.count("*").alias("n"), F.avg("_x").alias("mad"))
    )
    return fitted.join(_gather(cells, keys, ["mad"]).drop("n"), keys)


def floor_spreads(
    spreads: DataFrame,
    subject: str | Sequence[str],
    scaling: str,
    floor: float = DISPERSION_FLOOR,
) -> DataFrame:
    """Choose one spread, floor it and count the floored features.

    Keys with fewer than two enrolment rows have no spread and are left out;
    :func:`too_few_rows` lists them.
    """
    return spreads.where(F.col("n") >= 2).select(
        *[q(k) for k in as_keys(subject)],
        "n",
        F.lit(scaling).alias("scaling"),
        F.size(F.filter(scaling, lambda s: s < floor)).alias("floored_features"),
        "centre",
        F.transform(scaling, lambda s: F.greatest(s, F.lit(floor))).alias("dispersion"),
    )


def fit_profiles(
    df: DataFrame,
    subject: str | Sequence[str],
    vector: str = VECTOR,
    scaling: str = "mad",
    floor: float = DISPERSION_FLOOR,
) -> DataFrame:
    """One profile per key: centre, floored dispersion, scaling, floored count.

    The key may be composite, such as (user, device class).
    """
    return floor_spreads(fit_spreads(df, subject, vector, (scaling,)), subject, scaling, floor)


def too_few_rows(df: DataFrame, subject: str | Sequence[str]) -> DataFrame:
    """Keys with fewer than the two enrolment rows a spread needs."""
    counted = df.groupBy(*[q(k) for k in as_keys(subject)]).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") < 2)


def require_fit_rows(df: DataFrame, subject: str | Sequence[str]) -> DataFrame:
    if (short := too_few_rows(df, subject).first()) is not None:
        named = short.asDict()
        raise ValueError(f"{named.pop('n')} row(s) for key {named}: a spread cannot be measured from fewer than 2")
    return df


def deviation_array(vector: Column, centre: Column, dispersion: Column) -> Column:
    """Signed deviations in dispersion units, one per feature."""
    offsets = F.zip_with(vector, centre, lambda x, c: x - c)
    return F.zip_with(offsets, dispersion, lambda o, d: o / d)


def absolute_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + F.abs(v))


def score_of(vector: Column, centre: Column, dispersion: Column) -> Column:
    """Dispersion-scaled Manhattan distance."""
    return absolute_sum(deviation_array(vector, centre, dispersion))


def filled(subject: str | Sequence[str], vector: str) -> Column:
    """The vector; one that is null or holds null or NaN fails the job, naming the key."""
    return _filled(vector, as_keys(subject))


def fitting_score(subject: str | Sequence[str], vector: str, centre: Column, dispersion: Column) -> Column:
    """The score of a filled vector; one that is not as long as the profile fails the job, naming the key."""
    wrong = _named(as_keys(subject), f"{vector} is not as long as the profile")
    return F.when(F.size(q(vector)) == F.size(centre), score_of(q(vector), centre, dispersion)).otherwise(wrong)


def checked_score(subject: str | Sequence[str], vector: str, centre: Column, dispersion: Column) -> Column:
    """The score of any vector; one with a missing feature or of another length fails the job, naming the key.

    A null or NaN among the features makes the score null or NaN, so the score is tested and not every feature.
    """
    broken = _named(as_keys(subject), f"{vector} with a missing feature")
    tested = lambda x: F.when(x.isNull() | F.isnan(x), broken).otherwise(x)
    fits = F.when(q(vector).isNotNull(), fitting_score(subject, vector, centre, dispersion))
    # In an array of one, so that the score is worked out once.
    return F.get(F.transform(F.array(fits), tested), F.lit(0))


def with_profile(
    df: DataFrame, profiles: DataFrame, subject: str | Sequence[str], how: str = "inner"
) -> DataFrame:
    """Attach ``centre`` and ``dispersion`` of each row's own key.

    No broadcast hint: Spark broadcasts profiles under the size it measured,
    and otherwise sorts, splitting the partitions of a hot subject.
    """
    keys = as_keys(subject)
    return df.join(profiles.select(*[q(k) for k in keys], "centre", "dispersion"), keys, how)


def deviations(df, profiles, subject, vector: str = VECTOR) -> DataFrame:
    """Rows plus the array ``deviations`` against their own subject's profile."""
    dev = deviation_array(q(vector), F.col("centre"), F.col("dispersion"))
    joined = with_profile(df, profiles, subject)
    return joined.withColumn("deviations", dev).drop("centre", "dispersion")


def anomaly_score(df, profiles, subject, vector: str = VECTOR) -> DataFrame:
    """Rows plus ``score`` against their own subject's profile; higher is less alike.

    A vector with a missing feature, or not as long as its profile, fails the job with the key in the message.
    """
    score = checked_score(subject, vector, F.col("centre"), F.col("dispersion"))
    return with_profile(df, profiles, subject).withColumn("score", score).drop("centre", "dispersion")


def ranked(values: Column, count: int) -> Column:
    """The ``count`` largest by absolute value as structs (by, pos, value).

    Ties keep their position. Sorting one small array in the row needs no shuffle.
    """
    if count < 0:
        raise ValueError("count must not be negative")
    cells = F.transform(
        values,
        lambda v, i: F.struct((-F.abs(v)).alias("by"), i.alias("pos"), v.alias("value")),
    )
    return F.slice(F.array_sort(cells), 1, count)


def top_deviations(
    df, profiles, subject, names: Sequence[str], vector: str = VECTOR, count: int = 3
) -> DataFrame:
    """One row per (row of ``df``, rank): the features that deviate most, signed."""
    scored = deviations(df, profiles, subject, vector)
    kept = [c for c in df.columns if c != vector]
    labels = F.array(*[F.lit(n) for n in names])
    return scored.select(
        *[q(c) for c in kept], F.posexplode(ranked(F.col("deviations"), count)).alias("_r", "_cell")
    ).select(
        *[q(c) for c in kept],
        (F.col("_r") + 1).alias("rank"),
        F.get(labels, F.col("_cell.pos")).alias("feature"),
        F.col("_cell.value").alias("deviation"),
    )


def _width(vector: str) -> Column:
    return F.when(q(vector).isNull(), F.lit(0)).otherwise(F.size(q(vector)))


def wrong_width(df: DataFrame, vector: str, width: int) -> DataFrame:
    """Rows whose vector does not have ``width`` values; a null vector counts as wrong."""
    return df.withColumn("width", _width(vector)).where(F.col("width") != width)


def require_width(df: DataFrame, vector: str, width: int) -> DataFrame:
    """Check inside the plan: a row of another width fails the job, naming its width."""
    found = _width(vector)
    message = F.concat(F.lit("row has "), found.cast("string"), F.lit(f" values, expects {width}"))
    checked = F.when(found == width, q(vector)).otherwise(F.raise_error(message))
    return df.withColumn(vector, checked)
