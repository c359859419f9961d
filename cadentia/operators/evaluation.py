"""One-versus-rest evaluation: pair scores, error curves, equal error rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadentia.functions.scalars import DISPERSION_FLOOR, clip01, crossing_weight, magnitude_slot, q
from cadentia.operators import profiles as P
from cadentia.operators import splits as S
from cadentia.plans.ordered import running
from cadentia.plans.pairs import grid_pairs
from cadentia.session import materialise

# Class labels, false-rejection targets, the published comparison figure.
GENUINE, IMPOSTOR = 0, 1
FRR_TARGETS = (0.01, 0.05, 0.10, 0.20)
PUBLISHED_EER = 0.0962


def impostor_pairs(
    impostors: DataFrame, profiles: DataFrame, subject: str, vector: str = P.VECTOR
) -> DataFrame:
    """Score every impostor row against every profile but its own subject's.

    The protocol asks for all of these pairs, so none is dropped; they are
    spread over a grid of cells and leave the join as one number each.
    """
    targets = profiles.select(q(subject).alias("subject"), "centre", "dispersion")
    rows = impostors.select(q(subject).alias("impostor"), P.filled(subject, vector).alias("_v"))
    pairs = grid_pairs(
        targets, rows, "subject", "impostor", F.col("subject") != F.col("impostor")
    )
    score = P.fitting_score(["subject", "impostor"], "_v", F.col("centre"), F.col("dispersion"))
    return pairs.select("subject", "impostor", score.alias("score"))


def label_scores(genuine: DataFrame, impostor: DataFrame) -> DataFrame:
    """Stack two ``(subject, score)`` sets with label 0 and 1."""
    return genuine.select("subject", F.lit(GENUINE).alias("label"), "score").unionByName(
        impostor.select("subject", F.lit(IMPOSTOR).alias("label"), "score")
    )


def _counts(scores: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    named = F.concat(F.lit("a score is null for subject "), F.coalesce(F.col("subject").cast("string"), F.lit("null")))
    label = F.when(F.col("score").isNull(), F.raise_error(named)).otherwise(F.col("label").cast("long"))
    return scores.groupBy(*by).agg(F.sum(1 - label).alias("ng"), F.sum(label).alias("ni"))


def _both_classes(value: Column, genuine: Column, impostor: Column) -> Column:
    """``value``, unless a class is empty: then the job fails and names the subject."""
    complain = F.raise_error(
        F.concat(
            F.lit("one of the two labels has no score for subject "),
            F.col("subject").cast("string"),
        )
    )
    return F.when((genuine > 0) & (impostor > 0), value).otherwise(complain)


def error_curve(scores: DataFrame) -> DataFrame:
    """``subject, threshold, far, frr`` at every distinct score and at infinity.

    FAR(t) is the share of impostors below t, FRR(t) the share of genuine
    scores at or above t. All thresholds are kept, collinear ones too. What is stored
    on the way are counts per distinct score, as many rows as the curve has.
    """
    cumulated = running(
        materialise(_counts(scores, ["subject", "score"]), "counts"),
        ["subject"],
        ["score"],
        magnitude_slot(F.col("score")),
        totals={"ng_upto": "ng", "ni_upto": "ni"},
        whole={"g": "ng_upto", "i": "ni_upto"},
    )
    g, i = F.col("g"), F.col("i")
    here = F.struct(
        F.col("score").alias("threshold"),
        ((F.col("ni_upto") - F.col("ni")) / i).alias("far"),
        (1 - (F.col("ng_upto") - F.col("ng")) / g).alias("frr"),
    )
    end = F.struct(
        F.lit(float("inf")).alias("threshold"), F.lit(1.0).alias("far"), F.lit(0.0).alias("frr")
    )
    last = (F.col("ng_upto") == g) & (F.col("ni_upto") == i)
    samples = F.when(last, F.array(here, end)).otherwise(F.array(here))
    return cumulated.select("subject", F.inline(_both_classes(samples, g, i)))


def equal_error_rate(scores: DataFrame) -> DataFrame:
    """``subject, eer``: where FAR meets FRR, interpolated between two samples.

    A histogram of score slots shows in which slot the two rates cross; only
    the scores of that slot are then looked at one by one. Both steps combine
    before their shuffle, so neither a hot subject nor many distinct scores
    pile up in one task, and the result is exact.
    """
    slotted = scores.withColumn("slot", magnitude_slot(F.col("score")))
    per_slot = _counts(slotted, ["subject", "slot"])
    upto = Window.partitionBy("subject").orderBy("slot").rowsBetween(
        Window.unboundedPreceding, 0
    )
    whole = Window.partitionBy("subject")
    ramp = per_slot.select(
        "subject",
        "slot",
        (F.sum("ng").over(upto) - F.col("ng")).alias("g0"),
        (F.sum("ni").over(upto) - F.col("ni")).alias("i0"),
        F.sum("ng").over(upto).alias("g1"),
        F.sum("ni").over(upto).alias("i1"),
        F.sum("ng").over(whole).alias("g"),
        F.sum("ni").over(whole).alias("i"),
    )
    crossing = (
        ramp.withColumns(
            {total: _both_classes(F.col(total), F.col("g"), F.col("i")) for total in ("g", "i")}
        )
        .where(_gap("g0", "i0") < 0)
        .where(_gap("g1", "i1") >= 0)
        .select("subject", "slot", "g0", "i0", "g", "i")
    )
    fine = _counts(
        slotted.join(crossing, ["subject", "slot"]), ["subject", "score", "g0", "i0", "g", "i"]
    )
    along = Window.partitionBy("subject").orderBy("score").rowsBetween(
        Window.unboundedPreceding, 0
    )
    sampled = fine.select(
        "subject",
        "g",
        "i",
        (F.col("g0") + F.sum("ng").over(along) - F.col("ng")).alias("gb"),
        (F.col("i0") + F.sum("ni").over(along) - F.col("ni")).alias("ib"),
        (F.col("g0") + F.sum("ng").over(along)).alias("ga"),
        (F.col("i0") + F.sum("ni").over(along)).alias("ia"),
    )
    before, after = _gap("gb", "ib"), _gap("ga", "ia")
    far0, far1 = F.col("ib") / F.col("i"), F.col("ia") / F.col("i")
    eer = far0 + crossing_weight(before, after) * (far1 - far0)
    return sampled.where((before < 0) & (after >= 0)).select("subject", clip01(eer).alias("eer"))


def _gap(genuine: str, impostor: str) -> Column:
    """FAR minus FRR after so many genuine and impostor scores."""
    return F.col(impostor) / F.col("i") - (1 - F.col(genuine) / F.col("g"))


def far_at_frr(curve: DataFrame, targets: Sequence[float] = FRR_TARGETS) -> DataFrame:
    """Per subject, FAR at the strictest threshold that meets each FRR target."""
    return curve.groupBy("subject").agg(
        *[
            F.min(F.when(F.col("frr") <= t, F.col("far"))).alias(f"far_at_frr_{t:.2f}".replace(".", "_"))
            for t in targets
        ]
    )


def operating_points(per_subject: DataFrame) -> DataFrame:
    """Mean over subjects of every ``far_at_frr`` column, one row."""
    names = [c for c in per_subject.columns if c.startswith("far_at_frr_")]
    return per_subject.agg(*[F.avg(q(c)).alias(c) for c in names])


def rates_at_threshold(curve: DataFrame, threshold: float) -> DataFrame:
    """FAR and FRR at the sampled threshold nearest the one asked for; the lower wins a tie."""
    nearness = F.struct(F.abs(F.col("threshold") - threshold), F.col("threshold"))
    picked = curve.groupBy("subject").agg(
        F.min_by(F.struct("threshold", "far", "frr"), nearness).alias("at")
    )
    return picked.select("subject", "at.threshold", "at.far", "at.frr")


def sorted_curve(curve: DataFrame) -> DataFrame:
    return curve.orderBy("subject", "threshold")


def mean_eer(eers: DataFrame) -> DataFrame:
    return eers.agg(F.avg("eer").alias("mean_eer"))


def std_eer(eers: DataFrame) -> DataFrame:
    """Population form, unlike the dispersion of a profile."""
    return eers.agg(F.stddev_pop("eer").alias("std_eer"))


def eer_summary(eers: DataFrame) -> DataFrame:
    return eers.agg(
        F.count("*").alias("subjects"),
        F.avg("eer").alias("mean_eer"),
        F.stddev_pop("eer").alias("std_eer"),
        F.min("eer").alias("min_eer"),
        F.max("eer").alias("max_eer"),
    )


def compare_scalings(mad: DataFrame, std: DataFrame) -> DataFrame:
    """``subject, eer_mad, eer_std``."""
    return mad.select("subject", F.col("eer").alias("eer_mad")).join(
        std.select("subject", F.col("eer").alias("eer_std")), "subject"
    )


def baseline_delta(comparison: DataFrame, published: float = PUBLISHED_EER) -> DataFrame:
    """Means, their distance to a published figure, and which scaling is lower (a tie is std)."""
    means = comparison.agg(
        F.avg("eer_mad").alias("mean_mad"), F.avg("eer_std").alias("mean_std")
    )
    return means.select(
        "mean_mad",
        "mean_std",
        (F.col("mean_mad") - published).alias("delta_mad"),
        (F.col("mean_std") - published).alias("delta_std"),
        F.when(F.col("mean_mad") < F.col("mean_std"), "mad").otherwise("std").alias("better"),
        F.abs(F.col("mean_mad") - F.col("mean_std")).alias("margin"),
    )


def scaled_scores(
    df: DataFrame,
    subject: str,
    order: Sequence[str],
    vector: str = P.VECTOR,
    scalings: Sequence[str] = ("mad",),
    n_enrol: int = S.ENROLMENT_REPETITIONS,
    k: int = S.IMPOSTOR_REPETITIONS,
    slot: Column | None = None,
) -> DataFrame:
    """``subject, label`` and one ``score_<scaling>`` per scaling, for the whole one-versus-rest protocol.

    All scalings share the split, the fit and the pairs: a pair is formed once and scored by
    each. Subjects without a genuine test row are left out as targets; list them with
    ``insufficient_subjects`` or refuse them with ``require_repetitions``. A vector with a missing feature, or not
    as long as a profile, fails the job with the subject in the message.
    """
    split = materialise(
        S.enrolment_split(df, subject, order, n_enrol, slot).select(
            q(subject).alias("subject"), *[q(c) for c in order if c != subject], P.filled(subject, vector).alias("_v"), "role"
        ),
        "split",
    )
    by = ["subject" if c == subject else c for c in order]
    enrolled = split.where(F.col("role") == "enrolment")
    spreads = P.fit_spreads(enrolled, "subject", "_v", scalings).where(F.col("n") >= 2)
    floored = [F.transform(c, lambda s: F.greatest(s, F.lit(DISPERSION_FLOOR))).alias(c) for c in scalings]
    fitted = materialise(spreads.select("subject", "centre", *floored), "profiles")

    def scored(rows: DataFrame, label: int) -> DataFrame:
        distances = [P.fitting_score("subject", "_v", F.col("centre"), F.col(c)).alias(f"score_{c}") for c in scalings]
        return rows.select("subject", F.lit(label).alias("label"), *distances)

    genuine = split.where(F.col("role") == "genuine").join(fitted, "subject")
    heads = S.head_per_subject(split, "subject", by, k, slot).select(F.col("subject").alias("impostor"), "_v")
    tested = split.groupBy("subject").agg(F.count("*").alias("_n")).where(F.col("_n") > n_enrol)
    targets = fitted.join(tested.select("subject"), "subject", "left_semi")
    pairs = grid_pairs(targets, heads, "subject", "impostor", F.col("subject") != F.col("impostor"))
    return scored(genuine, GENUINE).unionByName(scored(pairs, IMPOSTOR))


def protocol_scores(
    df: DataFrame, subject: str, order: Sequence[str], vector: str = P.VECTOR, scaling: str = "mad", **options
) -> DataFrame:
    """``subject, label, score`` of the protocol under one scaling."""
    made = scaled_scores(df, subject, order, vector, (scaling,), **options)
    return made.withColumnRenamed(f"score_{scaling}", "score")


def evaluate(df: DataFrame, subject: str, order: Sequence[str], **options) -> DataFrame:
    """Per-subject equal error rates; ``options`` as in :func:`protocol_scores`.

    The scores of all pairs are counted in the task that forms them and never stored;
    forming them a second time resolves the slot in which the rates cross.
    """
    return equal_error_rate(protocol_scores(df, subject, order, **options))


def evaluate_scalings(
    df: DataFrame, subject: str, order: Sequence[str], scalings: Sequence[str] = P.SCALINGS, **options
) -> DataFrame:
    """``subject`` and one ``eer_<scaling>`` per scaling, from one run of the protocol."""
    made = scaled_scores(df, subject, order, scalings=scalings, **options)
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("_by"), F.col(f"score_{c}").alias("score")) for c in scalings]))
    long = made.select("subject", "label", each)
    keyed = long.select(F.struct("subject", "_by").alias("subject"), "label", "score")
    rates = equal_error_rate(keyed)
    return rates.groupBy(F.col("subject.subject").alias("subject")).agg(
        *[F.max(F.when(F.col("subject._by") == c, F.col("eer"))).alias(f"eer_{c}") for c in scalings]
    )
