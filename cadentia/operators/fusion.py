"""Channels, confidence shrinkage, one attributed risk score and its action."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadentia.functions.scalars import day_slot, q, risk_scale
from cadentia.operators.outcomes import classification_metrics
from cadentia.operators.profiles import ranked
from cadentia.plans.affine import affine_scan
from cadentia.plans.boosted import fit_boosted
from cadentia.plans.isotonic import isotonic_blocks, isotonic_values
from cadentia.plans.joins import null_safe_join
from cadentia.plans.ordered import running

# The channels, the actions and the value for degraded data.
CHANNELS = ("behaviour", "automation", "transaction", "context", "payee")
ACTIONS = ("allow", "step_up", "restrict", "block")
DEGRADED_ACTION = "monitor"
# Parameters the design leaves open.
ACTION_LIMITS = {"step_up": 50.0, "restrict": 75.0, "block": 90.0}
CHANNEL_LIMIT = 1.0
TIER_LIMITS = (25.0, 50.0, 75.0)
FULL_EVIDENCE = {"keystrokes": 50.0, "buffer": 20.0, "gaps": 20.0, "transfers": 10.0, "device": 10.0}
PAYEE_HALF_LIFE_DAYS = 7.0


def _sum(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def session_context(
    sessions: DataFrame, profiles: DataFrame, devices: DataFrame, edges: DataFrame,
    payees: DataFrame, users: DataFrame, user: str = "user", device: str = "device",
    payee: str = "payee",
) -> DataFrame:
    """Attach all precomputed state by left joins; what is missing stays null.

    Adds ``has_profile``, ``has_device``, ``has_edge``, ``has_payee`` and
    ``has_user``. Each side has one row per key, so no session multiplies.
    """
    def marked(name: str, side: DataFrame) -> DataFrame:
        return side.withColumn(f"has_{name}", F.lit(1))

    # The user's state meets the user's devices, which are few, and reaches the sessions together with theirs.
    known = sessions.select(user, device).distinct()
    for name, side, keys in (("profile", profiles, [user, device]), ("device", devices, [user, device]), ("user", users, [user])):
        known = known.join(marked(name, side), keys, "left")
    out = null_safe_join(sessions, known, [user, device], "left")
    out = out.join(marked("edge", edges), [user, payee], "left").join(marked("payee", payees), [payee], "left")
    return out.na.fill(0, [f"has_{n}" for n in ("profile", "device", "edge", "payee", "user")])


def channel_scores(context: DataFrame) -> DataFrame:
    """Add the raw score of every channel as ``s_<channel>``.

    Reads ``anomaly``, ``interval_cv``, ``replayed``, ``robust_z``,
    ``prior_sessions``, ``recent_change`` and ``payee_risk``.
    """
    steady = 1 - F.least(F.coalesce("interval_cv", F.lit(1.0)), F.lit(1.0))
    return context.withColumns(
        {
            "s_behaviour": F.col("anomaly"),
            "s_automation": F.greatest(steady, F.col("replayed").cast("double")),
            "s_transaction": F.abs("robust_z"),
            "s_context": 1 / (1 + F.col("prior_sessions")) + F.col("recent_change"),
            "s_payee": F.col("payee_risk"),
        }
    )


def evidence(count: Column, full: float) -> Column:
    """How much of the evidence wanted is there, in [0, 1]; none when unknown."""
    return F.least(F.coalesce(count, F.lit(0)) / F.lit(full), F.lit(1.0))


def freshness(age_days: Column, half_life: float) -> Column:
    """Decays with age; 0 when there is no computation to be fresh."""
    return F.coalesce(F.exp(-F.greatest(age_days, F.lit(0.0)) / F.lit(half_life)), F.lit(0.0))


def channel_confidence(
    context: DataFrame, full: Mapping[str, float] | None = None,
    half_life_days: float = PAYEE_HALF_LIFE_DAYS,
) -> DataFrame:
    """Add ``c_<channel>``: evidence sufficiency, not certainty of guilt.

    Reads ``keystrokes``, ``buffer``, ``gaps``, ``transfers``, ``device_sessions``
    and ``payee_age_days``.
    """
    full = {**FULL_EVIDENCE, **(full or {})}
    return context.withColumns(
        {
            "c_behaviour": evidence(F.col("keystrokes"), full["keystrokes"])
            * evidence(F.col("buffer"), full["buffer"]),
            "c_automation": evidence(F.col("gaps"), full["gaps"]),
            "c_transaction": evidence(F.col("transfers"), full["transfers"]),
            "c_context": evidence(F.col("device_sessions"), full["device"]),
            "c_payee": freshness(F.col("payee_age_days"), half_life_days),
        }
    )


def channel_scales(training: DataFrame) -> DataFrame:
    """One row of training means and spreads: ``m_<channel>``, ``d_<channel>``."""
    return training.agg(
        *[F.avg(f"s_{c}").alias(f"m_{c}") for c in CHANNELS],
        *[F.stddev_samp(f"s_{c}").alias(f"d_{c}") for c in CHANNELS],
    )


def standardise(df: DataFrame, scales: DataFrame) -> DataFrame:
    """Add ``z_<channel>``: standardised and shrunk by confidence; unknown or without spread is 0.

    ``scales`` is the single row of :func:`channel_scales`, hence the broadcast.
    """
    joined = df.join(F.broadcast(scales))
    known = lambda c: F.when(
        F.col(f"d_{c}") > 0, F.col(f"c_{c}") * (F.col(f"s_{c}") - F.col(f"m_{c}")) / F.col(f"d_{c}")
    )
    z = {f"z_{c}": F.coalesce(known(c), F.lit(0.0)) for c in CHANNELS}
    return joined.withColumns(z).drop(*[f"m_{c}" for c in CHANNELS], *[f"d_{c}" for c in CHANNELS])


def standard_scores(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add ``z_<name>`` for every ``s_<name>``: standardised over all rows, 0 where unknown or without spread."""
    scales = df.agg(
        *[F.avg(f"s_{n}").alias(f"_m_{n}") for n in names], *[F.stddev_samp(f"s_{n}").alias(f"_d_{n}") for n in names]
    )
    joined = df.join(F.broadcast(scales))  # one row
    known = lambda n: F.when(F.col(f"_d_{n}") > 0, (F.col(f"s_{n}") - F.col(f"_m_{n}")) / F.col(f"_d_{n}"))
    z = {f"z_{n}": F.coalesce(known(n), F.lit(0.0)) for n in names}
    return joined.withColumns(z).drop(*[f"_{part}_{n}" for part in "md" for n in names])


def cross_session_evidence(
    sessions: DataFrame, user: str, order: Sequence[str], value: str, decay_days: float, name: str = "cross_session"
) -> DataFrame:
    """Add what earlier sessions of the user still weigh: the sum of their values, each shrunk by its age.

    A value counts exp(-age / ``decay_days``). The running sum is a chain of (decay, value) pairs, which compose, so no
    user is walked in order. ``order`` is the total order of a user's sessions and begins with their time; null values count 0.
    """
    numbered = running(
        sessions, [user], order, day_slot(q(order[0]), 7), totals={"_no": F.lit(1).cast("long")}, previous={"_last": order[0]}
    )
    age = (F.unix_micros(q(order[0])) - F.unix_micros("_last")) / 8.64e10
    keep = F.coalesce(F.exp(-age / decay_days), F.lit(1.0))
    value_now = F.array(F.coalesce(q(value).cast("double"), F.lit(0.0)))
    placed = affine_scan(numbered.withColumn("_keep", keep), [user], "_no", F.col("_keep"), value_now)
    held = F.coalesce(F.get(F.col("before")["gain"], F.lit(0)), F.lit(0.0))
    return placed.withColumn(name, F.col("_keep") * held).drop("_no", "_last", "_keep", "before")


def log_odds(weights: Mapping[str, float], intercept: float) -> Column:
    return F.lit(float(intercept)) + _sum([F.lit(float(w)) * F.col(f"z_{c}") for c, w in weights.items()])


def fuse_risk(standardised: DataFrame, weights: Mapping[str, float], intercept: float = 0.0) -> DataFrame:
    """Add ``log_odds`` and ``risk`` in 0 to 100."""
    return standardised.withColumn("log_odds", log_odds(weights, intercept)).withColumn(
        "risk", risk_scale(F.col("log_odds"))
    )


def contribution(channel: str, weights: Mapping[str, float]) -> Column:
    return F.lit(float(weights[channel])) * F.col(f"z_{channel}")


def risk_contributions(
    fused: DataFrame, weights: Mapping[str, float], keys: Sequence[str], count: int = 3
) -> DataFrame:
    """One row per (decision, rank): the strongest channels with sign. Exact for a linear model."""
    names = [c for c in CHANNELS if c in weights]
    values = F.array(*[contribution(c, weights) for c in names])
    labels = F.array(*[F.lit(c) for c in names])
    return fused.select(*keys, F.posexplode(ranked(values, count)).alias("_r", "_cell")).select(
        *keys,
        (F.col("_r") + 1).alias("rank"),
        F.get(labels, F.col("_cell.pos")).alias("channel"),
        F.col("_cell.value").alias("contribution"),
    )


def risk_confidence(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Add ``confidence``: weighted mean of channel confidences, null without weight."""
    total = float(sum(weights.values()))
    if total == 0:
        return df.withColumn("confidence", F.lit(None).cast("double"))
    parts = [F.lit(float(w)) * F.coalesce(F.col(f"c_{c}"), F.lit(0.0)) for c, w in weights.items()]
    return df.withColumn("confidence", _sum(parts) / total)


def decide_action(
    fused: DataFrame, limits: Mapping[str, float] | None = None,
    channel_limit: float = CHANNEL_LIMIT, batch_flag: str | None = None,
) -> DataFrame:
    """Add ``channels_over`` and ``action``.

    Behaviour alone never goes beyond step-up. Blocking needs two channels over
    their limit, or one and a flag of the batch layer; one must not be behaviour.
    """
    limits = {**ACTION_LIMITS, **(limits or {})}
    over = {c: F.when(F.col(f"z_{c}") > channel_limit, 1).otherwise(0) for c in CHANNELS}
    count = _sum(list(over.values()))
    other = _sum([flag for c, flag in over.items() if c != "behaviour"])
    flagged = F.lit(False) if batch_flag is None else F.coalesce(q(batch_flag).cast("int") == 1, F.lit(False))
    corroborated = (count >= 2) | ((count >= 1) & flagged)
    action = (
        F.when((F.col("risk") >= limits["block"]) & (other >= 1) & corroborated, "block")
        .when((F.col("risk") >= limits["restrict"]) & (other >= 1), "restrict")
        .when(F.col("risk") >= limits["step_up"], "step_up")
        .otherwise("allow")
    )
    return fused.withColumn("channels_over", count).withColumn("action", action)


def fail_open(decided: DataFrame, state_flags: Sequence[str]) -> DataFrame:
    """Where precomputed state is missing, only monitor, with no confidence; never block."""
    missing = reduce(lambda a, b: a | b, [F.coalesce(q(f), F.lit(0)) == 0 for f in state_flags])
    return decided.withColumn(
        "action", F.when(missing, DEGRADED_ACTION).otherwise(F.col("action"))
    ).withColumn("confidence", F.when(missing, F.lit(0.0)).otherwise(F.col("confidence")))


def _assembled(df: DataFrame, label: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    cells = [f"z_{c}" for c in CHANNELS]
    packed = VectorAssembler(inputCols=cells, outputCol="features").transform(df)
    return packed.withColumn("label", q(label).cast("double"))


def fit_fusion(training: DataFrame, label: str, reg: float = 0.0) -> tuple[dict[str, float], float]:
    """Logistic weights per channel and the intercept; five numbers reach the driver."""
    from pyspark.ml.classification import LogisticRegression

    model = LogisticRegression(regParam=reg, standardization=False).fit(_assembled(training, label))
    return dict(zip(CHANNELS, map(float, model.coefficients), strict=True)), float(model.intercept)


def boosted_scores(
    training: DataFrame, scored: DataFrame, label: str, seed: int = 7, rounds: int = 20
) -> DataFrame:
    """Gradient-boosted comparison row: adds ``boosted``, the probability of an attack.

    Trees of depth 3 as in Spark's ``GBTClassifier``, trained on cells of bins with counts, see :mod:`cadentia.plans.boosted`.
    """
    names = [f"z_{c}" for c in CHANNELS]
    fitted = fit_boosted(training, names, label, "boosted", rounds, 3, seed)
    return fitted(scored.withColumn(label, q(label).cast("double")))


def calibrate(
    held_out: DataFrame, scored: DataFrame, score: str, label: str, method: str = "platt"
) -> DataFrame:
    """Add ``calibrated``, a probability fitted on a held-out split.

    ``platt`` is a logistic curve, ``isotonic`` the exact monotone fit, see :mod:`cadentia.plans.isotonic`.
    """
    if method == "isotonic":
        return isotonic_values(scored, isotonic_blocks(held_out, score, label), score, "calibrated")
    if method != "platt":
        raise ValueError(f"calibration is 'platt' or 'isotonic', not {method!r}")
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    packer = VectorAssembler(inputCols=[score], outputCol="features")

    def packed(df):
        return packer.transform(df).withColumn("label", q(label).cast("double"))

    model = LogisticRegression().fit(packed(held_out))
    value = F.get(vector_to_array("probability"), F.lit(1))
    return model.transform(packed(scored)).select(*[q(c) for c in scored.columns], value.alias("calibrated"))


def risk_tier(calibrated: DataFrame, limits: Sequence[float] = TIER_LIMITS) -> DataFrame:
    """Add ``risk_100`` and ``tier`` 1 to 4 from a calibrated probability."""
    scaled = 100.0 * F.col("calibrated")
    tier = F.lit(1)
    for limit in limits:
        tier = tier + F.when(scaled >= limit, 1).otherwise(0)
    return calibrated.withColumn("risk_100", scaled).withColumn("tier", tier)


def ablation_table(
    standardised: DataFrame, label: str, configurations: Mapping[str, Mapping[str, float]],
    intercept: float = 0.0, flag_at: float = 50.0,
) -> DataFrame:
    """Metrics of every configuration of weights, all from one pass over the rows."""
    cells = [
        F.struct(
            F.lit(name).alias("configuration"),
            (risk_scale(log_odds(weights, intercept)) >= flag_at).cast("int").alias("flag"),
        )
        for name, weights in configurations.items()
    ]
    rows = standardised.select(q(label).cast("int").alias("label"), F.inline(F.array(*cells)))
    return classification_metrics(rows, "label", "flag", ["configuration"])
