"""Trust gates and the buffer of admitted sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadentia.functions.scalars import day_slot, q
from cadentia.plans.ordered import head_per_key

# Fixed values of the trust gates and the buffer.
VERIFY_STEP_UP, VERIFY_PASSKEY, VERIFY_PASSWORD = 1.0, 0.6, 0.3
DEVICE_SETTLED, DEVICE_YOUNG, DEVICE_NEW = 1.0, 0.5, 0.0
SETTLED_AFTER_SESSIONS = 10
STABLE_AFTER_DAYS = 7
TXN_CLEAN, TXN_MEDIUM, TXN_STOPPED = 1.0, 0.5, 0.0
TAU_MIN, BUFFER_SIZE = 0.5, 200


def trust_gates(sessions: DataFrame) -> DataFrame:
    """Add the four gates.

    Expects booleans or 0/1 ``step_up``, ``passkey``, ``enrolled``,
    ``recent_change``, ``txn_medium``, ``txn_stopped``, and the counts
    ``prior_sessions`` and ``prior_clean`` of earlier sessions on the device.
    The transaction flags must come from the non-behavioural channels only, or
    the gate would listen to the channel it guards.
    """

    def on(name):
        return q(name).cast("int") == 1

    device = (
        F.when(on("enrolled") & (F.col("prior_clean") >= SETTLED_AFTER_SESSIONS), DEVICE_SETTLED)
        .when(F.col("prior_sessions") > 0, DEVICE_YOUNG)
        .otherwise(DEVICE_NEW)
    )
    return sessions.withColumns(
        {
            "c_verify": F.when(on("step_up"), VERIFY_STEP_UP)
            .when(on("passkey") & on("enrolled"), VERIFY_PASSKEY)
            .otherwise(VERIFY_PASSWORD),
            "c_device": device,
            "c_stability": F.when(on("recent_change"), 0.0).otherwise(1.0),
            "c_txn": F.when(on("txn_stopped"), TXN_STOPPED)
            .when(on("txn_medium"), TXN_MEDIUM)
            .otherwise(TXN_CLEAN),
        }
    )


def trust_score(sessions: DataFrame) -> DataFrame:
    """Add the gates and ``tau``, their product: any zero vetoes."""
    gated = trust_gates(sessions)
    tau = F.col("c_verify") * F.col("c_device") * F.col("c_stability") * F.col("c_txn")
    return gated.withColumn("tau", tau)


def buffer_evict(
    admitted: DataFrame, keys: Sequence[str], order: Sequence[str], m: int = BUFFER_SIZE,
    slot_days: float = 7.0,
) -> DataFrame:
    """The newest ``m`` admitted sessions per key; older ones have left the buffer."""
    newest = [q(c).desc() for c in order]
    kept = head_per_key(admitted, keys, newest, m, day_slot(q(order[0]), slot_days))
    return kept.withColumnRenamed("head_rank", "buffer_rank")


def admit_to_buffer(
    sessions: DataFrame, keys: Sequence[str], order: Sequence[str],
    tau_min: float = TAU_MIN, m: int = BUFFER_SIZE,
) -> DataFrame:
    """Sessions with enough trust, weighted by it; the rest are discarded, not shrunk."""
    admitted = sessions.where(F.col("tau") >= tau_min).withColumn("weight", F.col("tau"))
    return buffer_evict(admitted, keys, order, m)


def rejection_reason(tau_min: float = TAU_MIN):
    """Why a session is not admitted; the vetoes come before mere lack of trust."""
    return (
        F.when(F.col("tau") >= tau_min, F.lit(None).cast("string"))
        .when(F.col("c_stability") == 0, "recent change")
        .when(F.col("c_device") == 0, "new device")
        .when(F.col("c_txn") == 0, "transaction stopped")
        .otherwise("low trust")
    )


# Why an admitted session moved its profile less than it asked for.
SATURATED = "budget saturated"


def rejected_updates(
    sessions: DataFrame, user: str, tau_min: float = TAU_MIN, bounded: DataFrame | None = None
) -> DataFrame:
    """Refused profile updates per user and reason.

    ``bounded`` may hold the sessions whose epoch the displacement budget cut back; they count too.
    """
    reasons = sessions.select(user, rejection_reason(tau_min).alias("reason")).where(F.col("reason").isNotNull())
    if bounded is not None:
        reasons = reasons.unionByName(bounded.select(user, F.lit(SATURATED).alias("reason")))
    return reasons.groupBy(user, "reason").agg(F.count("*").alias("rejected"))
